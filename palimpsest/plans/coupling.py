"""Coupling, dependencies and scores."""

from pyspark.sql import functions as F

from ..operators import coupling as C
from .registry import query

PAIRS = """WITH t AS (SELECT DISTINCT commit_id, file_id FROM changes), n AS (SELECT commit_id, count(*) AS n FROM t GROUP BY 1),
 u AS (SELECT t.* FROM t JOIN n ON t.commit_id = n.commit_id WHERE n <= {most}), c AS (SELECT file_id, count(*) AS c FROM u GROUP BY 1),
 p AS (SELECT a.file_id AS file_a, b.file_id AS file_b, count(*) AS co_changes FROM u a JOIN u b ON a.commit_id = b.commit_id AND a.file_id < b.file_id GROUP BY 1, 2),
 s AS (SELECT file_a, file_b, co_changes, round(co_changes / CAST(least(x.c, y.c) AS DOUBLE), 6) AS score FROM p JOIN c x ON file_a = x.file_id JOIN c y ON file_b = y.file_id)"""
COUNTS = "k AS (SELECT file_id, count(DISTINCT changes.commit_id) AS changes, count(DISTINCT author_id) AS authors FROM changes JOIN commits ON changes.commit_id = commits.commit_id GROUP BY 1)"
DEGREE = """d AS (SELECT node, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY 1),
 g AS (SELECT v.node, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, round((coalesce(fan_in, 0) + coalesce(fan_out, 0)) / ((SELECT count(*) FROM v) - 1.0), 6) AS centrality FROM v LEFT JOIN d ON v.node = d.node)"""


@query("changes", PAIRS.format(most=100) + " SELECT * FROM s WHERE co_changes >= 2")
def change_coupling(h):
    return C.change_coupling(h.changes(), 100, 2)


@query("changes", PAIRS.format(most=5) + " SELECT count(*) AS examined, count(*) FILTER (WHERE n <= 5) AS used, count(*) FILTER (WHERE n > 5) AS excluded, (SELECT count(*) FROM s) AS pairs FROM n")
def coupling_diagnostics(h):
    return C.coupling_diagnostics(h.changes(), 5)


@query("commits changes", "WITH " + COUNTS + " SELECT * FROM k")
def entity_change_counts(h):
    return C.entity_change_counts(h.changes(), h.commits())


@query("commits changes files", "WITH " + COUNTS + """, m AS (SELECT k.file_id, module_id, changes FROM k JOIN files ON k.file_id = files.file_id),
 r AS (SELECT *, min(changes) OVER w AS lo, max(changes) OVER w AS hi FROM m WINDOW w AS (PARTITION BY module_id))
 SELECT file_id, module_id, changes, round(CASE WHEN lo = 0 AND hi = 0 THEN 0.0 WHEN lo = hi THEN 0.5 ELSE (changes - lo) / CAST(hi - lo AS DOUBLE) END, 6) AS normalized FROM r""")
def minmax_normalize(h):
    rows = C.entity_change_counts(h.changes(), h.commits()).join(h.files().select("file_id", "module_id"), "file_id").select("file_id", "module_id", "changes")
    return C.minmax_normalize(rows, "module_id", "changes")


@query("lines edges", "WITH e AS (SELECT src, dst FROM edges), v AS (SELECT n_nationkey AS node FROM nation), " + DEGREE + " SELECT * FROM g")
def degree_centrality(h):
    return C.degree_centrality(h.module_edges(), h.table("nation").select(F.col("n_nationkey").alias("node")))


@query("commits changes files refs", PAIRS.format(most=100) + ", " + COUNTS + ", e AS (SELECT src, dst FROM refs GROUP BY 1, 2 HAVING count(*) >= 2), v AS (SELECT file_id AS node FROM files), " + DEGREE + """,
 q AS (SELECT f, max(score) AS coupling FROM (SELECT file_a AS f, score FROM s UNION ALL SELECT file_b, score FROM s) GROUP BY 1),
 a AS (SELECT files.file_id, coalesce(changes, 0) AS changes, coalesce(authors, 0) AS authors, centrality, coalesce(coupling, 0.0) AS coupling FROM files LEFT JOIN k ON files.file_id = k.file_id JOIN g ON files.file_id = g.node LEFT JOIN q ON files.file_id = q.f),
 z AS (SELECT *, min(changes) OVER () AS lo, max(changes) OVER () AS hi FROM a),
 n2 AS (SELECT *, round(CASE WHEN lo = 0 AND hi = 0 THEN 0.0 WHEN lo = hi THEN 0.5 ELSE (changes - lo) / CAST(hi - lo AS DOUBLE) END, 6) AS change_score FROM z)
 SELECT file_id, changes, authors, change_score, centrality, coupling, round(0.45 * change_score + 0.35 * centrality + 0.20 * coupling + 1e-9, 6) AS hotspot FROM n2""")
def hotspots(h):
    edges = h.file_references().groupBy("src", "dst").agg(F.count("*").alias("n")).where("n >= 2")
    return C.hotspots(h.changes(), h.commits(), h.files(), edges)


FILE_EDGES = "WITH f AS (SELECT src, dst, count(*) AS weight, max(CASE WHEN type = 'IMPORTS' THEN 1.0 ELSE 0.85 END) AS confidence, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM refs GROUP BY 1, 2)"


@query("refs", FILE_EDGES + " SELECT src, dst, weight, CAST(confidence AS DOUBLE) AS confidence, types FROM f")
def file_dependency_rollup(h):
    return C.file_dependencies(h.file_references())


@query("refs files", FILE_EDGES + " SELECT a.module_id AS src_module, b.module_id AS dst_module, count(*) AS weight FROM f JOIN files a ON src = a.file_id JOIN files b ON dst = b.file_id WHERE a.module_id <> b.module_id GROUP BY 1, 2")
def module_dependency_rollup(h):
    return C.module_dependencies(C.file_dependencies(h.file_references()), h.files())


@query(sql="""WITH r AS (SELECT l_suppkey AS src, l_orderkey % 50 AS dst, l_returnflag AS type, l_linenumber AS weight, l_discount AS confidence, l_orderkey AS ordinal, l_partkey AS evidence FROM lineitem),
 k AS (SELECT *, row_number() OVER (PARTITION BY src, dst, type ORDER BY ordinal, evidence) AS k FROM r WHERE src <> dst)
 SELECT src, dst, type, CAST(sum(weight) AS BIGINT) AS weight, max(confidence) AS confidence, string_agg(CAST(evidence AS VARCHAR), ',' ORDER BY k) FILTER (WHERE k <= 20) AS evidence FROM k GROUP BY 1, 2, 3""")
def edge_accumulation(h):
    rows = h.table("lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_orderkey") % 50).alias("dst"), F.col("l_returnflag").alias("type"), F.col("l_linenumber").alias("weight"), F.col("l_discount").alias("confidence"), F.col("l_orderkey").alias("ordinal"), F.col("l_partkey").alias("evidence"))
    return C.accumulate_edges(rows)


@query("lines edges", "WITH e AS (SELECT src, dst FROM edges), v AS (SELECT n_nationkey AS node FROM nation), " + DEGREE + """ SELECT count(*) AS nodes, round(avg(fan_in), 3) AS avg_fan_in, round(avg(fan_out), 3) AS avg_fan_out, round(avg(centrality), 3) AS avg_centrality,
 max(fan_in + fan_out) AS max_degree, (SELECT count(*) FROM e) AS edges, (SELECT max(n) FROM (SELECT count(*) AS n FROM g GROUP BY fan_in + fan_out)) AS largest_tie FROM g""")
def graph_metrics(h):
    return C.graph_metrics(degree_centrality(h), h.module_edges())


@query("lines edges", "SELECT (SELECT count(*) FROM nation) AS nodes, count(*) AS edges, round(count(*) / ((SELECT count(*) FROM nation) * ((SELECT count(*) FROM nation) - 1.0)), 6) AS density FROM edges")
def graph_density(h):
    return C.graph_density(h.module_edges(), h.table("nation"))
