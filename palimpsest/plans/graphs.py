"""Reachability, cycles, paths, rules and trees."""

from pyspark.sql import functions as F

from ..operators import coupling as C
from ..operators import graphs as G
from ..operators import rules as R
from .registry import query

DEPTH = 4
REACH = "r AS (SELECT DISTINCT src AS seed, dst AS node, 1 AS depth FROM {e} UNION SELECT seed, dst, depth + 1 FROM r JOIN {e} ON node = src WHERE depth < {d})"


CLOSURE = "q AS (SELECT src AS seed, dst AS node FROM edges UNION SELECT seed, dst FROM q JOIN edges ON node = src)"


@query("lines edges", "WITH b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), r AS (SELECT (SELECT min(src) FROM edges) AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN b ON node = src WHERE depth < 3), m AS (SELECT node, min(depth) AS depth FROM r GROUP BY 1) SELECT node, depth FROM m ORDER BY depth, node LIMIT 15", True)
def bfs_subgraph(h):
    e = h.module_edges().select("src", "dst")
    return G.bfs_subgraph(e, e.agg(F.min("src")).first()[0] or 0, 3, 15)


@query("lines edges", "WITH x AS (SELECT dst AS src, src AS dst FROM edges), " + REACH.format(e="x", d=DEPTH) + " SELECT seed AS node, node AS dependent, min(depth) AS distance FROM r WHERE seed <> node GROUP BY 1, 2", True)
def impact_distance(h):
    return G.impact_distance(h.module_edges(), DEPTH)


@query("files changes refs", """WITH x AS (SELECT src, dst, type AS kind, CASE type WHEN 'IMPORTS' THEN 1.0 WHEN 'CALLS' THEN 0.9 ELSE 0.85 END::DOUBLE * (1 - (src * 7 + dst) % 5 / 10.0)::DOUBLE AS confidence FROM refs), k AS MATERIALIZED (SELECT dst AS place, src AS nxt, max(confidence) AS c, bool_or(kind = 'CALLS') AS calls FROM x GROUP BY 1, 2),
 f0 AS (SELECT file_id AS seed, file_id AS node, {'c': -1.0::DOUBLE, 'p': [file_id]} AS way, false AS caller FROM files WHERE module_id = (SELECT min(module_id) FROM files)), n0 AS (SELECT seed, node, 0 AS distance, way, caller FROM f0),
 b1 AS (SELECT seed, node, min(way) AS way, bool_or(caller) AS caller FROM (SELECT seed, nxt AS node, {'c': -least(-f.way.c, k.c), 'p': list_append(f.way.p, nxt)} AS way, calls AS caller FROM f0 f JOIN k ON k.place = f.node) WHERE (seed, node) NOT IN (SELECT (seed, node) FROM n0) GROUP BY 1, 2), f1 AS (SELECT * FROM b1), n1 AS (SELECT * FROM n0 UNION ALL SELECT seed, node, 1 AS distance, way, caller FROM f1),
 b2 AS (SELECT seed, node, min(way) AS way, bool_or(caller) AS caller FROM (SELECT seed, nxt AS node, {'c': -least(-f.way.c, k.c), 'p': list_append(f.way.p, nxt)} AS way, false AS caller FROM f1 f JOIN k ON k.place = f.node) WHERE (seed, node) NOT IN (SELECT (seed, node) FROM n1) GROUP BY 1, 2), f2 AS (SELECT * FROM b2), n2 AS (SELECT * FROM n1 UNION ALL SELECT seed, node, 2 AS distance, way, caller FROM f2),
 b3 AS (SELECT seed, node, min(way) AS way, bool_or(caller) AS caller FROM (SELECT seed, nxt AS node, {'c': -least(-f.way.c, k.c), 'p': list_append(f.way.p, nxt)} AS way, false AS caller FROM f2 f JOIN k ON k.place = f.node) WHERE (seed, node) NOT IN (SELECT (seed, node) FROM n2) GROUP BY 1, 2), f3 AS (SELECT * FROM b3), n3 AS (SELECT * FROM n2 UNION ALL SELECT seed, node, 3 AS distance, way, caller FROM f3),
 u AS (SELECT DISTINCT commit_id, file_id FROM changes), cc AS (SELECT a.file_id AS a, b.file_id AS b, count(*) AS co FROM u a JOIN u b ON a.commit_id = b.commit_id AND a.file_id <> b.file_id GROUP BY 1, 2)
 SELECT seed, node, distance, distance = 1 AS direct, caller, -way.c AS confidence, array_to_string(way.p, '>') AS path, coalesce(co, 0) AS co_changes FROM n3 LEFT JOIN cc ON seed = cc.a AND node = cc.b WHERE distance > 0 AND seed <> node""")
def impact_paths(h):
    """What depends on the files of one module, with confidences by kind."""
    sure = F.when(F.col("type") == "IMPORTS", 1.0).when(F.col("type") == "CALLS", 0.9).otherwise(0.85)
    edges = h.file_references().select("src", "dst", F.col("type").alias("kind"), (sure * (1 - (F.col("src") * 7 + F.col("dst")) % 5 / 10)).alias("confidence"))
    seeds = h.files().where(F.col("module_id") == h.files().agg(F.min("module_id")).scalar())
    return G.impact(edges, seeds.select(F.col("file_id").alias("node")), 3, C.coupled_with(h.changes(), seeds))


@query("lines edges", "WITH p AS (SELECT (SELECT min(src) FROM edges) AS node, 0 AS distance, [CAST((SELECT min(src) FROM edges) AS BIGINT)] AS p UNION SELECT dst, distance + 1, list_append(p, CAST(dst AS BIGINT)) FROM p JOIN edges ON node = src WHERE distance < 4 AND NOT list_contains(p, CAST(dst AS BIGINT))), b AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY distance, p) AS k FROM p) SELECT node, distance, array_to_string(p, '>') AS path FROM b WHERE k = 1", True)
def shortest_path(h):
    e = h.module_edges().select("src", "dst")
    return G.shortest_path(e, e.agg(F.min("src")).first()[0] or 0, DEPTH)


@query("lines edges", "WITH " + CLOSURE + ", m AS (SELECT a.seed, a.node FROM q a JOIN q b ON a.seed = b.node AND a.node = b.seed) SELECT seed AS node, min(node) AS component FROM m GROUP BY 1", True)
def scc_cycles(h):
    return G.scc_cycles(h.module_edges()).select("node", "component")


@query("lines edges", "WITH " + CLOSURE + ", m AS (SELECT a.seed, a.node FROM q a JOIN q b ON a.seed = b.node AND a.node = b.seed), c AS (SELECT seed AS node, min(node) AS component FROM m GROUP BY 1) SELECT component, count(*) AS size, sha256(string_agg(CAST(node AS VARCHAR), '|' ORDER BY node)) AS fingerprint FROM c GROUP BY 1 HAVING count(*) > 1", True)
def cycle_fingerprints(h):
    return G.cycle_fingerprints(scc_cycles(h))


@query("lines edges", "WITH d AS (SELECT n_nationkey AS node, (SELECT count(*) FROM edges WHERE src = n_nationkey) + (SELECT count(*) FROM edges WHERE dst = n_nationkey) AS k FROM nation), t AS (SELECT node FROM d ORDER BY k DESC, node LIMIT 12) SELECT src, dst, weight FROM edges WHERE src IN (SELECT node FROM t) AND dst IN (SELECT node FROM t)")
def graph_view(h):
    e = h.module_edges()
    return G.graph_view(e, C.degree_centrality(e, h.table("nation").select(F.col("n_nationkey").alias("node"))), 12)


RULES = "r AS (SELECT * FROM (VALUES ('no_asia_to_europe', 'forbidden', 'ASIA', 'EUROPE'), ('africa_only_itself', 'allowed', 'AFRICA', 'AFRICA')) v(rule, kind, source, target))"


@query("lines edges", "WITH " + RULES + ", n AS (SELECT n_nationkey AS node, r_name AS layer FROM nation JOIN region ON n_regionkey = r_regionkey), e AS (SELECT src, dst, CASE WHEN weight % 5 = 0 THEN 0.5 ELSE 0.9 END AS confidence FROM edges) SELECT rule, src, dst, CAST(confidence AS DOUBLE) AS confidence FROM e JOIN n a ON src = a.node JOIN n b ON dst = b.node JOIN r ON source = a.layer WHERE confidence >= 0.8 AND ((kind = 'forbidden' AND target = b.layer) OR (kind = 'allowed' AND target <> b.layer))")
def rule_violations(h):
    rules = h.spark.createDataFrame([("no_asia_to_europe", "forbidden", "ASIA", "EUROPE"), ("africa_only_itself", "allowed", "AFRICA", "AFRICA")], "rule string, kind string, source string, target string")
    layers = h.table("nation").join(h.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("node"), F.col("r_name").alias("layer"))
    edges = h.module_edges().select("src", "dst", F.when(F.col("weight") % 5 == 0, 0.5).otherwise(0.9).alias("confidence"))
    return G.rule_violations(edges, rules, layers)


SELECTORS = [
    ("layers", "forbidden", "layer", "ASIA", "layer", "Europe"), ("inside", "allowed", "prefix", "africa/", "prefix", "Africa"), ("one", "forbidden", "module", "america/canada", "prefix", "asia"),
    ("cycles", "forbidden_cycle", "prefix", "middle east", None, None), ("nothing", "forbidden", "component", "asia", "layer", "ASIA"),
]


@query("lines edges", "WITH " + CLOSURE + """, n AS (SELECT n_nationkey AS node, lower(r_name || '/' || n_name) AS path, lower(r_name) AS layer, CASE WHEN n_nationkey % 6 = 5 THEN 0.7 ELSE 0.9 END::DOUBLE AS sure FROM nation JOIN region ON n_regionkey = r_regionkey),
 e AS (SELECT src, dst, CASE WHEN weight % 5 = 0 THEN 0.5 ELSE 0.85 END::DOUBLE AS confidence FROM edges), k AS (SELECT e.src, e.dst, least(confidence, a.sure, b.sure) AS confidence, a.layer AS la, b.layer AS lb, a.path AS pa, b.path AS pb, a.sure AS sa, b.sure AS sb FROM e JOIN n a ON src = a.node JOIN n b ON dst = b.node WHERE confidence >= 0.8),
 c AS (SELECT seed AS node, min(node) AS component FROM (SELECT a.seed, a.node FROM q a JOIN q b ON a.seed = b.node AND a.node = b.seed) GROUP BY 1), d AS (SELECT component, sha256(string_agg(CAST(node AS VARCHAR), chr(0) ORDER BY node)) AS cycle FROM c GROUP BY 1 HAVING count(*) > 1)
 SELECT 'layers' AS rule, CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, confidence FROM k WHERE la = 'asia' AND sa >= 0.8 AND lb = 'europe' AND sb >= 0.8 UNION ALL SELECT 'inside', src, dst, confidence FROM k WHERE starts_with(pa, 'africa/') AND NOT starts_with(pb, 'africa/')
 UNION ALL SELECT 'one', src, dst, confidence FROM k WHERE pa = 'america/canada' AND starts_with(pb, 'asia/')
 UNION ALL SELECT 'cycles', CAST(min(c.node) AS VARCHAR), cycle, min(sure) FROM c JOIN d ON c.component = d.component JOIN n ON c.node = n.node WHERE starts_with(path, 'middle east/') GROUP BY cycle""", True)
def selector_rules(h):
    place = F.lower(F.concat_ws("/", "r_name", "n_name"))
    nodes = h.table("nation").join(h.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("node"), F.lit("module").alias("node_type"), place.alias("path"), F.col("r_name").alias("layer"), F.when(F.col("n_nationkey") % 6 == 5, 0.7).otherwise(0.9).alias("confidence"))
    rules = h.spark.createDataFrame(SELECTORS, "rule string, kind string, source_kind string, source string, target_kind string, target string")
    edges = h.module_edges().select("src", "dst", F.when(F.col("weight") % 5 == 0, 0.5).otherwise(0.85).alias("confidence"))
    return R.broken_rules(edges, nodes, rules)


@query("sources", "WITH a AS (SELECT lines, unnest(['', module, module || '/' || language]) AS directory FROM sources) SELECT directory, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines FROM a GROUP BY 1")
def dir_rollup(h):
    return G.directory_rollup(h.sources())


@query("commits", "WITH r AS (SELECT commit_id, moment, is_merge AS tagged, row_number() OVER (ORDER BY moment, commit_id) AS k, count(*) OVER () AS n FROM commits), c AS (SELECT *, row_number() OVER (ORDER BY k DESC) AS b FROM r WHERE (k - 1) % 25 = 0 OR k = n OR tagged) SELECT commit_id, moment FROM c WHERE b < 500 OR k = 1")
def snapshot_selection(h):
    return G.select_snapshots(h.commits().select("commit_id", "moment", F.col("is_merge").alias("tagged")), 25, 500)


@query(sql="SELECT p_partkey AS file_id, CASE WHEN p_size % 4 = 0 THEN 'controller' WHEN p_size % 4 = 1 THEN 'service' WHEN p_size % 4 = 2 THEN 'database' ELSE 'unknown' END AS layer FROM part")
def layer_classification(h):
    head = F.element_at(F.array(*map(F.lit, ("src/Controllers", "src/services", "app/models", "lib/other"))), F.col("p_size") % 4 + 1)
    return h.table("part").select(F.col("p_partkey").alias("file_id"), G.layer_of(F.concat_ws("/", head, F.col("p_partkey").cast("string"))).alias("layer"))
