"""Versions, events, snapshots and intervals."""

from pyspark.sql import functions as F

from ..operators import temporal as T
from ..operators import validity as V
from .registry import query

LAG = "WITH g AS (SELECT *, lag(moment) OVER w AS a0, lag(name) OVER w AS n0, lag(value) OVER w AS v0, lag(kind) OVER w AS k0 FROM versions WINDOW w AS (PARTITION BY lineage ORDER BY moment, version_id))"
CONSEC = """WITH o AS (SELECT snapshot, row_number() OVER (ORDER BY snapshot) AS ord FROM (SELECT DISTINCT snapshot FROM snaps)), n AS (SELECT ord, src, dst, weight FROM snaps JOIN o USING (snapshot)),
 c0 AS (SELECT coalesce(a.ord, b.ord + 1) AS ord, coalesce(a.src, b.src) AS src, coalesce(a.dst, b.dst) AS dst, a.weight AS weight, b.weight AS before FROM n a FULL JOIN n b ON a.ord = b.ord + 1 AND a.src = b.src AND a.dst = b.dst),
 c AS (SELECT snapshot, src, dst, weight, before FROM c0 JOIN o USING (ord) WHERE ord > 1)"""


@query("versions", LAG + " SELECT lineage, version_id, moment - a0 AS gap_seconds, CAST(name <> n0 AS INTEGER) AS renamed, round(value - v0, 4) AS value_delta FROM g WHERE a0 IS NOT NULL")
def version_deltas(h):
    return T.version_deltas(h.versions())


@query("versions", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY lineage ORDER BY moment DESC, version_id DESC) AS k, count(*) OVER (PARTITION BY lineage) AS versions FROM versions) SELECT lineage, version_id, moment, name, value, versions FROM r WHERE k = 1")
def latest_version(h):
    return T.latest_version(h.versions())


@query("versions", "WITH f AS (SELECT lineage, name, min((moment, version_id)) AS k FROM versions GROUP BY 1, 2) SELECT lineage, string_agg(name, '>' ORDER BY k) AS names FROM f GROUP BY 1")
def ordered_distinct_names(h):
    return T.ordered_distinct_names(h.versions())


@query("versions", LAG + """ SELECT lineage, version_id, 'introduced' AS event FROM g WHERE k0 IS NULL UNION ALL SELECT lineage, version_id, 'reintroduced' FROM g WHERE k0 = 'deleted' AND kind <> 'deleted'
 UNION ALL SELECT lineage, version_id, 'deleted' FROM g WHERE kind = 'deleted' AND k0 IS NOT NULL UNION ALL SELECT lineage, version_id, 'renamed' FROM g WHERE name <> n0 UNION ALL SELECT lineage, version_id, 'body_changed' FROM g WHERE value > 2 * v0""")
def change_event_types(h):
    return T.change_event_types(h.versions())


@query("versions", "WITH q AS (SELECT DISTINCT lineage, CAST(floor(moment / 86400) AS BIGINT) * 86400 + 43200 AS t FROM versions), r AS (SELECT q.lineage, t, version_id, name, row_number() OVER (PARTITION BY q.lineage, t ORDER BY v.moment DESC, version_id DESC) AS k FROM q LEFT JOIN versions v ON q.lineage = v.lineage AND v.moment <= t) SELECT lineage, t, version_id, name FROM r WHERE k = 1")
def state_as_of(h):
    v = h.versions()
    times = v.select("lineage", (F.floor(F.col("moment") / 86400).cast("long") * 86400 + 43200).alias("t")).distinct()
    return T.state_as_of(v, times)


@query("versions", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY lineage ORDER BY moment DESC, version_id DESC) AS k FROM versions WHERE moment <= (SELECT (min(moment) + max(moment)) // 2 FROM versions)) SELECT lineage, kind <> 'deleted' AS alive FROM r WHERE k = 1")
def lifecycle_fold(h):
    v = h.versions()
    return T.lifecycle(v, v.agg(F.floor((F.min("moment") + F.max("moment")) / 2)).scalar())


@query("versions", "WITH r AS (SELECT lineage, moment, version_id, count(*) OVER (PARTITION BY lineage) AS n, row_number() OVER (PARTITION BY lineage ORDER BY moment, version_id) AS k FROM versions) SELECT lineage, version_id, CASE WHEN n > 1 THEN lineage || '@' || moment || ':' || version_id || '#' || k ELSE CAST(lineage AS VARCHAR) END AS unique_key FROM r")
def occurrence_names(h):
    return T.occurrence_names(h.versions(), "lineage", "moment", "version_id").select("lineage", "version_id", "unique_key")


@query("lines snaps", "WITH o AS (SELECT DISTINCT snapshot FROM snaps), r AS (SELECT snapshot, row_number() OVER (ORDER BY snapshot) AS k, count(*) OVER () AS n FROM o) SELECT snapshot FROM r WHERE (k - 1) % 5 = 0 OR k = n")
def interval_sampling(h):
    return T.every_nth(h.snapshots().select("snapshot").distinct(), 5, "snapshot")


@query("lines snaps", """WITH o AS (SELECT snapshot, row_number() OVER (ORDER BY snapshot) AS ord FROM (SELECT DISTINCT snapshot FROM snaps)), b AS (SELECT src, dst, ord, ord - row_number() OVER (PARTITION BY src, dst ORDER BY ord) AS i, snapshot FROM snaps JOIN o USING (snapshot) WHERE (src + dst) % 3 = 0),
 r AS (SELECT src, dst, i, min(snapshot) AS introduced, max(ord) AS last, count(*) AS snapshots FROM b GROUP BY 1, 2, 3) SELECT src, dst, introduced, o.snapshot AS resolved, snapshots FROM r LEFT JOIN o ON o.ord = last + 1""")
def violation_intervals(h):
    s = h.snapshots()
    return T.violation_intervals(s, s.select("snapshot").distinct(), (F.col("src") + F.col("dst")) % 3 == 0)


@query("lines snaps", "WITH q AS (SELECT min(snapshot) AS lo, max(snapshot) AS hi FROM snaps), a AS (SELECT src, dst, weight FROM snaps, q WHERE snapshot = lo), b AS (SELECT src, dst, weight FROM snaps, q WHERE snapshot = hi - 1) SELECT coalesce(a.src, b.src) AS src, coalesce(a.dst, b.dst) AS dst, CASE WHEN a.weight IS NULL THEN 'added' WHEN b.weight IS NULL THEN 'removed' ELSE 'changed' END AS change, a.weight AS old_weight, b.weight AS new_weight FROM a FULL JOIN b ON a.src = b.src AND a.dst = b.dst WHERE a.weight IS DISTINCT FROM b.weight")
def graph_diff(h):
    s = h.snapshots()
    low, high = s.agg(F.min("snapshot")).scalar(), s.agg(F.max("snapshot") - 1).scalar()
    return T.graph_diff(s.where(F.col("snapshot") == low), s.where(F.col("snapshot") == high))


@query("lines snaps", CONSEC + """, reach AS (SELECT snapshot, src AS seed, dst AS node FROM snaps UNION SELECT r.snapshot, seed, s.dst FROM reach r JOIN snaps s ON r.snapshot = s.snapshot AND r.node = s.src), e AS (SELECT snapshot, 1 - count(*) FILTER (WHERE weight IS NOT NULL AND before IS NOT NULL) / CAST(count(*) AS DOUBLE) AS e FROM c GROUP BY 1),
 d AS (SELECT snapshot, node, max(CAST(weight IS NOT NULL AS INTEGER)) AS nw, max(CAST(before IS NOT NULL AS INTEGER)) AS th FROM (SELECT snapshot, src AS node, weight, before FROM c UNION ALL SELECT snapshot, dst, weight, before FROM c) GROUP BY 1, 2),
 m AS (SELECT snapshot, 1 - sum(nw * th) / CAST(count(*) AS DOUBLE) AS n FROM d GROUP BY 1),
 y AS (SELECT r.snapshot, r.seed, min(r.node) AS component FROM reach r JOIN reach b ON r.snapshot = b.snapshot AND r.seed = b.node AND r.node = b.seed GROUP BY 1, 2), z AS (SELECT snapshot, component, string_agg(CAST(seed AS VARCHAR), ',' ORDER BY CAST(seed AS VARCHAR)) AS cycle FROM y GROUP BY 1, 2 HAVING count(*) > 1),
 zo AS (SELECT ord, cycle FROM z JOIN o USING (snapshot)), za AS (SELECT coalesce(a.ord, b.ord + 1) AS ord, CAST(a.cycle IS NOT NULL AND b.cycle IS NOT NULL AS INTEGER) AS shared FROM zo a FULL JOIN zo b ON a.ord = b.ord + 1 AND a.cycle = b.cycle), zd AS (SELECT snapshot, 1 - sum(shared) / CAST(count(*) AS DOUBLE) AS c FROM za JOIN o USING (ord) GROUP BY 1)
 SELECT snapshot, round(n, 6) AS node_distance, round(e, 6) AS edge_distance, round(coalesce(c, 0.0), 6) AS cycle_distance, round(100 * (0.25 * n + 0.60 * e + 0.15 * coalesce(c, 0.0)), 2) AS drift FROM e JOIN m USING (snapshot) LEFT JOIN zd USING (snapshot)""", True)
def structural_drift(h):
    return T.structural_drift(h.snapshots())


@query("lines snaps", CONSEC + ", v AS (SELECT snapshot, CASE WHEN before IS NULL THEN 'dependency_introduced' WHEN weight IS NULL THEN 'dependency_removed' WHEN weight <> before THEN 'dependency_weight_changed' END AS event FROM c) SELECT snapshot, event, count(*) AS n FROM v WHERE event IS NOT NULL GROUP BY 1, 2")
def evolution_events(h):
    return T.evolution_events(h.snapshots())


@query("lines snaps", "SELECT snapshot, count(*) AS edges, CAST(sum(weight) AS BIGINT) AS weight, max(weight) AS heaviest FROM snaps GROUP BY 1")
def snapshot_trends(h):
    return h.snapshots().groupBy("snapshot").agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"), F.max("weight").alias("heaviest"))


@query("versions", "WITH r AS (SELECT lineage, version_id, moment, count(*) OVER (PARTITION BY lineage ORDER BY moment RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW) AS n FROM versions) SELECT lineage, version_id, n AS changes_7 FROM r")
def rolling_changes(h):
    from pyspark.sql import Window

    w = Window.partitionBy("lineage").orderBy("moment").rangeBetween(-604800, 0)
    return h.versions().select("lineage", "version_id", F.count("*").over(w).alias("changes_7"))


QUARTER_LINKS = "rq AS (SELECT DISTINCT CAST(year(o_orderdate) * 4 + quarter(o_orderdate) AS BIGINT) AS snapshot, conv_id AS request FROM orders JOIN (SELECT DISTINCT conv_id FROM conversations) ON o_custkey = conv_id)"


@query("lines snaps", CONSEC + ", v AS (SELECT snapshot, CASE WHEN before IS NULL THEN 'dependency_introduced' WHEN weight IS NULL THEN 'dependency_removed' WHEN weight <> before THEN 'dependency_weight_changed' END AS event FROM c), k AS (SELECT snapshot, event, count(*) AS n FROM v WHERE event IS NOT NULL GROUP BY 1, 2), " + QUARTER_LINKS + ", a AS (SELECT snapshot, string_agg(CAST(request AS VARCHAR), ',' ORDER BY request) AS requests FROM rq GROUP BY 1) SELECT k.snapshot, event, n, coalesce(requests, '') AS requests FROM k LEFT JOIN a ON k.snapshot = a.snapshot")
def evolution_context(h):
    quarter = (F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).cast("long")
    asked = h.table("orders").join(h.table("conversations").select("conv_id").distinct(), F.col("o_custkey") == F.col("conv_id")).select(quarter.alias("snapshot"), F.col("conv_id").alias("request"))
    return T.events_with_context(h.snapshots(), asked)


@query("lines snaps", "WITH r(rule, src, dst) AS (VALUES ('a', 0, 1), ('b', 2, 3), ('b', 3, 2)), s AS (SELECT DISTINCT snapshot FROM snaps) SELECT n.rule, s.snapshot, (SELECT count(*) FROM snaps JOIN r ON snaps.src = r.src AND snaps.dst = r.dst WHERE r.rule = n.rule AND snaps.snapshot = s.snapshot) AS violations FROM s, (SELECT DISTINCT rule FROM r) n")
def rule_history(h):
    rules = h.spark.createDataFrame([("a", 0, 1), ("b", 2, 3), ("b", 3, 2)], "rule string, src int, dst int")
    s = h.snapshots()
    return T.rule_history(s, s, rules)


@query("lines snaps", "WITH b AS (SELECT min(snapshot) AS snapshot FROM snaps), c AS (SELECT max(snapshot) AS snapshot FROM snaps WHERE snapshot % 4 = 0) SELECT coalesce(c.snapshot, b.snapshot) AS snapshot, c.snapshot IS NULL AS automatic FROM b, c")
def default_baseline(h):
    s = h.snapshots().select("snapshot").distinct()
    return T.default_baseline(s, s.where("snapshot % 4 = 0").withColumn("chosen_at", F.col("snapshot")))


@query("lines snaps", "SELECT src, dst, weight FROM snaps WHERE snapshot = (SELECT max(snapshot) FROM snaps WHERE snapshot <= (SELECT (min(snapshot) + max(snapshot)) // 2 FROM snaps))")
def snapshot_read(h):
    s = h.snapshots()
    return T.read_snapshot(s, s.agg(F.floor((F.min("snapshot") + F.max("snapshot")) / 2)).scalar())


VERSIONS = "v AS MATERIALIZED (SELECT l_suppkey AS file, l_orderkey AS pos, bool_and(l_returnflag = 'R') AS gone, list_distinct(list(1 + l_partkey % (SELECT max(s_suppkey) FROM supplier))) AS targets FROM lineitem GROUP BY 1, 2), p AS MATERIALIZED (SELECT max(o_orderkey) AS pos FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey)"


def file_versions(h):
    """A change makes a file point to what its lines name; one of renames alone deletes it."""
    n = h.table("supplier").agg(F.max("s_suppkey")).scalar()
    rows = h.table("lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("pos"), (1 + F.col("l_partkey") % n).alias("to"), "l_returnflag")
    return rows.groupBy("file", "pos").agg(F.when(~F.bool_and(F.col("l_returnflag") == "R"), F.collect_set("to")).alias("targets"))


@query(sql="WITH " + VERSIONS + """, l AS (SELECT p.pos AS at_pos, file, max(v.pos) AS pos FROM p JOIN v ON v.pos <= p.pos GROUP BY 1, 2), n AS MATERIALIZED (SELECT at_pos, v.file, targets FROM l JOIN v ON l.file = v.file AND l.pos = v.pos WHERE NOT gone),
 e AS (SELECT at_pos, file AS src, unnest(targets) AS dst FROM n) SELECT e.at_pos AS pos, src, dst FROM e JOIN n ON n.at_pos = e.at_pos AND n.file = e.dst WHERE src <> dst""")
def commit_graphs(h):
    """The graph at the last commit of each nation's authors."""
    points = h.table("orders").join(h.table("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.max("o_orderkey").alias("pos"))
    return V.graph_at(V.edge_intervals(file_versions(h)), points)
