"""Versions, events, intervals and snapshots over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import numbered, written
from ..functions.scalars import DRIFT, SCORE
from .graphs import scc_cycles


def of_lineage(*order: str):
    return Window.partitionBy("lineage").orderBy(*(order or ("moment", "version_id")))


def version_deltas(versions: DataFrame) -> DataFrame:
    """(lineage, version_id, gap_seconds, renamed, value_delta) of each version against the one before."""
    w = of_lineage()
    rows = versions.withColumn("_at", F.lag("moment").over(w)).withColumn("_n", F.lag("name").over(w)).withColumn("_v", F.lag("value").over(w)).where("_at IS NOT NULL")
    return rows.select("lineage", "version_id", (F.col("moment") - F.col("_at")).alias("gap_seconds"), (F.col("name") != F.col("_n")).cast("int").alias("renamed"), F.round(F.col("value") - F.col("_v"), 4).alias("value_delta"))


def latest_version(versions: DataFrame) -> DataFrame:
    """The last version of each lineage; an aggregate, so that no lineage is sorted."""
    best = F.max(F.struct("moment", "version_id", "name", "value")).alias("x")
    return versions.groupBy("lineage").agg(best, F.count("*").alias("versions")).select("lineage", "x.version_id", "x.moment", "x.name", "x.value", "versions")


def ordered_distinct_names(versions: DataFrame) -> DataFrame:
    """(lineage, names) in the order in which they first came."""
    first = versions.groupBy("lineage", "name").agg(F.min(F.struct("moment", "version_id")).alias("k"))
    return first.groupBy("lineage").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]), ">").alias("names"))


def change_event_types(versions: DataFrame) -> DataFrame:
    """(lineage, version_id, event): a row for each event that a version means, introduced for the first one."""
    w = of_lineage()
    rows = versions.select("lineage", "version_id", "kind", "name", "value", F.lag("kind").over(w).alias("before"), F.lag("name").over(w).alias("last"), F.lag("value").over(w).alias("step"))
    events = F.array_compact(F.array(
        F.when(F.col("before").isNull(), "introduced"), F.when((F.col("before") == "deleted") & (F.col("kind") != "deleted"), "reintroduced"), F.when((F.col("kind") == "deleted") & F.col("before").isNotNull(), "deleted"),
        F.when(F.col("name") != F.col("last"), "renamed"), F.when(F.col("value") > 2 * F.col("step"), "body_changed"),
    ))
    return rows.select("lineage", "version_id", F.explode(events).alias("event"))


def state_as_of(versions: DataFrame, times: DataFrame) -> DataFrame:
    """For each (lineage, t) of ``times`` the version in force: the last one not after t. One pass over versions
    and times in order, without a join that pairs them."""
    rows = versions.select("lineage", "moment", F.lit(0).alias("ask"), "version_id", "name").unionByName(times.select("lineage", F.col("t").alias("moment"), F.lit(1).alias("ask"), F.lit(None).cast("long").alias("version_id"), F.lit(None).cast("string").alias("name")))
    w = Window.partitionBy("lineage").orderBy("moment", "ask", "version_id").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("v", F.last(F.when(F.col("ask") == 0, F.struct("version_id", "name")), ignorenulls=True).over(w)).where("ask = 1")
    return found.select("lineage", F.col("moment").alias("t"), F.col("v.version_id").alias("version_id"), F.col("v.name").alias("name"))


def lifecycle(versions: DataFrame, until: Column) -> DataFrame:
    """(lineage, alive) at a time: the last of introduced, reintroduced and deleted decides."""
    return versions.where(F.col("moment") <= until).groupBy("lineage").agg(F.max(F.struct("moment", "version_id", (F.col("kind") != "deleted").alias("alive"))).alias("x")).select("lineage", "x.alive")


def occurrence_names(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Keys told apart: a key that occurs more than once gets its order and number."""
    n = F.count("*").over(Window.partitionBy(key))
    k = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("unique_key", F.when(n > 1, F.concat(F.col(key).cast("string"), F.lit("@"), F.concat_ws(":", *order), F.lit("#"), k.cast("string"))).otherwise(F.col(key).cast("string")))


def every_nth(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """Rows 1, n + 1, 2 n + 1 and so on in a unique order, and the last."""
    placed, total = numbered(rows, "_k", *order)
    return placed.where((F.pmod(F.col("_k") - 1, F.lit(n)) == 0) | (F.col("_k") == total)).drop("_k")


def violation_intervals(edges: DataFrame, snapshots: DataFrame, broken: Column) -> DataFrame:
    """(src, dst, introduced, resolved, snapshots): runs of consecutive snapshots in which an edge breaks a rule;
    resolved is the first snapshot after a run, null while it lasts. A violation that comes back is a new row."""
    order, _ = numbered(snapshots.select("snapshot"), "ord", "snapshot")
    hits = edges.where(broken).select("snapshot", "src", "dst").distinct().join(order, "snapshot")
    island = F.col("ord") - F.row_number().over(Window.partitionBy("src", "dst").orderBy("ord"))
    runs = hits.withColumn("i", island).groupBy("src", "dst", "i").agg(F.min("snapshot").alias("introduced"), F.max("ord").alias("last"), F.count("*").alias("snapshots"))
    after = order.select((F.col("ord") - 1).alias("last"), F.col("snapshot").alias("resolved"))
    return runs.join(after, "last", "left").select("src", "dst", "introduced", "resolved", "snapshots")


def graph_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(src, dst, change, old_weight, new_weight): edges added, removed or of another weight."""
    a, b = before.select("src", "dst", F.col("weight").alias("old_weight")), after.select("src", "dst", F.col("weight").alias("new_weight"))
    change = F.when(F.col("old_weight").isNull(), "added").when(F.col("new_weight").isNull(), "removed").otherwise("changed")
    return a.join(b, ["src", "dst"], "full").withColumn("change", change).where(~F.col("old_weight").eqNullSafe(F.col("new_weight"))).select("src", "dst", "change", "old_weight", "new_weight")


def consecutive(edges: DataFrame) -> DataFrame:
    """(snapshot, src, dst, weight, before): each edge in each snapshot of its life or the one after, with its
    weight in the snapshot before; null where it isn't there."""
    order, _ = numbered(edges.select("snapshot").distinct(), "ord", "snapshot")
    placed = edges.join(order, "snapshot")
    now = placed.select("ord", "src", "dst", "weight")
    last = placed.select((F.col("ord") + 1).alias("ord"), "src", "dst", F.col("weight").alias("before"))
    return now.join(last, ["ord", "src", "dst"], "full").join(order, "ord").where("ord > 1").select("snapshot", "src", "dst", "weight", "before")


def snapshot_cycles(edges: DataFrame) -> DataFrame:
    """(snapshot, cycle): the members of each cycle of each snapshot, in order; all snapshots at once."""
    of = lambda c: F.concat_ws("\0", F.col("snapshot").cast("string"), F.col(c).cast("string"))
    member = F.split("node", "\0")
    found = scc_cycles(edges.select(of("src").alias("src"), of("dst").alias("dst"))).groupBy("component").agg(F.first(member[0]).alias("snapshot"), F.array_sort(F.collect_list(member[1])).alias("m"))
    return found.where(F.size("m") > 1).select(F.col("snapshot").cast(dict(edges.dtypes)["snapshot"]).alias("snapshot"), F.array_join("m", ",").alias("cycle"))


def structural_drift(edges: DataFrame) -> DataFrame:
    """(snapshot, node_distance, edge_distance, cycle_distance, drift) against the snapshot before: Jaccard distances
    of nodes, edges and cycles, 0 for two empty sets, weighed to 100. Weights are fixed values."""
    edges = written(edges)
    pairs = consecutive(edges)
    e = pairs.groupBy("snapshot").agg((1 - F.count_if(F.col("weight").isNotNull() & F.col("before").isNotNull()) / F.count("*")).alias("e"))
    ends = pairs.select("snapshot", F.explode(F.array("src", "dst")).alias("node"), "weight", "before")
    nodes = ends.groupBy("snapshot", "node").agg(F.max(F.col("weight").isNotNull()).alias("now"), F.max(F.col("before").isNotNull()).alias("then"))
    n = nodes.groupBy("snapshot").agg((1 - F.count_if(F.col("now") & F.col("then")) / F.count("*")).alias("n"))
    order, _ = numbered(edges.select("snapshot").distinct(), "ord", "snapshot")
    cycles = written(snapshot_cycles(edges).join(order, "snapshot").select("ord", "cycle"))
    now, then = cycles.withColumn("now", F.lit(True)), cycles.select((F.col("ord") + 1).alias("ord"), "cycle", F.lit(True).alias("then"))
    met = now.join(then, ["ord", "cycle"], "full").groupBy("ord").agg((1 - F.count_if(F.col("now") & F.col("then")) / F.count("*")).alias("c"))
    c = order.join(met, "ord").select("snapshot", "c")
    rows = e.join(n, "snapshot").join(c, "snapshot", "left").withColumn("c", F.coalesce("c", F.lit(0.0)))
    drift = 100 * (0.25 * F.col("n") + 0.60 * F.col("e") + 0.15 * F.col("c"))
    return rows.select("snapshot", F.round("n", SCORE).alias("node_distance"), F.round("e", SCORE).alias("edge_distance"), F.round("c", SCORE).alias("cycle_distance"), F.round(drift, DRIFT).alias("drift"))


def evolution_events(edges: DataFrame) -> DataFrame:
    """(snapshot, event, n): counts of edges that came, went or changed their weight."""
    w, b = F.col("weight"), F.col("before")
    event = F.when(b.isNull(), "dependency_introduced").when(w.isNull(), "dependency_removed").when(w != b, "dependency_weight_changed")
    return consecutive(edges).withColumn("event", event).where("event IS NOT NULL").groupBy("snapshot", "event").agg(F.count("*").alias("n"))


def rule_history(edges: DataFrame, snapshots: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule, snapshot, violations) of rules (rule, src, dst) over all snapshots, 0 where there are none: what saving
    a rule works out anew. Rules are few and written by hand; they are sent to all tasks."""
    hits = edges.join(F.broadcast(rules), ["src", "dst"]).groupBy("rule", "snapshot").agg(F.count("*").alias("n"))
    every = snapshots.select("snapshot").distinct().withColumn("rule", F.explode(F.array(*[F.lit(r[0]) for r in rules.select("rule").distinct().collect()])))
    return every.join(hits, ["rule", "snapshot"], "left").select("rule", "snapshot", F.coalesce("n", F.lit(0)).cast("long").alias("violations"))


def default_baseline(snapshots: DataFrame, baselines: DataFrame) -> DataFrame:
    """(snapshot, automatic): the baseline (snapshot, chosen_at) chosen last; without any, the first snapshot."""
    chosen = baselines.orderBy(F.desc("chosen_at"), F.desc("snapshot")).limit(1).select("snapshot", F.lit(False).alias("automatic"))
    first = snapshots.agg(F.min("snapshot").alias("snapshot")).where("snapshot IS NOT NULL").select("snapshot", F.lit(True).alias("automatic"))
    return chosen.unionByName(first).orderBy("automatic").limit(1)


def read_snapshot(edges: DataFrame, snapshot) -> DataFrame:
    """(src, dst, weight) of the last snapshot that isn't after the one asked for."""
    at = edges.where(F.col("snapshot") <= snapshot).agg(F.max("snapshot"))
    return edges.where(F.col("snapshot") == at.scalar()).select("src", "dst", "weight")


def events_with_context(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """(snapshot, event, n, requests): counts of the events of each snapshot with the requests (snapshot, request)
    of its time, in order."""
    asked = requests.groupBy("snapshot").agg(F.array_join(F.transform(F.array_sort(F.collect_set("request")), lambda x: x.cast("string")), ",").alias("requests"))
    return evolution_events(edges).join(asked, "snapshot", "left").select("snapshot", "event", "n", F.coalesce("requests", F.lit("")).alias("requests"))
