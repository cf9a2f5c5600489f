"""Identity over time: lineages of files, and the pool of what was deleted, without going through the history in order.

A path's history is cut into segments: stretches in which each change works on what the one before left. Only
segments, not changes, point to where they came from, and pointers are doubled until they reach a beginning, so the
rounds are the logarithm of the longest chain of renames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import written

READ, UNSET, SET = 0, 1, 2


def _with_parents(changes: DataFrame) -> DataFrame:
    """Each change with ``parent``, the position of the change that made what it works on; null where there is none."""
    reads, unsets = F.col("kind").isin("renamed", "modified", "deleted"), F.col("kind").isin("renamed", "deleted")
    events = changes.select("repo", "pos", F.explode(F.array(
        F.struct(F.when(reads, F.col("old")).alias("at"), F.lit(READ).alias("what")), F.struct(F.when(unsets, F.col("old")).alias("at"), F.lit(UNSET).alias("what")),
        F.struct(F.when(F.col("kind") != "deleted", F.col("new")).alias("at"), F.lit(SET).alias("what")),
    )).alias("e")).select("repo", "pos", "e.at", "e.what").where("at IS NOT NULL")
    before = Window.partitionBy("repo", "at").orderBy("pos", "what").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("what") != READ, F.struct("what", "pos")), ignorenulls=True).over(before)
    found = events.withColumn("last", last).where((F.col("what") == READ) & (F.col("last.what") == SET)).select("repo", "pos", F.col("last.pos").alias("parent"))
    return changes.join(found, ["repo", "pos"], "left")


def roots(links: DataFrame) -> DataFrame:
    """(repo, node, root) of links (repo, node, parent), one for each node that has a parent, in forests: pointers are
    doubled. Nodes that have reached a root aren't joined again, so that no root gathers them."""
    left, done = written(links.select("repo", "node", F.col("parent").alias("to"))), None
    while True:
        step = left.select("repo", F.col("node").alias("to"), F.col("to").alias("further"))
        joined = written(left.join(step, ["repo", "to"], "left").select("repo", "node", "to", "further"))
        some = joined.where("further IS NULL").select("repo", "node", F.col("to").alias("root"))
        if done is not None:
            # of the others, those that point to one that is done are done as well
            known = done.select("repo", F.col("node").alias("to"), F.col("root").alias("r"))
            met = written(joined.where("further IS NULL").join(known, ["repo", "to"], "left").select("repo", "node", F.coalesce("r", "to").alias("root")))
            some = met
        done = some if done is None else done.unionByName(some)
        left = joined.where("further IS NOT NULL").select("repo", "node", F.col("further").alias("to"))
        if left.isEmpty():
            return done


def file_lineage(changes: DataFrame) -> DataFrame:
    """Rows (repo, pos, old_path, new_path, kind), unique in repo and pos: each gets the lineage it belongs to, named by
    the path and position that it began with. A modification, rename or deletion goes on with what lives under its
    old path; a rename and a deletion end that path; all else, and what works on nothing, begins a lineage.

    Empty paths count as null; a change without any path begins a lineage of its own."""
    rows = changes.select("repo", "pos", "kind", F.nullif("old_path", F.lit("")).alias("old"), F.nullif("new_path", F.lit("")).alias("new"))
    rows = _with_parents(rows).withColumn("path", F.coalesce("new", "old"))
    # what stays under its path goes on with the segment; the rest begins one
    begins = F.col("parent").isNull() | (F.col("path") != F.col("old"))
    so_far = Window.partitionBy("repo", "path").orderBy("pos")
    rows = written(rows.withColumn("begins", begins).withColumn("segment", F.last(F.when(F.col("begins"), F.col("pos")), ignorenulls=True).over(so_far)))
    came = rows.where("begins AND parent IS NOT NULL").select("repo", F.col("pos").alias("node"), F.col("parent").alias("pos"))
    links = came.join(rows.select("repo", "pos", F.col("segment").alias("parent")), ["repo", "pos"]).select("repo", "node", "parent")
    of = roots(links).select("repo", F.col("node").alias("segment"), "root")
    named = F.concat(F.coalesce("path", F.lit("")), F.lit("@"), F.col("pos").cast("string"))
    firsts = rows.where("begins AND parent IS NULL").select("repo", F.col("pos").alias("root"), named.alias("lineage"))
    segments = rows.where("begins").select("repo", F.col("pos").alias("segment")).join(of, ["repo", "segment"], "left").withColumn("root", F.coalesce("root", "segment"))
    told = segments.join(firsts, ["repo", "root"]).select("repo", "segment", "lineage")
    return rows.join(told, ["repo", "segment"]).select("repo", "pos", "path", "kind", "lineage")


def match_deleted(gone: DataFrame, come: DataFrame) -> DataFrame:
    """(new_id, old_id, kind) of symbols that came (id, path, name, body_hash, moment) and went before: of the same
    body and name, moved if the old one went at the same moment, reintroduced if earlier. Newcomers take in order of
    their moments, each the last one gone that is left, so that each old one comes back once and none is passed over.

    This is how brackets match: going opens and coming closes. The depth after each tells its level, and at one
    level what closes belongs to what opened last; a closing at depth 0 has no partner."""
    opens, closes = (x.select("name", "body_hash", "moment", F.lit(step).alias("step"), "id") for x, step in ((gone, 1), (come, -1)))
    of, by = ["name", "body_hash"], ["moment", F.desc("step"), F.when(F.col("step") == 1, F.col("id")).desc(), "id"]
    order = Window.partitionBy(*of).orderBy(*by)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = opens.unionByName(closes).withColumn("sum", F.sum("step").over(so_far))
    rows = rows.withColumn("low", F.least(F.lit(0), F.min("sum").over(so_far)))
    rows = rows.withColumn("depth", F.col("sum") - F.col("low")).withColumn("was", F.coalesce(F.lag("depth").over(order), F.lit(0)))
    level = F.when(F.col("step") == 1, F.col("depth")).when(F.col("was") > 0, F.col("was"))
    paired = Window.partitionBy(*of, "level").orderBy(*by)
    rows = rows.withColumn("level", level).where("level IS NOT NULL").withColumn("old", F.lag(F.struct("id", "moment")).over(paired)).where("step = -1")
    return rows.select(F.col("id").alias("new_id"), F.col("old.id").alias("old_id"), F.when(F.col("old.moment") == F.col("moment"), "moved").otherwise("reintroduced").alias("kind"))
