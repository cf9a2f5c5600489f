"""The graph at any commit: edges as intervals of positions in which they hold, and reads of many positions at once.

Nothing is built anew for a snapshot: it is the edges whose interval its position stabs. Positions and intervals meet
in bins by the intervals' widths, so that an interval lies in two bins whatever its width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import written

#: The end of what still holds.
FOREVER = (1 << 62) - 1
#: Classes of widths.
CLASSES = 64


def lives(versions: DataFrame) -> DataFrame:
    """(file, since, until) of the files of versions (file, pos, targets): from a version on until the next one that
    deletes it (null targets)."""
    w = Window.partitionBy("file").orderBy("pos")
    dead = F.col("targets").isNull()
    rows = versions.withColumn("life", F.sum(F.when(dead, 1).otherwise(0)).over(w)).withColumn("next", F.lead("pos").over(w))
    return rows.where(~dead).groupBy("file", "life").agg(F.min("pos").alias("since"), F.max(F.coalesce("next", F.lit(FOREVER))).alias("until")).select("file", "since", "until")


def edge_intervals(versions: DataFrame) -> DataFrame:
    """(src, dst, since, until) of versions (file, pos, targets), unique in file and pos: the spans of positions, the end
    left out, in which a file's last version has a target that is there. A span that goes on over several versions is
    one; a target that comes and goes makes several. Files that point to themselves make no edge."""
    versions = written(versions.select("file", "pos", "targets"))
    w = Window.partitionBy("file").orderBy("pos")
    placed = versions.select("file", "pos", "targets", F.row_number().over(w).alias("nth"), F.coalesce(F.lead("pos").over(w), F.lit(FOREVER)).alias("next"))
    each = placed.select(F.col("file").alias("src"), F.explode(F.array_distinct("targets")).alias("dst"), "pos", "nth", "next").where("src <> dst")
    island = F.col("nth") - F.row_number().over(Window.partitionBy("src", "dst").orderBy("nth"))
    spans = each.withColumn("i", island).groupBy("src", "dst", "i").agg(F.min("pos").alias("since"), F.max("next").alias("until"))
    there = lives(versions).select(F.col("file").alias("dst"), F.col("since").alias("s"), F.col("until").alias("u"))
    met = spans.join(there, "dst").where((F.col("since") < F.col("u")) & (F.col("s") < F.col("until")))
    return met.select("src", "dst", F.greatest("since", "s").alias("since"), F.least("until", "u").alias("until"))


def _class(width: Column) -> Column:
    """The number of binary digits: an interval is shorter than that power of two."""
    return F.length(F.bin(width))


def graph_at(intervals: DataFrame, points: DataFrame) -> DataFrame:
    """(pos, src, dst) of intervals (src, dst, since, until) at points (pos): the edges that hold at each."""
    every = F.array(*(F.lit(c) for c in range(CLASSES)))
    bin_of = lambda at: F.expr(f"shiftright(cast({at} as bigint), c)")
    placed = intervals.withColumn("c", _class(F.col("until") - F.col("since")))
    bins = placed.withColumn("bin", F.explode(F.array(bin_of("since"), bin_of("since") + 1)))
    asked = points.select("pos").distinct().withColumn("c", F.explode(every)).withColumn("bin", bin_of("pos"))
    return asked.join(bins, ["c", "bin"]).where("since <= pos AND pos < until").select("pos", "src", "dst")
