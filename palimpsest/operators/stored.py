"""Stored tables that outlive a crash: a swap of whole tables, and versions as a base with changes beside it.

A versioned table has a log of what counts. A change is written first and logged then, so that one that was cut off
is as if it had never begun and is written again under its number. Reading merges the last base with the changes
after it; when these have grown, they become a new base, and what no reader needs any more is removed.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ancestry import CommitGraph


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def recover(spark: SparkSession, path: str) -> None:
    """Finish or undo a swap that was cut off: without a table in its place, the whole new one or else the old one
    gets there; what is left beside it goes."""
    fs, place = _path(spark, path)
    new, old = (_path(spark, f"{path}.{k}")[1] for k in ("new", "old"))
    whole = _path(spark, f"{path}.new/_SUCCESS")[1]
    if not fs.exists(place):
        if fs.exists(whole):
            fs.rename(new, place)
        elif fs.exists(old):
            fs.rename(old, place)
    for left in (new, old):
        if fs.exists(place) and fs.exists(left):
            fs.delete(left, True)


def swap_in(rows: DataFrame, path: str) -> None:
    """Put the rows in place of a stored table, which they may be read from: written beside it, then swapped by two
    renames. At each moment the old or the new table is there whole, under its name or where ``recover`` finds it."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}.new")
    fs, place = _path(spark, path)
    old = _path(spark, f"{path}.old")[1]
    if fs.exists(place):
        fs.rename(place, old)
    fs.rename(_path(spark, f"{path}.new")[1], place)
    fs.delete(old, True)


class VersionedTable:
    """A table of rows by a unique key. ``most_changes`` is how many changes pile up before they become a new base."""

    def __init__(self, spark: SparkSession, path: str, key: str, most_changes: int = 8) -> None:
        self.spark, self.path, self.key, self.most_changes = spark, path, key, most_changes

    def log(self, before: int | None = None) -> list[tuple[int, str]]:
        """(version, kind) of what counts, in order: a base and the changes after it. One row a version."""
        try:
            rows = self.spark.read.schema("version long, kind string, batch long").parquet(f"{self.path}/log")
        except AnalysisException:
            return []
        seen = sorted((r["version"], r["kind"]) for r in rows.select("version", "kind").collect() if before is None or r["version"] < before)
        bases = [x for x in seen if x[1] == "base"][-1:]
        # a base stands for the changes up to its own version
        return bases + [x for x in seen if x[1] == "change" and (not bases or x[0] > bases[0][0])]

    def _note(self, version: int, kind: str) -> None:
        self.spark.createDataFrame([(version, kind)], "version long, kind string").write.mode("overwrite").parquet(f"{self.path}/log/batch={2 * version + (kind == 'base')}")

    def _data(self, version: int, kind: str) -> str:
        return f"{self.path}/{kind}/{version}"

    def read(self, before: int | None = None) -> DataFrame | None:
        """The rows as of the last version, or of the last one before a version; None where there is none."""
        parts = None
        for version, kind in self.log(before):
            rows = self.spark.read.parquet(self._data(version, kind)).withColumn("_version", F.lit(version))
            rows = rows.withColumn("_gone", F.lit(False)) if "_gone" not in rows.columns else rows
            parts = rows if parts is None else parts.unionByName(rows, allowMissingColumns=True)
        if parts is None:
            return None
        columns = [c for c in parts.columns if c not in ("_version", "_gone")]
        last = parts.groupBy(self.key).agg(F.max_by(F.struct(*columns, "_gone"), "_version").alias("row"))
        return last.select("row.*").where("NOT _gone").drop("_gone")

    def change(self, version: int, rows: DataFrame, gone: DataFrame | None = None) -> None:
        """Note rows to be put in or replaced by key, and keys (key) to be taken out, as a version larger than those
        before. Its cost follows the rows. Of rows of one key any one counts; of a key in both, the row."""
        found = rows.withColumn("_gone", F.lit(False))
        if gone is not None:
            found = found.unionByName(gone.select(self.key).distinct().join(rows.select(self.key), self.key, "left_anti").withColumn("_gone", F.lit(True)), allowMissingColumns=True)
        found.write.mode("overwrite").parquet(self._data(version, "change"))
        self._note(version, "change")
        if len(self.log()) > self.most_changes:
            self.compact()

    def compact(self) -> None:
        """Make the last version a base, and remove what came before the base before it."""
        log = self.log()
        if not log or log[-1][1] == "base":
            return
        self.read().write.mode("overwrite").parquet(self._data(log[-1][0], "base"))
        self._note(log[-1][0], "base")
        self._remove(log[0][0])

    def _remove(self, before: int) -> None:
        """Readers of the version before the last may still be at work; older ones aren't kept."""
        for kind in ("base", "change"):
            fs, folder = _path(self.spark, f"{self.path}/{kind}")
            if fs.exists(folder):
                for f in fs.listStatus(folder):
                    version = int(f.getPath().getName())
                    if version < before:
                        fs.delete(_path(self.spark, f"{self.path}/log/batch={2 * version + (kind == 'base')}")[1], True)
                        fs.delete(f.getPath(), True)


def continues(parents: DataFrame, last, head) -> bool:
    """Whether a history whose last synced commit was ``last`` can be synced on to ``head``; if not, it was rewritten
    and has to be built anew."""
    asked = parents.sparkSession.createDataFrame([(1, last, head)], f"id int, ancestor {dict(parents.dtypes)['child']}, commit {dict(parents.dtypes)['child']}")
    return CommitGraph(parents).is_ancestor(asked).first()["holds"]
