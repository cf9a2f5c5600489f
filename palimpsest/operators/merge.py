"""Filters, pages and merges of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import written
from .stored import recover, swap_in


def filtered(rows: DataFrame, **wanted) -> DataFrame:
    """Rows that agree with every value given; None asks for nothing."""
    tests = [F.col(k) == v for k, v in wanted.items() if v is not None]
    return rows.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page in order, with the number of all rows."""
    return rows.orderBy(*order).offset(offset).limit(limit).withColumn("total", rows.agg(F.count("*")).scalar())


def classify(old: DataFrame, new: DataFrame, key: str, body: str = "body") -> DataFrame:
    """(key, action): insert, update, keep or delete."""
    a, b = old.select(key, F.col(body).alias("_a"), F.lit(True).alias("_x")), new.select(key, F.col(body).alias("_b"), F.lit(True).alias("_y"))
    action = F.when(F.col("_x").isNull(), "insert").when(F.col("_y").isNull(), "delete").when(~F.col("_a").eqNullSafe(F.col("_b")), "update").otherwise("keep")
    return a.join(b, key, "full").select(key, action.alias("action"))


def merge_tables(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old rows, replaced or added to by the new ones of the same key; for incremental syncs."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def reuse_by_blob(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, file_id, how) of the new paths: kept by path, or adopted from a vanished file of the same content,
    first with first, or new."""
    kept = new.join(old.select("path", F.col("file_id").alias("old")), "path").select("path", F.col("old").alias("file_id"), F.lit("kept").alias("how"))
    w = Window.partitionBy("blob").orderBy("path")
    gone = old.join(new.select("path"), "path", "left_anti").select("blob", F.col("file_id").alias("old"), F.row_number().over(w).alias("r"))
    come = new.join(old.select("path"), "path", "left_anti").select("blob", "path", F.row_number().over(w).alias("r"))
    return kept.unionByName(come.join(gone, ["blob", "r"], "left").select("path", F.col("old").alias("file_id"), F.when(F.col("old").isNull(), "new").otherwise("adopted").alias("how")))


def without_gone(table: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """The stored rows whose key is still current; a null key is never current."""
    return table.join(current.select(key).distinct(), key, "left_semi")


def insert_absent(old: DataFrame, new: DataFrame, key: str, *order: str) -> DataFrame:
    """The old rows and the new ones of other keys; of new rows that share a key the first in order."""
    first = new.groupBy(key).agg(F.min_by(F.struct(*new.columns), F.struct(*order)).alias("row")).select("row.*")
    return old.unionByName(first.join(old.select(key), key, "left_anti"))


def write_table(rows: DataFrame, path: str, mode: str = "append", by: str | None = None) -> None:
    """Append to a stored table or, with mode overwrite, rebuild it; by a column, only the parts of it that the rows
    have are rebuilt. Rows may come from the table itself: what is overwritten is read from another path first."""
    writer = rows.write.mode(mode)
    if by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(by)
    writer.parquet(path)


def reconcile(path: str, current: DataFrame, key: str) -> int:
    """Delete the stored rows whose key isn't current, and return how many. The table that stays is written beside
    and swapped in, so that a crash leaves one of both."""
    spark = current.sparkSession
    recover(spark, path)
    table = spark.read.parquet(path)
    kept = written(without_gone(table, current, key))
    gone = table.count() - kept.count()
    if gone:
        swap_in(kept, path)
    return gone


def rebuild(path: str, rows: DataFrame, scope: str) -> DataFrame:
    """Replace the stored rows of the scopes that the rows have (as a graph's of one repository), and no others."""
    write_table(written(rows), path, "overwrite", scope)
    return rows.sparkSession.read.parquet(path)


def normalised_records(raw: DataFrame, natural: str, version: str, most: int) -> DataFrame:
    """(record, k, body, truncated, kind) of raw records (natural key, version, record as JSON), the last version of
    each natural key: numbers that can't be read are null, bodies are cut after ``most`` characters with a mark, and
    a record of a pull request is no issue."""
    last = raw.groupBy(natural).agg(F.max_by("record", version).alias("record"))
    x = F.from_json("record", "id string, k string, body string, pull_request boolean")
    rows = last.select(x.alias("x")).select("x.*")
    body = F.coalesce("body", F.lit(""))
    return rows.select(
        F.col("id").try_cast("long").alias("record"), F.col("k").try_cast("long").alias("k"), F.substring(body, 1, most).alias("body"), (F.length(body) > most).alias("truncated"),
        F.when(F.coalesce("pull_request", F.lit(False)), "pull_request").otherwise("issue").alias("kind"),
    )
