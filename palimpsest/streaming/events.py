"""Structured Streaming forms of the time operators, with bounded state.

The batch queries give the same figures over a finished table; these keep up with one that grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stored import VersionedTable


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", step: str | None = None) -> DataFrame:
    """(start, event_type, n) in tumbling windows, or sliding ones; state older than the watermark is dropped."""
    w = F.window("ts", size, step) if step else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n) of runs of a user's events without a longer gap."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def without_repeats(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def sync_into(stream: DataFrame, path: str, key: str, order: str, checkpoint: str, most_changes: int = 8):
    """Take what has come, in micro-batches, and merge it by key into a versioned table; the same as a rebuild. Of a
    batch's rows of a key the last by ``order`` counts. A batch writes its own rows alone and notes them; one that
    was cut off is written again under its number."""

    def merge(batch: DataFrame, number: int) -> None:
        fresh = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("row")).select("row.*")
        VersionedTable(batch.sparkSession, path, key, most_changes).change(number, fresh)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """What has been synced so far; None where there is nothing."""
    return VersionedTable(spark, path, key).read()
