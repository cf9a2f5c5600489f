"""Tables written between steps, and numbers over all rows that don't put them in one task."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where a session in one process names none, one of this process, which goes
    with it. On a cluster the setting has to be there."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="palimpsest-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        named = f"file://{_own[0]}"
    return named.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The same rows, read from a table in the shared folder: what made them isn't run again, even if executors
    are lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/step-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_file(uri: str) -> pa.Table:
    """A file of a written table, read in a task."""
    fs, path = pafs.FileSystem.from_uri(uri)
    return pq.read_table(path, filesystem=fs, use_threads=False)


def numbered(rows: DataFrame, name: str, *order: str) -> tuple[DataFrame, int]:
    """The rows with their numbers from 1 in a unique order, and how many they are. Rows are sorted by ranges; a
    number is the place in its range and the rows of the ranges before, of which there is one sum a range."""
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = placed.withColumn("_part", part).join(F.broadcast(before), "_part")  # a row for each range
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_before", "_at"), placed.count()
