"""Shared folder, file access and small helpers for the operators of this folder.

Files that several executors read lie below ``spark.checkpoint.dir``. They are written and read through
pyarrow's file systems, so the folder can be any that pyarrow opens by URI.
"""

from __future__ import annotations

import atexit
import mmap
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where a session in one process names none, one of this process, which
    goes with it. On a cluster the setting has to be there."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="palimpsest-shared-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        named = f"file://{_own[0]}"
    return named if ":/" in named else f"file://{os.path.abspath(named)}"


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, once for each application, should they not have it on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    d = tempfile.mkdtemp()  # the driver serves the file from here as long as it runs
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    with zipfile.ZipFile(f"{d}/palimpsest_code.zip", "w") as z:
        for p in sorted((root / "palimpsest").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(f"{d}/palimpsest_code.zip")
    _shipped.add(sc.applicationId)


_kept: dict = {}


def kept_in_worker(key, make):
    """What a Python worker keeps from task to task: one thing, so that operators which run in the same workers
    one after another don't add up. Asking for another drops the one before."""
    if key not in _kept:
        _kept.clear()
        pa.default_memory_pool().release_unused()
        _kept[key] = make()
    return _kept[key]


def as_row(docs: DataFrame) -> DataFrame:
    """The rows of docs whole in a column "row", so that columns put beside it can't clash with the caller's."""
    return docs.select(F.struct("*").alias("row"))


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run of an operator."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, at = open_fs(path)
    fs.create_dir(at, recursive=True)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_sample(rows: DataFrame, most: int, *key: str) -> DataFrame:
    """At most ``most`` of the rows, the first by a hash of the key. A threshold on the hash comes first, so that
    tasks hold about that many in all, however many tasks there are."""
    n, h = rows.count(), F.xxhash64(*key)
    if n > most:
        share = (most + 6 * most**0.5 + 50) / n
        if share < 1:
            rows = rows.where(F.shiftrightunsigned(h, 1) < int(share * (1 << 63)))
    return rows.orderBy(h, *key).limit(most)


def join_small(rows: DataFrame, small: DataFrame, on: str, most_rows: int = 10_000, how: str = "left") -> DataFrame:
    """Join rows with a written table that has one row for each value of ``on``: broadcast when a count shows that
    it has at most ``most_rows`` rows, and otherwise by a shuffle, in which no value is that common."""
    return rows.join(F.broadcast(small) if small.count() <= most_rows else small.hint("merge"), on, how)


def spread_join(rows: DataFrame, keyed: DataFrame, on: str, by: str, ways: int = 8) -> DataFrame:
    """Join rows with a smaller table that has one row for each value of ``on``, a value of which may have a third of
    all rows: rows are dealt by the value and a salt of ``by``, and the table has its rows once for each salt."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(ways)).cast("int"))
    dealt = keyed.withColumn("_salt", F.explode(F.array(*map(F.lit, range(ways)))))
    return salted.join(dealt.hint("merge"), [on, "_salt"]).drop("_salt")


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if not uri.startswith("file:/") or uri.startswith("file:///") else "file:///" + uri[5:].lstrip("/"))


def write_bytes(uri: str, *parts) -> None:
    fs, at = open_fs(uri)
    with fs.open_output_stream(at) as out:
        for x in parts:
            out.write(x)


def read_bytes(uri: str, offset: int = 0, length: int | None = None) -> bytes:
    fs, at = open_fs(uri)
    with fs.open_input_file(at) as f:
        f.seek(offset)
        return f.read(length) if length is not None else f.read()


def mapped(uri: str):
    """The file's bytes: mapped where the folder is mounted here, else read."""
    fs, at = open_fs(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        with open(at, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if os.fstat(f.fileno()).st_size else b""
    return read_bytes(uri)


def text_bytes(column: str = "text"):
    """A text column as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def mixed(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ordered pair (h, g), element by element."""
    with np.errstate(over="ignore"):
        x = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (g + np.uint64(0x7F4A7C15F39CC060))
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return x


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def split_batches(batches, most_bytes: int = 8 << 20):
    """The same rows in batches whose binary column "text" holds about most_bytes, or a single row."""
    for b in batches:
        k = b.schema.get_field_index("text")
        if k < 0 or b.num_rows <= 1 or b.nbytes <= most_bytes:
            yield b
            continue
        sizes = np.diff(np.frombuffer(b.column(k).buffers()[1], dtype=np.int64 if pa.types.is_large_binary(b.column(k).type) or pa.types.is_large_string(b.column(k).type) else np.int32, count=b.num_rows + 1 + b.column(k).offset)[b.column(k).offset :])
        cuts, held = [0], 0
        for i, s in enumerate(sizes):
            if held and held + s > most_bytes:
                cuts.append(i)
                held = 0
            held += int(s)
        cuts.append(b.num_rows)
        for a, z in zip(cuts, cuts[1:]):
            yield b.slice(a, z - a)
