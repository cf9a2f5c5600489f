"""Exact duplicates by an extendible-hash index on shared files.

Texts are equal when the same bytes remain after white space is deleted. Tasks first bring the copies in their
own rows together; the texts left go, with their counts, to owner tasks by ranges of the 64-bit key. An owner
inserts them into its extendible hash: a directory of 2^d entries that share buckets, where an overfull bucket
is split by its next bit and the directory doubles when the bucket uses all of its bits. Entries under one key
are chained and told apart by comparing the bytes, which lie in the owner's log of texts. Log, buckets and
directory are files in the shared folder, from which the groups are read back and texts can be looked up.

Edge cases: null text counts as empty, and all empty texts are one group; of rows that agree in text, length
and doc_id one stays; a null doc_id comes after all others; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import batch_of, materialise, open_fs, read_bytes, split_batches, spread_join, text_bytes, work_dir

#: Deleted before texts are compared.
WHITE = b" \t\n\x0b\x0c\r"
_LAST = (1 << 63) - 1  # stands for a null doc_id, which comes last
_REP = pa.schema([("key", pa.int64()), ("body", pa.binary()), ("n_chars", pa.int64()), ("doc_id", pa.int64()), ("rows", pa.int64())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("text_sha256", pa.string())])
_MANIFEST = pa.schema([("owner", pa.int64()), ("stem", pa.string()), ("texts", pa.int64()), ("depth", pa.int64()), ("buckets", pa.int64())])
_GROUP = pa.schema([("text_sha256", pa.string()), ("keep_chars", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
_ENTRY = struct.Struct("<QQIQqqq32s")  # key, log offset, stored bytes, text bytes, code points, doc_id, rows, sha-256


def normalised(text: bytes) -> bytes:
    return text.translate(None, WHITE)


def key_of(body: bytes) -> int:
    return xxhash.xxh3_64_intdigest(body)


class TextLog:
    """Texts one after another, each compressed; segments are closed files, the last is in memory."""

    def __init__(self, stem: str, segment: int = 16 << 20):
        self.stem, self.segment = stem, segment
        self.held, self.n, self.closed = bytearray(), 0, 0
        self.zip, self.unzip = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()

    def add(self, body: bytes) -> tuple[int, int]:
        data, at = self.zip.compress(body), self.closed << 40 | len(self.held)
        self.held += data
        if len(self.held) >= self.segment:
            self.flush()
        return at, len(data)

    def flush(self) -> None:
        fs, at = open_fs(f"{self.stem}.log{self.closed}")
        with fs.open_output_stream(at) as out:
            out.write(bytes(self.held))
        self.held = bytearray()
        self.closed += 1

    def read(self, at: int, n: int) -> bytes:
        segment, at = at >> 40, at & (1 << 40) - 1
        data = bytes(self.held[at : at + n]) if segment == self.closed else read_bytes(f"{self.stem}.log{segment}", at, n)
        return self.unzip.decompress(data)


class Bucket:
    def __init__(self, depth: int):
        self.depth = depth
        self.chains: dict[int, list[list]] = {}


class ExtendibleHash:
    """The index of one owner. A bucket is overfull by its number of keys; a chain isn't bounded."""

    def __init__(self, stem: str, capacity: int = 64, key=key_of):
        self.stem, self.capacity, self.key = stem, capacity, key
        self.depth, self.directory, self.log = 0, [Bucket(0)], TextLog(stem)
        self.texts = 0

    def _split(self, bucket: Bucket) -> None:
        if bucket.depth == self.depth:
            self.directory += self.directory
            self.depth += 1
        bit = bucket.depth
        low, high = Bucket(bit + 1), Bucket(bit + 1)
        for k, chain in bucket.chains.items():
            (high if k >> bit & 1 else low).chains[k] = chain
        first = next(iter(bucket.chains)) & (1 << bit) - 1
        for i in range(first, 1 << self.depth, 1 << bit):
            self.directory[i] = high if i >> bit & 1 else low

    def insert(self, key: int, body: bytes, n_chars: int, doc_id: int, rows: int) -> None:
        bucket = self.directory[key & (1 << self.depth) - 1]
        chain = bucket.chains.setdefault(key, [])
        for e in chain:
            if e[3] == len(body) and self.log.read(e[1], e[2]) == body:
                if (-n_chars, doc_id) < (-e[4], e[5]):
                    e[4:6] = n_chars, doc_id
                e[6] += rows
                return
        chain.append([key, *self.log.add(body), len(body), n_chars, doc_id, rows, hashlib.sha256(body).digest()])
        self.texts += 1
        while len(bucket.chains) > self.capacity and bucket.depth < 40:
            self._split(bucket)
            bucket = self.directory[key & (1 << self.depth) - 1]

    def close(self) -> int:
        """Write the last of the log, the buckets and the directory; the number of buckets."""
        self.log.flush()
        numbers: dict[int, int] = {}
        places = []
        fs, at = open_fs(f"{self.stem}.buckets")
        with fs.open_output_stream(at) as out:
            where = 0
            for b in self.directory:
                if id(b) not in numbers:
                    numbers[id(b)] = len(places)
                    data = b"".join(_ENTRY.pack(*e) for k in sorted(b.chains) for e in b.chains[k])
                    out.write(data)
                    places.append((where, len(data)))
                    where += len(data)
        fs, at = open_fs(f"{self.stem}.directory")
        with fs.open_output_stream(at) as out:
            out.write(struct.pack("<II", self.depth, len(places)) + b"".join(struct.pack("<QQ", *p) for p in places))
            out.write(np.array([numbers[id(b)] for b in self.directory], "<u4").tobytes())
        return len(places)


class IndexReader:
    """The closed index of one owner."""

    def __init__(self, stem: str):
        self.stem, self.log = stem, TextLog(stem)
        self.log.closed = 1 << 30
        data = read_bytes(f"{stem}.directory")
        self.depth, n = struct.unpack("<II", data[:8])
        self.places = [struct.unpack("<QQ", data[8 + 16 * i : 24 + 16 * i]) for i in range(n)]
        self.directory = np.frombuffer(data, "<u4", offset=8 + 16 * n)

    def bucket(self, number: int) -> list[tuple]:
        at, n = self.places[number]
        return list(_ENTRY.iter_unpack(read_bytes(f"{self.stem}.buckets", at, n))) if n else []

    def find(self, text: bytes, key=key_of) -> tuple | None:
        """The entry (…, code points, doc_id, rows, sha-256) of a text equal to this one."""
        body = normalised(text)
        k = key(body)
        for e in self.bucket(int(self.directory[k & (1 << self.depth) - 1])):
            if e[0] == k and e[3] == len(body) and self.log.read(e[1], e[2]) == body:
                return e
        return None


def _owner_bits(spark) -> int:
    """Owners are a power of two, at least the number of shuffle partitions."""
    return max(3, int(spark.conf.get("spark.sql.shuffle.partitions")).bit_length())


def build_index(docs: DataFrame, folder: str | None = None, capacity: int = 64) -> DataFrame:
    """Index the distinct texts; returns the manifest (owner, stem, texts, depth, buckets), a written table."""
    spark = docs.sparkSession
    folder = folder or work_dir(spark, "exact-index")
    bits = _owner_bits(spark)

    def representatives(batches):
        held: dict[bytes, list] = {}
        size = 0
        for b in split_batches(batches):
            for doc_id, n_chars, text in zip(b.column("doc_id").to_pylist(), b.column("n").to_pylist(), b.column("text").to_pylist(), strict=True):
                body, doc_id = normalised(text), _LAST if doc_id is None else doc_id
                got = held.get(body)
                if got is None:
                    held[body] = [n_chars, doc_id, 1]
                    size += len(body)
                else:
                    if (-n_chars, doc_id) < (-got[0], got[1]):
                        got[:2] = n_chars, doc_id
                    got[2] += 1
                if size > 24 << 20:
                    yield from emit(held)
                    held, size = {}, 0
        yield from emit(held)

    def emit(held):
        items = list(held.items())
        for i in range(0, len(items), 500):
            some = items[i : i + 500]
            keys = np.fromiter((key_of(k) for k, _ in some), np.uint64, len(some)).view(np.int64)
            yield batch_of(_REP, pa.array(keys), [k for k, _ in some], *([v[j] for _, v in some] for j in range(3)))

    def own(batches):
        indexes: dict[int, ExtendibleHash] = {}
        for b in batches:
            keys = b.column("key").to_numpy(zero_copy_only=False).view(np.uint64).tolist()
            for key, body, n_chars, doc_id, rows in zip(keys, *(b.column(c).to_pylist() for c in ("body", "n_chars", "doc_id", "rows")), strict=True):
                owner = key >> (64 - bits)
                if owner not in indexes:
                    indexes[owner] = ExtendibleHash(f"{folder}/owner-{owner:08d}-{uuid.uuid4().hex}", capacity)
                indexes[owner].insert(key, body, n_chars, doc_id, rows)
        for owner, x in sorted(indexes.items()):
            yield batch_of(_MANIFEST, [owner], [x.stem], [x.texts], [x.depth], [x.close()])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n"), text_bytes().alias("text"))
    reps = rows.mapInArrow(representatives, "key long, body binary, n_chars long, doc_id long, rows long")
    owned = reps.repartition(1 << bits, F.shiftrightunsigned("key", 64 - bits)).mapInArrow(own, "owner long, stem string, texts long, depth long, buckets long")
    return materialise(owned, "exact-manifest")


def read_groups(manifest: DataFrame) -> DataFrame:
    """(text_sha256, keep_chars, keep_id, group_size) of every distinct text, from the index files."""

    def read(batches):
        for b in batches:
            for stem in b.column("stem").to_pylist():
                index = IndexReader(stem)
                for k in range(len(index.places)):
                    if e := index.bucket(k):
                        yield batch_of(_GROUP, [x[7].hex() for x in e], [x[4] for x in e], [x[5] for x in e], [x[6] for x in e])

    owners = 1 << _owner_bits(manifest.sparkSession)
    return manifest.repartition(owners, "owner", "stem").mapInArrow(read, "text_sha256 string, keep_chars long, keep_id long, group_size long")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, text_sha256) of every row."""

    def digest(batches):
        for b in split_batches(batches):
            yield batch_of(_DIGEST, b.column("doc_id"), b.column("n"), [hashlib.sha256(normalised(t)).hexdigest() for t in b.column("text").to_pylist()])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n"), text_bytes().alias("text"))
    return rows.mapInArrow(digest, "doc_id long, n_chars long, text_sha256 string")


def _marked(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows with doc_id, n_chars, text_sha256 get keep_id, group_size, kept. Rows alike in all three are
    numbered, so that one of them stays. Rows of a large group meet its entry of the index in several tasks."""
    nth = F.row_number().over(Window.partitionBy("text_sha256", "doc_id", "n_chars").orderBy(F.lit(1)))
    known = F.coalesce("doc_id", F.lit(_LAST))
    return (
        spread_join(rows.withColumn("_nth", nth), groups, "text_sha256", "doc_id")
        .withColumn("kept", (F.col("_nth") == 1) & (known == F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars")))
        .withColumn("keep_id", F.when(F.col("keep_id") < _LAST, F.col("keep_id")))
    )


def exact_duplicates(docs: DataFrame, capacity: int = 64) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = read_groups(build_index(docs, capacity=capacity))
    return _marked(digests(docs), groups).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def without_copies(docs: DataFrame, capacity: int = 64) -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows meet the groups' digests by digest, doc_id and
    length, which spreads a large group, and rows alike in all three are numbered where they lie; so whole rows
    are shuffled once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    body = F.sha2(F.regexp_replace(text, "[ \\t\\n\\x0B\\f\\r]+", ""), 256)
    key = ["text_sha256", "keep_id", "keep_chars"]
    rows = docs.select(body.alias(key[0]), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias(key[1]), F.length(text).cast("long").alias(key[2]), F.struct("*").alias("row"))
    groups = read_groups(build_index(docs, capacity=capacity)).select(*key)
    kept = rows.join(groups.hint("merge"), key, "left_semi")  # its size can't be estimated, and it grows with the rows
    return kept.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1)))).where("nth = 1").select("row.*")
