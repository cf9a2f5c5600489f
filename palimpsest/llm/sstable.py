"""Token-id output as sorted-string-table shards.

A shard holds documents in ascending key order in blocks: keys of a block are stored as the length shared with
the key before and the rest (prefix compression), then the ids of its documents; a block is compressed as one.
A sparse index has the last key of each block, a Bloom filter has all keys, and a fixed footer says where these
lie. A lookup asks the filter, finds the block by binary search in the index and the key within the block.

Edge cases: a null or empty text has the end id alone; a null key comes before all others; rows that repeat a
key are all kept, one after another; an empty table makes no shard and reads as no rows; other columns are
ignored.
"""

from __future__ import annotations

import bisect
import struct
import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batch_of, materialise, open_fs, read_bytes, split_batches, work_dir
from .token_ids import encoder

MAGIC = b"PLMSST1\n"
_FOOTER = struct.Struct("<QQQQQQBB6x8s")  # index at, filter at, filter bytes, rows, ids, blocks, id width, hashes, magic
_HASHES, _BITS_A_KEY = 7, 10
_MANIFEST = pa.schema([("part", pa.int64()), ("path", pa.string()), ("n_rows", pa.int64()), ("n_ids", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def key_of(doc_id: int | None) -> bytes:
    """Nine bytes that sort as null, then the numbers."""
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def doc_id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:9])[0] - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _unvarint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bits(key: bytes, size: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % size for i in range(_HASHES)]


class ShardWriter:
    """Takes documents in ascending key order; holds a block, the index and 8 bytes for each key."""

    def __init__(self, out, width: int, block_bytes: int = 1 << 16):
        self.out, self.width, self.block_bytes = out, width, block_bytes
        self.at = self.rows = self.ids = 0
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self._new()

    def _new(self) -> None:
        self.entries, self.values, self.before, self.held, self.count = bytearray(), [], b"", 0, 0

    def add(self, key: bytes, ids: bytes) -> None:
        shared = 0
        while shared < min(len(self.before), len(key)) and self.before[shared] == key[shared]:
            shared += 1
        self.entries += _varint(shared) + _varint(len(key) - shared) + _varint(len(ids) // self.width) + key[shared:]
        self.values.append(ids)
        self.before, self.held, self.count = key, self.held + len(ids), self.count + 1
        self.keys.append(key)
        self.rows += 1
        self.ids += len(ids) // self.width
        if self.held + len(self.entries) >= self.block_bytes:
            self._close_block()

    def _close_block(self) -> None:
        if not self.count:
            return
        data = zstandard.ZstdCompressor(level=1).compress(struct.pack("<II", self.count, len(self.entries)) + bytes(self.entries) + b"".join(self.values))
        self.out.write(data)
        self.index.append((self.before, self.at, len(data)))
        self.at += len(data)
        self._new()

    def close(self) -> None:
        self._close_block()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QQ", a, n) for k, a, n in self.index)
        size = max(64, _BITS_A_KEY * len(self.keys))
        bloom = np.zeros(-(-size // 8), np.uint8)
        for k in self.keys:
            for b in _bits(k, size):
                bloom[b >> 3] |= 1 << (b & 7)
        self.out.write(index)
        self.out.write(struct.pack("<Q", size) + bloom.tobytes())
        self.out.write(_FOOTER.pack(self.at, self.at + len(index), 8 + len(bloom), self.rows, self.ids, len(self.index), self.width, _HASHES, MAGIC))
        self.out.close()


class ShardReader:
    """Reads one shard by ranges of bytes; the index and the filter stay in memory."""

    def __init__(self, path: str):
        self.path = path
        fs, at = open_fs(path)
        size = fs.get_file_info(at).size
        index_at, bloom_at, bloom_n, self.rows, self.ids, blocks, self.width, _, magic = _FOOTER.unpack(read_bytes(path, size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a shard of this format")
        index, bloom = read_bytes(path, index_at, bloom_at - index_at), read_bytes(path, bloom_at, bloom_n)
        self.bits, self.bloom = struct.unpack("<Q", bloom[:8])[0], bloom[8:]
        self.last, self.where, i = [], [], 0
        for _ in range(blocks):
            n, i = _unvarint(index, i)
            self.last.append(index[i : i + n])
            self.where.append(struct.unpack("<QQ", index[i + n : i + n + 16]))
            i += n + 16

    def _block(self, k: int):
        data = zstandard.ZstdDecompressor().decompress(read_bytes(self.path, *self.where[k]))
        count, n = struct.unpack("<II", data[:8])
        at, value, key = 8, 8 + n, b""
        for _ in range(count):
            shared, at = _unvarint(data, at)
            rest, at = _unvarint(data, at)
            ids, at = _unvarint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[value : value + ids * self.width]
            value += ids * self.width

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _bits(key, self.bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every row with this key."""
        key, out = key_of(doc_id), []
        if self.may_hold(key):
            for k in range(bisect.bisect_left(self.last, key), len(self.last)):
                found = list(self._block(k))
                keys = [x[0] for x in found]
                a, z = bisect.bisect_left(keys, key), bisect.bisect_right(keys, key)
                out += [np.frombuffer(x[1], f"<u{self.width}") for x in found[a:z]]
                if z < len(keys):
                    break
        return out

    def scan(self):
        for k in range(len(self.last)):
            yield from self._block(k)


def write_shards(docs: DataFrame, tokenizer: str, folder: str | None = None, kind: str = "byte", end_id: int = 0) -> DataFrame:
    """Encode doc_id, text of ``docs`` and write shards in ascending order of doc_id, one for each range.

    Returns the manifest (part, path, n_rows, n_ids), a written table. Every attempt of a task writes a file of
    its own name; the manifest has those of the attempts that counted.
    """
    folder = folder or work_dir(docs.sparkSession, "shards")

    def write(batches):
        enc, writer, path, part = encoder(tokenizer, kind), None, "", TaskContext.get().partitionId()
        end = np.array([end_id], enc.dtype).tobytes()
        for b in split_batches(batches, 1 << 20):
            if writer is None:
                path = f"{folder}/shard-{part:06d}-{uuid.uuid4().hex}.sst"
                fs, at = open_fs(path)
                writer = ShardWriter(fs.open_output_stream(at), enc.dtype.itemsize)
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist()), strict=True):
                writer.add(key_of(doc_id), ids + end)
        if writer:
            writer.close()
            yield batch_of(_MANIFEST, [part], [path], [writer.rows], [writer.ids])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    placed = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return materialise(placed.mapInArrow(write, "part long, path string, n_rows long, n_ids long"), "shards-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) of all shards; ids as little-endian unsigned 32-bit integers,
    start the ids of all rows before. The manifest has a row for each shard, which alone reach the driver."""
    spark, before, rows = manifest.sparkSession, 0, []
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):
        rows.append((r["path"], before))
        before += r["n_ids"]

    def read(batches):
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard, held, out = ShardReader(path), 0, []
                for key, ids in shard.scan():
                    wide = ids if shard.width == 4 else np.frombuffer(ids, f"<u{shard.width}").astype("<u4").tobytes()
                    n = len(ids) // shard.width
                    out.append((doc_id_of(key), start, n, wide))
                    start, held = start + n, held + len(wide)
                    if held > 4 << 20:
                        yield batch_of(_READ, *zip(*out))
                        held, out = 0, []
                if out:
                    yield batch_of(_READ, *zip(*out))

    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not rows:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame(rows, "path string, start long").repartition(len(rows))
    return listed.mapInArrow(read, schema)
