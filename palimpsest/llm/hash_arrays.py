"""Sorted arrays of 64-bit hashes with a value each, in files of the shared folder, dealt by the hashes' top bits.

Tables of n-grams grow with the corpus, so that they are neither broadcast nor held by the driver: a task maps
the files and finds a batch's hashes by binary search, sorted so that the search moves forward through a file.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import batch_of, kept_in_worker, mapped, write_bytes

_MANIFEST = pa.schema([("kind", pa.int32()), ("shard", pa.int64()), ("path", pa.string()), ("kept", pa.int64()), ("total", pa.float64()), ("keys", pa.int64()), *((f"n{i}", pa.int64()) for i in (1, 2, 3, 4))])
PAIRS = pa.schema([("kind", pa.int32()), ("hash", pa.int64()), ("value", pa.float64())])
PAIRS_DDL = "kind int, hash long, value double"
#: Many pairs of a kind and a shard in one row: a byte that says whether values take one byte, the hashes, the values.
PACKED = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("data", pa.binary())])
PACKED_DDL = "kind int, shard int, data binary"
_MERGE_AT = 4_000_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, ascending, with the sum of its values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values, first)


def pairs(kind: int, keys: np.ndarray, values: np.ndarray, rows: int = 200_000):
    for i in range(0, len(keys), rows):
        k, v = keys[i : i + rows], values[i : i + rows]
        yield batch_of(PAIRS, pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(v.astype(np.float64)))


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, ascending, with the times it occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.diff(first, append=len(keys)).astype(np.float64)


def packed(kind: int, keys: np.ndarray, values: np.ndarray, bits: int, most: int = 200_000):
    """Ascending keys with their values as rows for each shard, so that few rows are shuffled."""
    bounds = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist() + [len(keys)]
    for shard, (a, z) in enumerate(zip(bounds, bounds[1:])):
        for i in range(a, z, most):
            k, v = keys[i : min(i + most, z)], values[i : min(i + most, z)]
            byte = bool((v < 256).all() and (v == np.floor(v)).all())
            yield batch_of(PACKED, [kind], [shard], [bytes([byte]) + k.tobytes() + v.astype(np.uint8 if byte else "<f8").tobytes()])


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = (len(data) - 1) // (9 if data[0] else 16)
    return np.frombuffer(data, np.uint64, n, 1), np.frombuffer(data, np.uint8 if data[0] else "<f8", n, 1 + 8 * n).astype(np.float64)


class Sums:
    """Sums by key, or counts of keys that come without values, of what a task sees, given out whenever many keys are
    held: as pairs, or with ``bits`` packed for shards by that many bits."""

    def __init__(self, kind: int, most: int = _MERGE_AT, bits: int = 0):
        self.kind, self.most, self.bits, self.held, self.n = kind, most, bits, [], 0

    def add(self, keys: np.ndarray, values: np.ndarray | None = None):
        self.held.append((keys,) if values is None else (keys, values))
        self.n += len(keys)
        if self.n >= self.most:
            yield from self.flush()

    def flush(self):
        if self.held:
            columns = [np.concatenate(x) for x in zip(*self.held)]
            keys, values = counted(*columns) if len(columns) == 1 else summed(*columns)
            yield from packed(self.kind, keys, values, self.bits) if self.bits else pairs(self.kind, keys, values)
        self.held, self.n = [], 0


def shard_bits(spark: SparkSession) -> int:
    """The top bits of hashes by which arrays are dealt."""
    return max(3, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def write_arrays(rows: DataFrame, folder: str, least: dict[int, float] | None = None, small: tuple[int, ...] = (), free: bool = False) -> dict:
    """Sum ``rows`` (kind, hash, value; or packed) by kind and hash and write each kind's arrays, keys with a sum below
    least[kind] left out. Sums of the ``small`` kinds are whole numbers, mostly below 255, and take a byte each;
    others lie apart with their places. With ``free``, what was shuffled goes once the arrays are written. Returns for each kind its files and figures over all keys: total, keys, and n1 to n4,
    the keys with a sum of 1 to 4. The driver gets one row for each kind and file."""
    spark, least = rows.sparkSession, least or {}
    bits, in_packs = shard_bits(spark), "data" in rows.columns

    def some_of(b):
        """(kind, shard), keys and values of a batch."""
        if in_packs:
            for kind, shard, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield (kind, shard), *unpacked(data)
            return
        kinds = b.column(0).to_numpy(zero_copy_only=False)
        keys = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        values = b.column(2).to_numpy(zero_copy_only=False)
        places = keys >> np.uint64(64 - bits)
        for kind in np.unique(kinds).tolist():
            for shard in np.unique(places[kinds == kind]).tolist():
                mine = (kinds == kind) & (places == shard)
                yield (kind, shard), keys[mine], values[mine]

    def own(batches):
        held: dict[tuple[int, int], list] = {}
        sizes: dict[tuple[int, int], int] = {}
        for b in batches:
            for at, keys, values in some_of(b):
                held.setdefault(at, []).append((keys, values))
                sizes[at] = sizes.get(at, 0) + len(keys)
                if sizes[at] > _MERGE_AT and len(held[at]) > 1:
                    held[at] = [summed(*(np.concatenate(x) for x in zip(*held[at])))]
                    sizes[at] = len(held[at][0][0]) // 2
        for (kind, shard), some in sorted(held.items()):
            keys, values = summed(*(np.concatenate(x) for x in zip(*some)))
            counts = [int((values == i).sum()) for i in (1, 2, 3, 4)]
            stay = values >= least[kind] if kind in least else slice(None)
            path = f"{folder}/kind{kind}-{shard:06d}-{uuid.uuid4().hex}.arrays"
            kept = keys[stay]
            if kind in small:
                v = values[stay]
                big = np.flatnonzero(v >= 255)
                write_bytes(path, kept.tobytes(), big.astype("<i8").tobytes(), v[big].astype("<f8").tobytes(), np.minimum(v, 255).astype(np.uint8).tobytes())
            else:
                write_bytes(path, kept.tobytes(), values[stay].astype("<f8").tobytes())
            yield batch_of(_MANIFEST, [kind], [shard], [path], [len(kept)], [float(values.sum())], [len(keys)], *([c] for c in counts))

    ddl = "kind int, shard long, path string, kept long, total double, keys long, n1 long, n2 long, n3 long, n4 long"
    before = spark.conf.get(_CLEANUP, None)
    if free:
        spark.conf.set(_CLEANUP, "true")
    try:
        shard = F.col("shard") if in_packs else F.shiftrightunsigned("hash", 64 - bits).cast("int")
        manifest = rows.repartitionById(1 << bits, shard).mapInArrow(own, ddl).collect()
    finally:
        if free:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out: dict = {}
    for r in manifest:
        m = out.setdefault(r["kind"], {"bits": bits, "small": r["kind"] in small, "files": {}, "total": 0.0, "keys": 0, "n": [0, 0, 0, 0]})
        m["files"][r["shard"]] = (r["path"], r["kept"])
        m["total"] += r["total"]
        m["keys"] += r["keys"]
        m["n"] = [a + r[f"n{i}"] for i, a in enumerate(m["n"], 1)]
    return out


def joined(parts: list[dict]) -> dict:
    """One manifest of several whose keys lie in different ranges of shards."""
    out: dict = {}
    for part in parts:
        for kind, m in part.items():
            o = out.setdefault(kind, m | {"files": {}, "total": 0.0, "keys": 0, "n": [0, 0, 0, 0]})
            o["files"] |= m["files"]
            o["total"] += m["total"]
            o["keys"] += m["keys"]
            o["n"] = [a + b for a, b in zip(o["n"], m["n"])]
    return out


class OpenFiles:
    """Arrays of the files of one folder. Files that are mapped cost nothing here; of those read, the last ones
    used that hold at most ``most_bytes`` are kept."""

    def __init__(self, most_bytes: int = 128 << 20):
        self.files: OrderedDict[str, tuple[np.ndarray, ...]] = OrderedDict()
        self.most_bytes, self.held = most_bytes, 0

    def get(self, path: str, n: int, small: bool) -> tuple[np.ndarray, ...]:
        """Keys and values; of small values also the places and values of those that a byte doesn't hold."""
        if path in self.files:
            self.files.move_to_end(path)
            return self.files[path]
        data = mapped(path)
        if small and n:
            m = (len(data) - 9 * n) // 16
            found = (np.frombuffer(data, np.uint64, n), np.frombuffer(data, np.uint8, n, 8 * n + 16 * m), np.frombuffer(data, "<i8", m, 8 * n), np.frombuffer(data, "<f8", m, 8 * n + 8 * m))
        else:
            found = (np.frombuffer(data, np.uint64, n), np.frombuffer(data, "<f8", n, 8 * n)) if n else (np.empty(0, np.uint64), np.empty(0))
        self.files[path] = found
        self.held += len(data) if isinstance(data, bytes) else 0
        while self.held > self.most_bytes and len(self.files) > 1:
            _, old = self.files.popitem(last=False)
            self.held -= sum(a.nbytes for a in old)
        return found


def look_up(manifest: dict | None, keys: np.ndarray, missing: float = 0.0) -> np.ndarray:
    """The value of each hash, or ``missing``."""
    if not manifest or not len(keys):
        return np.full(len(keys), missing)
    order = np.argsort(keys)
    ranked = keys[order]
    found = np.full(len(keys), missing)
    bounds = np.searchsorted(ranked, np.arange(1 << manifest["bits"], dtype=np.uint64) << np.uint64(64 - manifest["bits"]))
    bounds = np.append(bounds, len(ranked))
    files: OpenFiles | None = None
    for shard, (path, n) in manifest["files"].items():
        a, z = bounds[shard], bounds[shard + 1]
        if a < z and n:
            files = files or kept_in_worker(("arrays", path.rpartition("/")[0]), OpenFiles)
            have, values, *apart = files.get(path, n, manifest.get("small", False))
            at = np.minimum(np.searchsorted(have, ranked[a:z]), n - 1)
            hit = have[at] == ranked[a:z]
            part = np.full(z - a, missing)
            part[hit] = got = values[at[hit]].astype(np.float64)
            if apart and (got == 255).any():
                big = at[hit][got == 255]
                got[got == 255] = apart[1][np.searchsorted(apart[0], big)]
                part[hit] = got
            found[a:z] = part
    out = np.empty(len(keys))
    out[order] = found
    return out
