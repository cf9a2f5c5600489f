"""Packing of token ids into sequences: first-fit decreasing with a tournament tree, in randomised groups.

Documents are dealt to groups at random by a hash, so that a group's size doesn't follow any key. Within a
group, full sequences are cut from long documents first; the remaining pieces go, longest first, to the first
sequence with room, which a tournament tree over the sequences' free room finds in logarithmic time. A sequence
left with more than ``slack`` free ids is cut into sequences of a power of two, which take no padding.

Edge cases: a null or empty text has the end id alone; rows that repeat a document are packed each; a null
doc_id is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batch_of, split_batches
from .token_ids import encoder

_TOKENS = pa.schema([("grp", pa.int64()), ("ord", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary())])
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class TournamentTree:
    """Free room of bins in a complete binary tree whose inner nodes hold the larger of two children."""

    def __init__(self, room: int):
        self.room, self.size, self.bins = room, 1, 0
        self.tree = [0, 0]

    def _grow(self) -> None:
        leaves = self.tree[self.size : self.size + self.bins] + [0] * (2 * self.size - self.bins)
        self.size *= 2
        self.tree = [0] * self.size + leaves
        for i in range(self.size - 1, 0, -1):
            self.tree[i] = max(self.tree[2 * i], self.tree[2 * i + 1])

    def _set(self, leaf: int, value: int) -> None:
        t, i = self.tree, leaf + self.size
        t[i] = value
        while i > 1:
            i >>= 1
            new = max(t[2 * i], t[2 * i + 1])
            if t[i] == new:
                break
            t[i] = new

    def place(self, length: int) -> int:
        """The first bin with room for it, or a new one; the bin's room is taken."""
        if self.tree[1] < length:
            if self.bins == self.size:
                self._grow()
            self.bins += 1
            self._set(self.bins - 1, self.room - length)
            return self.bins - 1
        i = 1
        while i < self.size:
            i = 2 * i if self.tree[2 * i] >= length else 2 * i + 1
        self._set(i - self.size, self.tree[i] - length)
        return i - self.size


def pack(lengths: list[int], room: int, slack: int) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of pieces (document, start, length)."""
    out, rest = [], []
    for k, n in enumerate(lengths):
        out += [[(k, s, room)] for s in range(0, n - room + 1, room)]
        if n % room:
            rest.append((k, n - n % room, n % room))
    tree, bins = TournamentTree(room), []
    for piece in sorted(rest, key=lambda p: (-p[2], p[0])):
        at = tree.place(piece[2])
        if at == len(bins):
            bins.append([])
        bins[at].append(piece)
    for b in bins:
        used = sum(p[2] for p in b)
        if room - used <= slack or used & used - 1 == 0:
            out.append(b)
            continue
        pieces = b[::-1]
        for bit in reversed(range(used.bit_length())):
            want, sequence = used & 1 << bit, []
            while want:
                k, s, n = pieces.pop()
                take = min(n, want)
                sequence.append((k, s, take))
                want -= take
                if take < n:
                    pieces.append((k, s + take, n - take))
            if sequence:
                out.append(sequence)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int = 2, room: int = 4096, group_docs: int = 2048, slack: int = 32, seed: int = 7) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset); ids as little-endian unsigned
    32-bit integers. A group has about group_docs documents, however many there are."""
    groups = max(1, -(-docs.count() // group_docs))

    def tokens(batches):
        enc, row, part = encoder(tokenizer, kind), 0, TaskContext.get().partitionId()
        end = np.array([end_id], enc.dtype).tobytes()
        for b in split_batches(batches, 1 << 20):
            doc_ids = b.column("doc_id").to_pylist()
            ids = [x + end for x in enc.encode(b.column("text").to_pylist())]
            order = [xxhash.xxh3_64_intdigest(f"{d} {part} {row + i}", seed) >> 1 for i, d in enumerate(doc_ids)]
            row += len(doc_ids)
            yield batch_of(_TOKENS, [o % groups for o in order], order, doc_ids, ids)

    def pack_group(table: pa.Table) -> pa.Table:
        w = encoder(tokenizer, kind).dtype.itemsize
        table = table.sort_by("ord")
        grp, doc_ids, ids = table.column("grp")[0].as_py(), table.column("doc_id").to_pylist(), table.column("ids").to_pylist()
        lengths, rows = [len(x) // w for x in ids], []
        for q, sequence in enumerate(pack(lengths, room, slack)):
            at = 0
            for k, s, n in sequence:
                piece = np.frombuffer(ids[k], f"<u{w}", n, s * w).astype("<u4").tobytes()
                rows.append((doc_ids[k], s, n, piece, lengths[k], grp << 32 | q, at))
                at += n
        return pa.Table.from_batches([batch_of(_PIECES, *zip(*rows))])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(tokens, "grp long, ord long, doc_id long, ids binary").groupBy("grp").applyInArrow(pack_group, PIECES)
