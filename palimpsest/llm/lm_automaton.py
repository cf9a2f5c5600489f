"""Language-model scores by a weighted backoff automaton over words.

Spark counts the n-grams of up to ``order`` words in the training texts; all of them are arcs, those seen once
too. The state of up to ``order`` - 1 words has an arc for each word that follows it, weighted by absolute
discounting, and a failure arc, weighted by what the discounts left, to the state without the first of its
words; the last of these is the root, which has an arc for every word, and one for unknown words.
A text is traversed from left to right from the start state: a word's n-grams weigh what the state before it
gives them, through its failure arcs, and those that the automaton holds, with their counts, make up the state
that is carried to the next word. The weights add up to the log-probability. The automaton is kept as sorted
hash arrays in shared files. ``weights`` takes the texts of a batch through the traversal together, an order at
a time, and looks an n-gram up only where the state carried from the word before is in the automaton; ``walk``
is the same traversal written out word by word.

Words are told apart by 64-bit hashes. Edge cases: null or empty texts have the end token alone; a null doc_id
counts as the text "" where rows are held out; rows that repeat count and are scored each; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hash_arrays import PACKED_DDL, Sums, joined, look_up, shard_bits, write_arrays
from .shared import batch_of, mixed, split_batches, text_bytes, work_dir

END, START = np.uint64(xxhash.xxh3_64_intdigest(b"\n end")), np.uint64(xxhash.xxh3_64_intdigest(b"\n start"))
#: The kind of n-grams of k words is k, and that of the words seen after states of k - 1 words is AFTER + k.
AFTER = 100
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def token_hashes(texts: list[bytes] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's end token last, and where each text begins. Each distinct word of the texts
    is hashed once."""
    if not isinstance(texts, pa.Array):
        texts = pa.array(texts, pa.binary())
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.large_string() if pa.types.is_large_binary(texts.type) else pa.string())))
    coded = cut.values.dictionary_encode()
    words = coded.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    hashes = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
    codes = coded.indices.to_numpy()
    some = np.array([w != b"" for w in words], bool)[codes]  # white space at a text's ends leaves empty ones
    ends = np.concatenate([[0], np.cumsum(some)])[cut.offsets.to_numpy()[1:]] + np.arange(len(texts))
    tokens = np.empty(int(some.sum()) + len(texts), np.uint64)
    inner = np.ones(len(tokens), bool)
    inner[ends] = False
    tokens[inner], tokens[ends] = hashes[codes[some]], END
    return tokens, np.concatenate([[0], ends + 1])[: len(texts)].astype(np.int64)


def ngrams(tokens: np.ndarray, starts: np.ndarray, order: int):
    """(k, state, gram, within) for each k from 2 to order: hashes of the k - 1 tokens before each and of these
    with it, and whether they lie in the text, before which the start state counts as one token."""
    place = np.arange(len(tokens)) - np.repeat(starts, np.diff(starts, append=len(tokens)))
    gram = tokens
    for k in range(2, order + 1):
        state = np.empty_like(tokens)
        state[1:] = gram[:-1]
        state[starts] = START
        gram = mixed(state, tokens)
        yield k, state, gram, place >= k - 2


def carried(counts: np.ndarray, starts: np.ndarray, first: float) -> np.ndarray:
    """What the token before each left as the count of its state; ``first`` at the beginning of texts."""
    out = np.empty_like(counts)
    out[1:] = counts[:-1]
    out[starts] = first
    return out


def found_in(manifest: dict | None, keys: np.ndarray, on: np.ndarray) -> np.ndarray:
    """The values of the keys that are on, and 0 for others."""
    out = np.zeros(len(keys))
    out[on] = look_up(manifest, keys[on])
    return out


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1


def train(docs: DataFrame, folder: str, order: int = 3, parts: int = 3) -> dict:
    """The automaton of doc_id, text rows: files and figures, of a size that doesn't grow with the rows."""
    texts, bits = docs.select(text_bytes().alias("text")), shard_bits(docs.sparkSession)

    def counted(part: int):
        """All n-grams whose hashes lie in a range; a range at a time bounds what lies shuffled."""

        def mine(keys):
            return keys[(keys >> np.uint64(61)) * np.uint64(parts) >> np.uint64(3) == part]

        def count(batches):
            sums = {k: Sums(k, bits=bits) for k in range(1, order + 1)}
            for b in split_batches(batches, 4 << 20):
                tokens, starts = token_hashes(b.column("text"))
                yield from sums[1].add(mine(tokens))
                for k, _, gram, within in ngrams(tokens, starts, order):
                    yield from sums[k].add(mine(gram[within]))
            for s in sums.values():
                yield from s.flush()

        return write_arrays(texts.mapInArrow(count, PACKED_DDL), folder, small=tuple(range(1, order + 1)), free=True)

    arcs = joined([counted(part) for part in range(parts)])
    discounts = {}
    for k in range(2, order + 1):
        ones, twos = arcs[k]["n"][:2] if k in arcs else (0, 0)
        discounts[k] = ones / (ones + 2 * twos) if ones and twos else 0.75

    def after(batches):
        """Each occurrence of an arc of count c adds 1 / c to its state: in all, the distinct words after it.
        A state seen once has one, which needs no entry."""
        sums = {k: Sums(AFTER + k, bits=bits) for k in range(2, order + 1)}
        for b in split_batches(batches, 4 << 20):
            tokens, starts = token_hashes(b.column("text"))
            often = np.ones(len(tokens), bool)
            for k, state, gram, within in ngrams(tokens, starts, order):
                c = found_in(arcs.get(k), gram, within & often)
                on = c > 0
                yield from sums[k].add(state[on], 1 / c[on])
                often = carried(c, starts, 0.0) > 1
        for s in sums.values():
            yield from s.flush()

    states = write_arrays(texts.mapInArrow(after, PACKED_DDL), folder, free=True)
    words = arcs.get(1)
    return {
        "order": order, "arcs": arcs, "after": {k: states.get(AFTER + k) for k in range(2, order + 1)}, "discounts": discounts,
        "total": words["total"] if words else 0.0, "types": words["keys"] if words else 0, "texts": float(docs.count()),
    }


def weights(model: dict, tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token its count, log10 of its root arc, and log10 of the path taken from the state before it."""
    c = counts = look_up(model["arcs"].get(1), tokens)
    root = path = (c + 0.5) / (model["total"] + 0.5 * (model["types"] + 1))
    for k, state, gram, within in ngrams(tokens, starts, model["order"]):
        of_state = carried(counts, starts, model["texts"] if k == 2 else 0.0)
        live = within & (of_state > 0)
        counts = found_in(model["arcs"].get(k), gram, live)
        distinct = np.where(of_state == 1, 1.0, found_in(model["after"][k], state, live & (of_state > 1)))
        d, whole = model["discounts"][k], np.maximum(of_state, 1)
        path = np.where(live, np.maximum(counts - d, 0) / whole + d * distinct / whole * path, path)
    return c, np.log10(root), np.log10(path)


def walk(model: dict, text: bytes) -> float:
    """The log10 probability of a text, one token at a time."""

    def one(manifest: dict | None, key) -> float:
        return float(look_up(manifest, np.array([key], np.uint64))[0])

    tokens, _ = token_hashes([text])
    states, total = [(START, model["texts"])], 0.0
    for t in tokens:
        c = one(model["arcs"].get(1), t)
        p, then = (c + 0.5) / (model["total"] + 0.5 * (model["types"] + 1)), [(t, c)]
        for k, (state, n) in enumerate(states, 2):
            if not n:
                break
            gram = mixed(np.array([state], np.uint64), np.array([t], np.uint64))[0]
            c = one(model["arcs"].get(k), gram)
            d, distinct = model["discounts"][k], one(model["after"][k], state) if n > 1 else 1.0
            p = max(c - d, 0) / n + d * distinct / n * p
            then.append((gram, c))
        states = then[: model["order"] - 1]
        total += math.log10(p)
    return total


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score (the root's arcs alone), score for each row."""

    def scores(batches):
        for b in split_batches(batches, 4 << 20):
            tokens, starts = token_hashes(b.column("text"))
            if len(starts):
                c, base, path = weights(model, tokens, starts)
                yield batch_of(_SCORES, b.column("doc_id"), b.column("held_out"), np.diff(starts, append=len(tokens)), np.add.reduceat((c > 0).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(path, starts))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_bytes().alias("text"))
    return rows.mapInArrow(scores, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def train_and_score(docs: DataFrame) -> DataFrame:
    """Train on the rows that aren't held out, and score all."""
    model = train(docs.where(~held_out()), work_dir(docs.sparkSession, "automaton"))
    return score(docs, model).withColumn("train_tokens", F.lit(int(model["total"])).cast("long"))
