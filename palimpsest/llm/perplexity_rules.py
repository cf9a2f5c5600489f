"""Quality rules with n-gram perplexity from a modified Kneser-Ney model.

The model is over the characters of whole texts, runs of white space being one space: each character and an end mark
is predicted from the ``order`` - 1 characters before it, across words, with as many start marks before the text.
There are two models for each language, from the texts with an even and with an odd hash, and a text is scored by
the one that it isn't part of: else an odd text would be known by its own n-grams. Spark counts the n-grams of the highest order; each lower order counts the
distinct characters before an n-gram, or its occurrences where it holds the beginning of a text. Discounts are those
of modified Kneser-Ney, for one, two, and three or more, by language and order; all orders are interpolated, the
lowest with the uniform distribution over the language's characters and one unknown. The probabilities and the
backoff weights are stored in sorted hash arrays in shared files, which tasks search for a batch's distinct n-grams.

A language's documents have a lower and an upper band for the log perplexity, ``width`` interquartile ranges
below the first and above the third quartile: what is far too predictable or far too odd for its language is
rejected. Documents that fail the base rules count in the model and the bands, as all documents do.

Edge cases: null or empty texts have no words, no perplexity (null) and fail the base rules; a null lang is a
language of its own, and so is any other value; a language whose texts all have even or all odd hashes has one
model; a language of few or like documents gets a band at least ``least`` wide to each side; rows that repeat count each; an empty table gives no rows; other columns are
ignored. Bytes that aren't UTF-8 count as the replacement character. N-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hash_arrays import PAIRS_DDL, look_up, pairs, write_arrays
from .shared import batch_of, join_small, materialise, mixed, split_batches, text_bytes, work_dir

#: Marks beyond all code points.
START, END = 0x110000, 0x110001
PROBABILITY, BACKOFF = 1, 2
#: Characters that the rules count as symbols.
SYMBOLS = b"#*$%&|<>"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_COUNTS = pa.schema([("lang", pa.string()), ("gram", pa.binary()), ("n", pa.int64())])
_RULES = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("log_perplexity", pa.float64())])
_RULES_DDL = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double"


class Codes:
    """Code points of some texts, each text's words with a space between, between start marks and an end mark."""

    def __init__(self, texts: list[list[bytes]], order: int):
        lead = np.full(order - 1, START, np.uint32)
        own = [np.frombuffer(b" ".join(words).decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for words in texts]
        self.order, self.lengths = order, np.array([len(x) + 1 for x in own], np.int64)  # with the end mark
        end = np.array([END], np.uint32)
        self.codes = np.concatenate([y for x in own for y in (lead, x, end)] or [np.empty(0, np.uint32)])
        # places of what is predicted
        begin = np.cumsum(self.lengths) - self.lengths
        self.at = np.arange(int(self.lengths.sum())) + np.repeat(np.arange(1, len(own) + 1) * (order - 1), self.lengths)
        self.begin = begin

    def keys(self) -> np.ndarray:
        """A number for the n-gram of the highest order at each place."""
        c = self.codes.astype(np.uint64)
        with np.errstate(over="ignore"):
            h = c[: len(c) - self.order + 1].copy() if len(c) else c
            for j in range(1, self.order):
                h = h * _STEP + c[j : len(c) - self.order + 1 + j]
                h ^= h >> np.uint64(29)
        return h[self.at - self.order + 1]

    def grams(self, which: np.ndarray) -> np.ndarray:
        """The n-grams, in rows of code points, at the places of these numbers."""
        return self.codes[(self.at[which] - self.order + 1)[:, None] + np.arange(self.order)]


def _binary(grams: np.ndarray) -> pa.Array:
    n, k = grams.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * np.int32(4 * k)).tobytes()), pa.py_buffer(np.ascontiguousarray(grams, np.uint32).tobytes())])


def half_of(words: list[bytes]) -> int:
    """Which of the two models a text is part of; copies that differ in white space alone agree."""
    return xxhash.xxh3_64_intdigest(b" ".join(words)) >> 40 & 1


def name_of(lang: str, half: int) -> str:
    return f"{half}{lang}"


def gram_counts(docs: DataFrame, order: int, most: int = 1_000_000) -> DataFrame:
    """(lang, gram, n) of the n-grams of the highest order over all texts, as code points of four bytes each; lang is
    the name of a model, which says the half also. Tasks add up what they see before it is shuffled."""

    def count(batches):
        held: dict[str, list[tuple]] = {}
        size = 0

        def summed(parts):
            keys, grams, n = (np.concatenate(x) for x in zip(*parts))
            keys, first, at = np.unique(keys, return_index=True, return_inverse=True)
            return keys, grams[first], np.bincount(at, n, len(keys)).astype(np.int64)

        def emit():
            for lang, parts in held.items():
                _, grams, n = summed(parts)
                for i in range(0, len(n), 200_000):
                    yield batch_of(_COUNTS, [lang] * len(n[i : i + 200_000]), _binary(grams[i : i + 200_000]), n[i : i + 200_000])
            held.clear()

        for b in split_batches(batches, 2 << 20):
            split = [t.split() for t in b.column("text").to_pylist()]
            langs = [name_of(x, half_of(w)) for x, w in zip(b.column("lang").to_pylist(), split, strict=True)]
            for lang in {*langs}:
                codes = Codes([w for x, w in zip(langs, split, strict=True) if x == lang and w], order)
                if len(codes.at):
                    keys, first, n = np.unique(codes.keys(), return_index=True, return_counts=True)
                    held.setdefault(lang, []).append((keys, codes.grams(first), n))
                    size += len(keys)
            if size > 2 * most:
                for lang in held:
                    held[lang] = [summed(held[lang])]
                size = sum(len(p[0][0]) for p in held.values())
                if size > most:
                    yield from emit()
                    size = 0
        yield from emit()

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("\0")).alias("lang"), text_bytes().alias("text"))
    return rows.mapInArrow(count, "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def seed_of(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang))


def hashes_of(seed, grams: np.ndarray) -> np.ndarray:
    """Hashes of n-grams in rows of code points, the last first, so that an n-gram's hash goes on from that of the
    n-gram without its first character. ``seed`` is a language's, or one for each row."""
    h = np.full(len(grams), seed, np.uint64) if np.ndim(seed) == 0 else seed
    for j in reversed(range(grams.shape[1])):
        h = mixed(h, grams[:, j].astype(np.uint64))
    return h


def _hashed(kind: int):
    def hashes(batches):
        seeds: dict[str, np.uint64] = {}
        for b in batches:
            langs, grams, values = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_numpy(zero_copy_only=False)
            seed = np.array([seeds[x] if x in seeds else seeds.setdefault(x, seed_of(x)) for x in langs], np.uint64)
            size = np.array([len(g) for g in grams])
            for n in np.unique(size).tolist():
                at = np.flatnonzero(size == n)
                rows = np.frombuffer(b"".join(grams[i] for i in at.tolist()), np.uint32).reshape(len(at), n // 4)
                yield from pairs(kind, hashes_of(seed[at], rows), values[at])

    return hashes


def discounts_of(level: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3) of modified Kneser-Ney from the counts of counts, held where these say nothing."""
    counted = level.groupBy("lang").agg(*(F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)))
    n1, n2, n3, n4 = (F.col(f"n{i}") for i in (1, 2, 3, 4))
    y = F.when((n1 > 0) & (n2 > 0), n1 / (n1 + 2 * n2)).otherwise(0.5)
    raw = (F.when(n1 > 0, 1 - 2 * y * n2 / n1).otherwise(0.5), F.when(n2 > 0, 2 - 3 * y * n3 / n2).otherwise(1.0), F.when(n3 > 0, 3 - 4 * y * n4 / n3).otherwise(1.5))
    return counted.select("lang", *(F.least(F.greatest(x, F.lit(0.05)), F.lit(0.95 * i)).alias(f"d{i}") for i, x in enumerate(raw, 1)))


def train(docs: DataFrame, folder: str, order: int = 5) -> dict:
    """The arrays of log10 probabilities by (language, n-gram), the empty one's being that of any character where
    nothing is known, and of log10 backoff weights by (language, context)."""
    levels = {order: materialise(gram_counts(docs, order).select("lang", "gram", F.col("n").alias("c"), "n"), "ngrams")}
    start = F.lit(np.array([START], "<u4").tobytes())
    for k in range(order - 1, 0, -1):
        inner = levels[k + 1].select("lang", F.expr("substring(gram, 5)").alias("gram"), "n").groupBy("lang", "gram").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
        levels[k] = materialise(inner.select("lang", "gram", F.when(F.substring("gram", 1, 4) == start, F.col("n")).otherwise(F.col("c")).alias("c"), "n"), f"level{k}")
    lower, probabilities, weights = None, [], []
    for k in range(1, order + 1):
        rows = join_small(levels[k].select("lang", "gram", "c"), materialise(discounts_of(levels[k]), "discounts"), "lang")
        w = Window.partitionBy("lang", "context")  # as many rows as characters can follow a context
        level = rows.withColumn("context", F.expr("substring(gram, 1, length(gram) - 4)")).withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        if k == 1:
            level = level.withColumn("below", 1 / (F.count("*").over(w) + 1))
        else:
            level = level.withColumn("suffix", F.expr("substring(gram, 5)")).join(lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below")), ["lang", "suffix"])
        level = level.withColumn("all", F.sum("c").over(w)).withColumn("gamma", F.sum("d").over(w) / F.col("all"))
        level = level.withColumn("p", (F.col("c") - F.col("d")) / F.col("all") + F.col("gamma") * F.col("below"))
        lower = materialise(level.select("lang", "gram", "context", "p", "gamma", "below"), f"smoothed{k}")
        probabilities.append(lower.select("lang", "gram", F.log10("p").alias("v")))
        weights.append(lower.groupBy("lang", "context").agg(F.log10(F.min("gamma")).alias("v")))
        if k == 1:
            probabilities.append(lower.groupBy("lang").agg(F.log10(F.min("below")).alias("v")).select("lang", F.lit(b"").alias("gram"), "v"))
    tables = []
    for kind, some in ((PROBABILITY, probabilities), (BACKOFF, weights)):
        one = some[0]
        for x in some[1:]:
            one = one.union(x)
        tables.append(one.mapInArrow(_hashed(kind), PAIRS_DDL))
    # nothing is summed here, as every key comes once
    found = write_arrays(tables[0].unionByName(tables[1]), folder)
    return {"order": order, "p": found.get(PROBABILITY), "w": found.get(BACKOFF)}


def gram_log10(model: dict, lang: str, grams: np.ndarray) -> np.ndarray:
    """The log10 probability of the last character of each n-gram after the others."""
    k, seed = model["order"], seed_of(lang)
    total, left = np.zeros(len(grams)), np.arange(len(grams))
    while len(left):
        some = grams[left, len(grams[0]) - k :]
        p = look_up(model["p"], hashes_of(seed, some), np.nan)
        hit = ~np.isnan(p)
        total[left[hit]] += p[hit]
        left, some = left[~hit], some[~hit]
        if not k:
            break
        if len(left):
            total[left] += look_up(model["w"], hashes_of(seed, some[:, :-1]), 0.0)
        k -= 1
    return total


def has_model(model: dict, lang: str) -> bool:
    return not np.isnan(look_up(model["p"], np.array([seed_of(lang)]), np.nan)[0])


def text_log10(model: dict, lang: str, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The log10 probability of each text, given by its words, and the number of what was predicted."""
    codes = Codes(texts, model["order"])
    if not len(codes.at):
        return np.zeros(len(texts)), codes.lengths
    _, first, at = np.unique(codes.keys(), return_index=True, return_inverse=True)
    return np.add.reduceat(gram_log10(model, lang, codes.grams(first))[at], codes.begin), codes.lengths


def repeated_words(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each text, its words that lie in a window of three found twice or more in the text."""
    n = len(hashes)
    if n < 3:
        return np.zeros(len(starts), np.int64)
    text = np.repeat(np.arange(len(starts)), np.diff(starts, append=n))
    at = np.flatnonzero(text[2:] == text[:-2])
    key = mixed(mixed(mixed(hashes[at], hashes[at + 1]), hashes[at + 2]), text[at].astype(np.uint64))
    order = np.argsort(key)
    ranked = key[order]
    same = np.flatnonzero(ranked[1:] == ranked[:-1])
    twice = at[np.unique(np.concatenate([order[same], order[same + 1]]))]
    covered = np.zeros(n, np.int64)
    for i in range(3):
        covered[twice + i] = 1
    out = np.bincount(text[covered > 0], minlength=len(starts))
    return out.astype(np.int64)


def measured(docs: DataFrame, model: dict) -> DataFrame:
    """The base counts and the log10 perplexity of each row."""

    def rules(batches):
        digest = xxhash.xxh3_64_intdigest
        for b in split_batches(batches, 2 << 20):
            langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
            split = [t.split() for t in texts]
            counts = np.array([len(w) for w in split], np.int64)
            starts = np.cumsum(counts) - counts
            hashes = np.array([h for w in split for h in map(digest, w)], np.uint64)
            filled = counts > 0
            repeat = np.zeros(len(texts), np.int64)
            repeat[filled] = repeated_words(hashes, starts[filled])
            log: list[float | None] = [None] * len(texts)
            models = [name_of(x, 1 - half_of(w)) for x, w in zip(langs, split, strict=True)]
            for lang in {*models}:
                mine = [i for i, x in enumerate(models) if x == lang and split[i]]
                lang = lang if has_model(model, lang) else name_of(lang[1:], 1 - int(lang[0]))
                for i, total, n in zip(mine, *(x.tolist() for x in text_log10(model, lang, [split[i] for i in mine])), strict=True):
                    log[i] = -total / n
            rows = []
            for t in texts:
                solid = t.translate(None, b" \t\n\x0b\x0c\r")
                lines = [x for x in t.split(b"\n") if x and not x.isspace()]
                rows.append((len(solid.decode("utf-8", "replace")), len(t) - len(t.translate(None, SYMBOLS)), len(lines) - len({*lines})))
            chars, symbols, lines = zip(*rows) if rows else ((), (), ())
            yield batch_of(_RULES, b.column("doc_id"), b.column("lang"), counts, chars, symbols, lines, repeat, log)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("\0")).alias("lang"), text_bytes().alias("text"))
    return rows.mapInArrow(rules, _RULES_DDL)


def quality_rules(docs: DataFrame, order: int = 5, width: float = 3.0, least: float = 0.1, min_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """The base counts, base_failed, log_perplexity, lower, upper and kept of each row."""
    model = train(docs, work_dir(docs.sparkSession, "perplexity"), order)
    rows = materialise(measured(docs, model), "rules")
    quartiles = rows.where("n_words > 0").groupBy("lang").agg(F.percentile_approx("log_perplexity", [0.25, 0.75], F.lit(10_000)).alias("q"))
    spread = F.greatest(width * (F.col("q")[1] - F.col("q")[0]), F.lit(least))
    bands = materialise(quartiles.select("lang", (F.col("q")[0] - spread).alias("lower"), (F.col("q")[1] + spread).alias("upper")), "bands")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    inside = F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(False))
    return join_small(rows, bands, "lang").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "log_perplexity", "lower", "upper", (~failed & inside).alias("kept"))
