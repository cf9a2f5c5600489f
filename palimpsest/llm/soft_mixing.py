"""Mixing to target weights by soft memberships.

A classifier learnt from a labelled table gives each document a posterior over domains. With n tokens and
posterior p of a document, rates r >= 0 are sought for which the domains' expected tokens, the sums of r n p,
come nearest to their targets in least squares, with a small pull of all rates to 1.

Projected gradient descent runs over all documents, in its lazy form: a rate's own slope is n times p times the
domains' gaps, so a step for each domain moves a rate by p times the steps (the metric weighs documents by their
tokens), steps add up, and the rates are the projection of 1 and all steps so far on r >= 0. The slope is scaled by
the inverse of the curvature over the rates above 0, which makes each a damped Newton step of the sums (a scaled
projected gradient: the same slope, projection and optimum); plain steps hadn't settled after 40 passes over the
documents. They are halved while they don't help, and settle in a few rounds. A pass is one aggregation of built-in
functions, and the driver holds a number for each domain; nothing is kept by document.

The classifier is multinomial logistic regression over hashed words, each word counted once in a document, from
at most ``most_rows`` labelled rows, the first by a hash. It folds into a weight for each bucket and domain.

Edge cases: null or empty texts have one token and the posterior of no words; a null label or doc_id in the
labelled table counts as no label; of labelled rows that share a doc_id one text is learnt from; without labels every document has the same posterior; rows that repeat count
each; a null doc_id is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import batch_of, bounded_sample, materialise, split_batches, text_bytes

_BAG = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("buckets", pa.list_(pa.int32()))])
_SOFT = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("p", pa.list_(pa.float64()))])


def buckets_of(text: bytes, size: int) -> np.ndarray:
    """The buckets of a text's distinct words."""
    words = {*text.lower().split()}
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return np.unique(h % np.uint64(size)).astype(np.int64)


class Classifier:
    """Log posteriors as a bias and the mean weight of a text's buckets."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias = weights, bias

    def posterior(self, text: bytes) -> np.ndarray:
        b = buckets_of(text, len(self.weights))
        z = self.bias + (self.weights[b].sum(0) / math.sqrt(len(b)) if len(b) else 0)
        e = np.exp(z - z.max())
        return e / e.sum()


def train(docs: DataFrame, labels: DataFrame, domain, domains: list[str], most_rows: int = 6_000, size: int = 1 << 16, rounds: int = 60) -> Classifier:
    """``domain`` is a column expression over labels that gives one of ``domains``."""
    number = F.array_position(F.array(*map(F.lit, domains)), domain).cast("int") - 1
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), number.alias("label")).where("doc_id IS NOT NULL AND label >= 0").distinct()
    sample = bounded_sample(rows, most_rows, "doc_id", "label")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def bags(batches):
        for b in split_batches(batches, 4 << 20):
            yield batch_of(_BAG, b.column("doc_id"), b.column("label"), [buckets_of(t, size).tolist() for t in b.column("text").to_pylist()])

    # most_rows bounds what is broadcast and, with the buckets, what comes to the driver
    once = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").cast("binary").alias("text"))
    arrow = once.mapInArrow(bags, "doc_id long, label int, buckets array<int>").toArrow()
    k = len(domains)
    weights, bias = np.zeros((size, k)), np.zeros(k)
    n = arrow.num_rows
    if not n:
        return Classifier(weights, bias)
    order = np.lexsort((arrow.column("label").to_numpy(), arrow.column("doc_id").to_numpy()))
    bag = [np.array(x, np.int64) for x in arrow.column("buckets").to_pylist()]
    bag = [bag[i] for i in order]
    y = np.eye(k)[arrow.column("label").to_numpy()[order]]
    at, of_row = np.concatenate([*bag, np.empty(0, np.int64)]), np.repeat(np.arange(n), [len(b) for b in bag])
    value = 1 / np.sqrt(np.maximum([len(b) for b in bag], 1))[of_row]
    share = (y.sum(0) + 1) / (n + k)
    bias = np.log(share)
    squares = np.full((size, k), 1e-6)
    for _ in range(rounds):  # adaptive gradient over all rows
        z = np.stack([np.bincount(of_row, weights[at, j] * value, n) for j in range(k)], 1) + bias
        e = np.exp(z - z.max(1, keepdims=True))
        gap = e / e.sum(1, keepdims=True) - y
        slope = np.stack([np.bincount(at, gap[of_row, j] * value, size) for j in range(k)], 1) / n + 1e-6 * weights
        squares += slope * slope
        weights -= 0.3 * slope / np.sqrt(squares) * (np.abs(slope) > 1e-12)
        bias -= 0.5 * gap.mean(0)
    return Classifier(weights.astype(np.float32), bias)


def memberships(docs: DataFrame, model: Classifier) -> DataFrame:
    """(row, doc_id, n_tokens, p) for each row; tokens are words and an end. The row's number within its task
    and the task's number tell rows apart that are alike."""
    weights, bias = model.weights, model.bias

    def soft(batches):
        own, part, row = Classifier(weights, bias), TaskContext.get().partitionId() << 40, 0
        for b in split_batches(batches, 4 << 20):
            texts = b.column("text").to_pylist()
            yield batch_of(_SOFT, [part + row + i for i in range(len(texts))], b.column("doc_id"), [len(t.split()) + 1 for t in texts], [own.posterior(t).tolist() for t in texts])
            row += len(texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return rows.mapInArrow(soft, "row long, doc_id long, n_tokens long, p array<double>")


def rate_of(p, steps):
    """The rate of a posterior after all steps, a column or an array: 1 and the steps, projected on r >= 0."""
    moved = 1.0 + sum(x * float(s) for x, s in zip(p, steps, strict=True))
    return F.greatest(F.lit(0.0), moved) if isinstance(moved, Column) else np.maximum(0.0, moved)


def fit(soft: DataFrame, weights: list[float], total: str | float = "same", pull: float = 1e-5, rounds: int = 60, close: float = 1e-7) -> dict:
    """Rates with the least sum of the squared gaps of the domains' tokens to their targets (as shares of all
    tokens) and pull times the squared distance of rates to 1, weighted by tokens. total: "same" keeps the expected
    number of tokens, "cover" takes the least with which no domain loses any, a number is the tokens wanted.

    Raises RuntimeError when the slope isn't ``close`` to 0 after so many rounds."""
    k, share = len(weights), np.array(weights, float) / sum(weights)
    n, p = F.col("n_tokens").cast("double"), [F.col("p")[j] for j in range(k)]

    def measured(steps: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray]:
        """All tokens; and of the rates after the steps the domains' tokens, the squares, and the products of the
        posteriors where the rate is above 0: the sums that a step needs, in one pass over the documents."""
        r = rate_of(p, steps)
        on = F.when(r > 0, n)
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        row = soft.agg(F.sum(n), *(F.sum(n * r * x) for x in p), F.sum(n * r * r), *(F.sum(on * p[i] * p[j]) for i, j in pairs)).first()
        found = np.array([x or 0.0 for x in row], float)
        square = np.zeros((k, k))
        for (i, j), x in zip(pairs, found[k + 2 :]):
            square[i, j] = square[j, i] = x
        all_ = found[0] or 1.0
        return found[0], found[1 : k + 1] / all_, found[k + 1] / all_, square / all_

    steps = np.zeros(k)
    tokens, reached, squares, square = measured(steps)
    if not tokens:
        return {"steps": steps, "target": share, "reached": share, "rounds": 0}
    want = 1.0 if total == "same" else float(max(reached / np.maximum(share, 1e-12))) if total == "cover" else float(total) / tokens
    target = want * share

    def height(steps, squares):
        """What the steps bring down: its slope is the gap and the pull."""
        return 0.5 * squares - float(target @ steps) + 0.5 * pull * float(steps @ steps)

    for done in range(rounds):
        slope = reached - target + pull * steps
        if np.abs(slope).max() <= close * want:
            return {"steps": steps, "target": target * tokens, "reached": reached * tokens, "rounds": done}
        move, size, now = np.linalg.solve(square + pull * np.eye(k), slope), 1.0, height(steps, squares)
        while True:
            then = steps - size * move
            _, reached, new, square = measured(then)
            if height(then, new) <= now + 1e-12 or size < 1e-6:
                break
            size /= 2
        steps, squares = then, new
    raise RuntimeError(f"the rates didn't settle in {rounds} rounds: reached {reached * tokens}, wanted {target * tokens}")


def with_rates(soft: DataFrame, fitted: dict, seed: int = 11) -> DataFrame:
    """(row, doc_id, n_tokens, p, rate, copies): copies is the rate rounded up or down by a hash of the row."""
    rate = rate_of([F.col("p")[j] for j in range(len(fitted["steps"]))], fitted["steps"])
    part = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "row"), 11) / float(1 << 53)
    return soft.withColumn("rate", rate).withColumn("copies", F.floor(F.col("rate") + part).cast("long"))


#: Domains by the label columns: plain text, poor text, toxic text.
DOMAINS = ["plain", "poor", "toxic"]


def label_domain():
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "plain").when(F.col("quality") == 0, "poor")


def mix(docs: DataFrame, labels: DataFrame, weights: list[float], domains: list[str] = DOMAINS, total: str | float = "same") -> DataFrame:
    """doc_id, n_tokens, a posterior column for each domain, rate and copies of each row; and for each domain the
    tokens aimed at and reached by the rates, which are alike in all rows."""
    soft = materialise(memberships(docs, train(docs, labels, label_domain(), domains)), "memberships")
    fitted = fit(soft, weights, total)
    of_all = [F.lit(float(fitted[what][j])).alias(f"{what}_{d}") for what in ("target", "reached") for j, d in enumerate(domains)]
    return with_rates(soft, fitted).select("doc_id", "n_tokens", *(F.col("p")[j].alias(f"p_{d}") for j, d in enumerate(domains)), "rate", "copies", *of_all)


def mixed_documents(docs: DataFrame, labels: DataFrame, weights: list[float], domains: list[str] = DOMAINS) -> DataFrame:
    """The rows of docs, each as often as its rate says and at least once, with all their columns. The targets
    cover what every domain has, so that only rows of domains with too little are repeated."""
    model = train(docs, labels, label_domain(), domains)
    steps, w, bias = fit(materialise(memberships(docs, model), "memberships"), weights, "cover")["steps"], model.weights, model.bias

    def repeated(batches):
        own, row, part = Classifier(w, bias), 0, TaskContext.get().partitionId()
        for b in split_batches(batches, 4 << 20):
            p = np.array([own.posterior((t or "").encode()) for t in b.column("text").cast(pa.string()).to_pylist()]).reshape(b.num_rows, -1)
            u = np.array([xxhash.xxh3_64_intdigest(f"{d} {part} {row + i}", 11) for i, d in enumerate(b.column("doc_id").to_pylist())], np.float64) / 2**64
            row += b.num_rows
            copies = np.maximum(1, np.floor(rate_of(p.T, steps) + u).astype(np.int64)) if b.num_rows else np.empty(0, np.int64)
            yield b.take(pa.array(np.repeat(np.arange(b.num_rows), copies)))

    return docs.mapInArrow(repeated, docs.schema)
