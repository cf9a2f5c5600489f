"""Evidence: redaction, chunks, lexical and vector retrieval, fusion and packing."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import written
from ..functions.meeting import shared_counts, sharing
from ..functions.scalars import SCORE, cosine

#: What is taken for a secret, and what stands in its place.
REDACTIONS = [
    (r"(?s)-----BEGIN [^-]*PRIVATE KEY-----.*?-----END [^-]*PRIVATE KEY-----", "[REDACTED PRIVATE KEY]"),
    (r"""(?i)((?:password|passwd|token|secret|api[_-]?key)\s*[:=]\s*)(?:"[^"]*"|'[^']*'|\S+)""", "$1[REDACTED]"),
    (r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16})\b", "[REDACTED TOKEN]"),
    (r"""(?i)(?:[A-Z]:\\|/(?:home|users)/)[^\s"']+""", "[REDACTED LOCAL PATH]"),
]


def redacted(text: Column) -> Column:
    """The text without private keys, assigned secrets, providers' tokens and local paths, in this order."""
    for pattern, with_ in REDACTIONS:
        text = F.regexp_replace(text, pattern, with_)
    return text


def normalized_hash(text: Column) -> Column:
    """A digest that ignores white space and case."""
    return F.sha2(F.lower(F.regexp_replace(text, "\\s+", "")), 256)


def code_tokens(text: Column) -> Column:
    """Tokens of a source text without its comments."""
    plain = F.regexp_replace(text, r"(?s)/\*.*?\*/|//[^\n]*|#[^\n]*", " ")
    return F.regexp_extract_all(plain, F.lit(r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\sA-Za-z0-9_]"), F.lit(0))


def chunk_fixed(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, chunk, n_chars, digest) of consecutive stretches of at most ``size`` characters."""
    n = F.length("text")
    rows = docs.where(n > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).alias("chunk"))
    part = F.substring(F.col("text"), F.col("chunk") * size + 1, F.lit(size))
    return rows.select("doc_id", "chunk", F.length(part).alias("n_chars"), F.sha2(part, 256).alias("digest"))


def chunk_paragraphs(docs: DataFrame, size: int = 5000) -> DataFrame:
    """(doc_id, chunk, text): paragraphs packed greedily into chunks of at most ``size`` characters, a longer
    paragraph cut. Each document is packed by itself, in one pass."""
    def pack(batches):
        for b in batches:
            ids, nos, texts = [], [], []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                chunks, held = [], ""
                for p in (text or "").split("\n\n"):
                    for piece in [p[i : i + size] for i in range(0, len(p), size)]:
                        if held and len(held) + 2 + len(piece) > size:
                            chunks.append(held)
                            held = piece
                        else:
                            held = f"{held}\n\n{piece}" if held else piece
                chunks += [held] if held else []
                ids += [doc_id] * len(chunks)
                nos += range(len(chunks))
                texts += chunks
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int32()), pa.array(texts, pa.string())], names=["doc_id", "chunk", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pack, "doc_id long, chunk int, text string")


def lexical_search(docs: DataFrame, tokens: list[str], k: int) -> DataFrame:
    """(doc_id, matched, score): documents with any of up to eight tokens, the best k; .35 and up to .25 more."""
    tokens = [t.lower() for t in tokens[:8]]
    low = F.lower("text")
    matched = sum((low.contains(t).cast("int") for t in tokens[1:]), low.contains(tokens[0]).cast("int"))
    rows = docs.select("doc_id", matched.alias("matched")).where("matched > 0")
    return rows.withColumn("score", F.round(0.35 + 0.25 * F.col("matched") / len(tokens), SCORE)).orderBy(F.desc("score"), "doc_id").limit(k)


def vector_topk(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """(vec_id, score): the k nearest by cosine among vectors of the query's dimension; max(0, 1 - distance)."""
    q = F.array(*(F.lit(float(x)) for x in query))
    rows = vectors.where(F.size("embedding") == len(query)).select("vec_id", F.greatest(F.lit(0.0), cosine(F.col("embedding"), q)).alias("s"))
    return rows.orderBy(F.desc("s"), "vec_id").limit(k).select("vec_id", F.round("s", 5).alias("score"))


def hybrid_fusion(*results: DataFrame, k: int) -> DataFrame:
    """(doc_id, score, reasons): results (doc_id, score, reason) by document, the largest score and .05 more for
    each further hit, 1 at most."""
    rows = results[0]
    for r in results[1:]:
        rows = rows.unionByName(r)
    best = rows.groupBy("doc_id").agg(F.max("score").alias("m"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
    return best.select("doc_id", F.round(F.least(F.lit(1.0), F.col("m") + 0.05 * (F.col("n") - 1)), SCORE).alias("score"), "reasons").orderBy(F.desc("score"), "doc_id").limit(k)


def topk_per_type(rows: DataFrame, type_: str, score: str, key: str, k: int = 3, decay: float = 0.03) -> DataFrame:
    """The best k of each type, each after the first with a score less by ``decay`` times its place."""
    n = F.row_number().over(Window.partitionBy(type_).orderBy(F.desc(score), key))
    return rows.withColumn("place", n).where(F.col("place") <= k).withColumn("decayed", F.round(F.col(score) - decay * (F.col("place") - 1), SCORE))


def budget_packing(rows: DataFrame, budget: int, least: int) -> DataFrame:
    """(place, doc_id, taken): ranked rows (place, doc_id, n_chars) until fewer than ``least`` characters of the
    budget are left; the last one is cut. The ranked list is short, as top-k made it."""
    before = F.coalesce(F.sum("n_chars").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("left", budget - before).where(F.col("left") >= least).select("place", "doc_id", F.least("n_chars", "left").cast("long").alias("taken"))


#: Kinds of evidence that tell of a history, a commit, a request and an issue.
TELLS = {"history": ["symbol_change", "symbol_version"], "commit": ["commit", "commit_diff"], "request": ["pull_request"], "issue": ["issue"]}


def sufficiency(rows: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """(key, level) of all keys asked about, by the evidence rows (key, type, relationship) that each has: what is
    directly related decides between strong, moderate and weak; any evidence is weak at least, none is insufficient."""
    direct = F.col("relationship") == "direct"
    h, c, p, i = (F.coalesce(F.bool_or(direct & F.col("type").isin(kinds)), F.lit(False)) for kinds in TELLS.values())
    level = F.when(h & c & p & i, "strong").when((h & c) | (p & i) | (c & p), "moderate").otherwise("weak")
    found = rows.groupBy(key).agg(level.alias("level"))
    return asked.select(key).distinct().join(found, key, "left").select(key, F.coalesce("level", F.lit("insufficient")).alias("level"))


#: Words whose frequencies tasks hold; others count as rare, which only changes the order of words.
MOST_FREQUENT = 100_000


def token_set_pairs(docs: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity): documents of the same language whose sets of words are at least so similar by Jaccard.
    Words are ordered by rarity; two sets so similar share one of their first words, at places after which enough
    words are left in both. First words are shuffled as arrays; the sets of the pairs that are left are read from files.
    Words are told apart by 64-bit hashes."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != ""))
    sets = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.transform(words, lambda w: F.xxhash64(w, "lang")).alias("w")).where(F.size("w") > 0)
    sets = written(sets)  # words of different languages don't meet
    often = sets.select(F.explode("w").alias("word")).groupBy("word").count().where("count > 1").orderBy(F.desc("count"), "word").limit(MOST_FREQUENT).toArrow()
    order = np.argsort(often.column("word").to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast((often.column("word").to_numpy()[order], often.column("count").to_numpy()[order]))

    def first_words(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        names, counts = shared.value
        flat, n = b.column(1).flatten().to_numpy(), b.column(1).value_lengths().to_numpy()
        at = np.minimum(np.searchsorted(names, flat), max(len(names) - 1, 0))
        freq = np.where(names[at] == flat, counts[at], 0) if len(names) else np.zeros(len(flat), np.int64)
        row = np.repeat(np.arange(len(n)), n)
        sorted_ = np.lexsort((flat, freq, row))
        place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        kept = place <= n[row] - np.ceil(least * n[row] - 1e-9)
        row = row[kept]
        return flat[sorted_][kept], b.column(0).to_numpy()[row], n[row].astype(np.int32), (place[kept] + 1).astype(np.int32)

    def near(n_a: np.ndarray, r_a: np.ndarray, n_b: np.ndarray, r_b: np.ndarray) -> np.ndarray:
        shared_most = 1 + np.minimum(n_a - r_a, n_b - r_b)
        return (n_a >= least * n_b) & (shared_most * (1 + least) >= least * (n_a + n_b) - 1e-9)

    met = sharing(sets.where("lang IS NOT NULL").select("doc_id", "w"), first_words, near, 1 / least)
    pairs = written(met)
    counted = shared_counts(sets.select(F.col("doc_id").alias("id"), "w"), pairs)
    scored = counted.select("a", "b", F.round(F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared")), SCORE).alias("similarity"))
    return scored.where(F.col("similarity") >= least)


def html_links(pages: DataFrame) -> DataFrame:
    """(page_id, target, kind): targets of links, scripts and style sheets; not of other protocols or fragments."""
    def targets(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)), lambda t: F.struct(F.regexp_replace(t, "[?#].*$", "").alias("target"), F.lit(kind).alias("kind")))

    found = F.concat(targets("href", r"""(?i)<(?:a|link)\b[^>]*?\bhref\s*=\s*["']([^"']+)["']"""), targets("src", r"""(?i)<(?:script|img)\b[^>]*?\bsrc\s*=\s*["']([^"']+)["']"""))
    rows = pages.select("page_id", F.explode(found).alias("x")).select("page_id", "x.target", "x.kind")
    return rows.where((F.col("target") != "") & ~F.col("target").rlike("^(?i)(data:|mailto:|javascript:|https?:|//)")).distinct()
