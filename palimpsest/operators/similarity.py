"""Similarity of sources, and matching of symbols between two states of a file."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.lineage import written
from .retrieval import code_tokens


@pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x, y) -> float:
        x, y = list(x), list(y)
        return 1.0 if x == y else round(difflib.SequenceMatcher(None, x, y, autojunk=False).ratio(), 6)

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def sequence_similarity(a: Column, b: Column) -> Column:
    """Twice the matched tokens by all tokens, of the longest matching blocks; 1 for two empty sources. Equal
    token lists are decided without Python's matcher."""
    x, y = code_tokens(a), code_tokens(b)
    return F.when(x == y, 1.0).otherwise(_ratio(x, y))


@pandas_udf(T.StructType([T.StructField("added", T.LongType()), T.StructField("deleted", T.LongType())]))
def changed_lines(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Lines added and deleted from one text to the other."""
    out = []
    for x, y in zip(a, b, strict=True):
        ops = difflib.SequenceMatcher(None, x.splitlines(), y.splitlines(), autojunk=False).get_opcodes()
        out.append((sum(j2 - j1 for t, _, _, j1, j2 in ops if t in ("insert", "replace")), sum(i2 - i1 for t, i1, i2, _, _ in ops if t in ("delete", "replace"))))
    return pd.DataFrame(out, columns=["added", "deleted"])


@pandas_udf(T.StringType())
def unified_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(["\n".join(difflib.unified_diff(x.splitlines(), y.splitlines(), lineterm="")) for x, y in zip(a, b, strict=True)])


def rewrites(pairs: DataFrame, least_tokens: int = 8, below: float = 0.5) -> DataFrame:
    """Rows with texts ``before`` and ``after`` that are a rewrite: enough tokens, enough changed lines, little kept."""
    span = F.greatest(F.size(F.split("before", "\n")), F.size(F.split("after", "\n")))
    rows = pairs.where(F.greatest(F.size(code_tokens(F.col("before"))), F.size(code_tokens(F.col("after")))) >= least_tokens)
    rows = rows.withColumn("lines", changed_lines("before", "after"))
    rows = rows.where(F.col("lines.added") + F.col("lines.deleted") >= F.greatest(F.lit(4), F.floor(0.4 * span)))
    return rows.withColumn("similarity", sequence_similarity(F.col("before"), F.col("after"))).where(F.col("similarity") < below)


@pandas_udf(T.DoubleType())
def _near(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([1.0 if x == y else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


#: Kinds of matches in the order in which they are tried. A kind needs some facts (a leading "not "
#: for their opposite) and a least likeness of the bodies; its score is a constant and shares of the bodies' and
#: signatures' likeness, with a cap; it counts from a least score on.
MATCHES = [
    # kind, facts, least body, constant, body's share, signature's share, cap, least score
    ("unchanged", ["path", "qualified"], 0.0, 1.00, 0.00, 0.00, 1.00, 0.86),
    ("same_name", ["path", "name", "parent"], 0.0, 0.97, 0.00, 0.00, 1.00, 0.86),
    ("same_body", ["body_hash", "parent", "path"], 0.0, 0.95, 0.00, 0.00, 1.00, 0.86),
    ("same_body", ["body_hash", "parent"], 0.0, 0.91, 0.00, 0.00, 1.00, 0.86),
    ("renamed", ["path", "parent", "not name"], 0.9, 0.00, 0.60, 0.40, 0.94, 0.90),
    ("moved", ["not path", "name"], 0.9, 0.00, 0.58, 0.32, 0.90, 0.90),
    ("changed", ["path", "name"], 0.0, 0.58, 0.34, 0.08, 1.00, 0.86),
]
#: Kinds of symbols that match each other besides equal ones.
ALIKE = ["function", "method"]


def scored_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file, old_id, new_id, score, kind) of the pairs of symbols of each file's two states that a rule matches."""
    a, b = (x.select("file", *(F.col(c).alias(f"{side}_{c}") for c in x.columns if c != "file")) for side, x in (("old", old), ("new", new)))
    pairs = a.join(b, "file").where((F.col("old_kind") == F.col("new_kind")) | (F.col("old_kind").isin(ALIKE) & F.col("new_kind").isin(ALIKE)))
    same = {c: F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")) for c in ("path", "name", "qualified", "parent", "body_hash")}
    pairs = pairs.where((same["path"] & same["qualified"]) | same["name"] | same["parent"]).withColumn("body", _near("old_body", "new_body")).withColumn("signature", _near("old_signature", "new_signature"))
    chosen = None
    for kind, facts, least_body, constant, of_body, of_signature, cap, least in MATCHES:
        holds = F.col("body") >= least_body
        for f in facts:
            holds = holds & (~same[f[4:]] if f.startswith("not ") else same[f])
        score = F.least(F.lit(cap), constant + of_body * F.col("body") + of_signature * F.col("signature"))
        told = F.struct(score.alias("score"), F.lit(kind).alias("kind"), F.lit(least).alias("least"))
        chosen = F.when(holds, told) if chosen is None else chosen.when(holds, told)
    found = pairs.withColumn("m", chosen).where("m.score >= m.least")
    return found.select("file", "old_id", "new_id", F.col("m.score").alias("score"), F.col("m.kind").alias("kind"))


def match_symbols(old: DataFrame, new: DataFrame, margin: float = 0.03) -> DataFrame:
    """(file, old_id, new_id, score, kind): pairs of the symbols (file, id, kind, path, name, qualified, parent,
    body_hash, body, signature) of each file's two states. A pair whose score is within the margin of another one of
    either side is ambiguous and left out, unless it is sure; of the rest, each round takes the pairs that are the
    best of both sides, until none is left."""
    pairs = written(scored_pairs(old, new))
    by_old, by_new = Window.partitionBy("file", "old_id"), Window.partitionBy("file", "new_id")
    rivals, reach = None, round(margin * 1e9) - 1
    for side in ("old_id", "new_id"):
        near = F.count("*").over(Window.partitionBy("file", side).orderBy("units").rangeBetween(-reach, reach)) > 1
        rivals = near if rivals is None else rivals | near
    left = written(pairs.withColumn("units", F.round(F.col("score") * 1e9).cast("long")).withColumn("rival", rivals & (F.col("score") < 1)).where("NOT rival").drop("rival", "units"))
    out = None
    while not left.isEmpty():
        first = F.struct(-F.col("score"), "old_id", "new_id")
        best = written(left.withColumn("f", first).withColumn("o", F.min("f").over(by_old)).withColumn("n", F.min("f").over(by_new)).where((F.col("f") == F.col("o")) & (F.col("f") == F.col("n"))).drop("f", "o", "n"))
        out = best if out is None else out.unionByName(best)
        left = written(left.join(best.select("file", "old_id"), ["file", "old_id"], "left_anti").join(best.select("file", "new_id"), ["file", "new_id"], "left_anti"))
    out = pairs.limit(0) if out is None else out
    return out.withColumn("score", F.round("score", 6))
