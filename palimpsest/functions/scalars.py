"""Column expressions with the value semantics that the operators need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimals to which kinds of figures are rounded.
SCORE, LABEL, DRIFT = 6, 4, 2


def epoch(c: Column | str) -> Column:
    """Seconds since 1970 of a time without zone, whatever the session's zone is."""
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole days of 24 hours between two epoch seconds, 0 at least; calendar days don't matter."""
    return F.greatest(F.floor((later - earlier) / 86400), F.lit(0)).cast("long")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def minmax(value: Column, over) -> Column:
    """Scaled to 0..1 within a window: 0 where all are 0, 0.5 where all are equal."""
    low, high = F.min(value).over(over), F.max(value).over(over)
    return F.when((low == 0) & (high == 0), 0.0).when(low == high, 0.5).otherwise((value - low) / (high - low))


def first_match(cases: list[tuple[Column, str]], default: str) -> Column:
    """The value of the first condition that holds."""
    out = F.when(cases[0][0], cases[0][1])
    for c, v in cases[1:]:
        out = out.when(c, v)
    return out.otherwise(default)


def literal_like(text: Column, part: str) -> Column:
    """Contains, without regard to case, and without wildcards in the part."""
    return F.lower(text).contains(part.lower())


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; null if one has no length."""
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
