"""Audit of how quality filters interact: what each removes in every order in which they could be applied.

Documents fall into cells by the set of filters that they fail, at most 2^n a part; all else comes from the cells.
The orders are visited so that each differs from the one before by one swap of neighbours. A swap changes what is
left after a single step, so the two steps beside it are told anew from the cells and the others stay as they are;
what each filter removes adds up along the walk to its Shapley sum.

Copies are told by the SHA-256 of their text. Rows of one digest, part and label are counted together before they
meet those of other parts, so a text that a third of the documents share is a few rows.

Edge cases: null texts are empty, and equal to empty ones; a null language is the empty part; a null doc_id is
smaller than none and its row is no later copy; rows that repeat with one doc_id aren't copies of each other, as
none has a smaller doc_id; a document with several labels is good or toxic if one of them says so; without labels
nothing is lost; an empty table has no parts and gives no rows; other columns are ignored whatever their names.
Characters are code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The most filters: all orders of them are returned.
MOST_FILTERS = 7


def text_filters(text: Column) -> dict[str, Column]:
    """Whether a text fails by itself: few words, few distinct ones, many capitals, signs of markup or tables."""
    words = F.array_remove(F.split(text, SPACE, -1), "")
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by the filters that they fail (bit k is the k-th letter's; the last is
    that of later copies, whatever part the first one is in)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bits = [F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(text_filters(F.col("t")).values())]
    copy = 1 << len(bits)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("t"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), reduce(Column.__add__, bits).alias("mask"))
    # documents without an id find no label; by their digests they don't meet in one task
    rows = rows.withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("?"), F.hex("digest"))))
    told = labels.groupBy(F.col("doc_id").cast("long").cast("string").alias("key")).agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))))
    rows = rows.join(told, "key", "left").na.fill(0, ["good", "toxic"])

    of_text = ["digest", "part", "mask", "good", "toxic"]
    by_id = rows.groupBy(*of_text, "doc_id").agg(F.count("*").alias("n"))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    groups = by_id.groupBy(*of_text).agg(F.sum("n").alias("n"), least.alias("least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"))
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))  # a row for each part and label of a text
    groups = groups.withColumn("fine", F.col("no_id") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0))
    split = F.explode(F.array(F.struct(F.col("mask").alias("m"), F.col("fine").alias("k")), F.struct((F.col("mask") + copy).alias("m"), (F.col("n") - F.col("fine")).alias("k"))))
    cells = groups.select("part", "good", "toxic", split.alias("x")).select("part", "good", "toxic", "x.m", "x.k").where("k > 0")
    return cells.groupBy("part", F.col("m").alias("mask")).agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("good")).alias("good"), F.sum(F.col("k") * F.col("toxic")).alias("toxic"))


def adjacent_swaps(n: int) -> Iterator[int]:
    """Places i whose swap with i + 1 leads, one after another, through all orders of n things: the largest thing
    walks to and fro, and at each end the others make one step of their own walk."""
    if n < 2:
        return
    down = True
    for inner in [*adjacent_swaps(n - 1), None]:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        if inner is not None:
            yield inner + down  # at the front, the largest shifts the others by one
        down = not down


def left_over(cells: np.ndarray) -> np.ndarray:
    """For every set of filters, the sums of the cells that fail none of it."""
    below = cells.copy()  # below[x]: cells whose failures lie within x
    at = np.arange(len(cells))
    bit = 1
    while bit < len(cells):
        has = at[(at & bit) != 0]
        below[has] += below[has ^ bit]
        bit <<= 1
    return below[::-1]


def walk(cells: np.ndarray, letters: str) -> Iterator[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, losses.., shapley) of all orders. Row m of ``cells``
    counts the documents of mask m and, beside it, each kind of loss."""
    n, left = len(letters), left_over(cells)
    fails = [left[0][0] - left[1 << f][0] for f in range(n)]
    alone = [cells[1 << f][0] for f in range(n)]
    order, before = list(range(n)), [(1 << i) - 1 for i in range(n + 1)]
    steps: list[tuple] = [()] * n
    removed = [0] * n
    shapley = [0] * n

    def step(i: int) -> None:
        f, gone = order[i], left[before[i]] - left[before[i + 1]]
        removed[f] = int(gone[0])
        steps[i] = (int(left[before[i + 1]][0]), int(gone[0]), int(fails[f] - gone[0]), int(alone[f]), *map(int, gone[1:]))

    for i in range(n):
        step(i)
    seen = []
    for swap in [None, *adjacent_swaps(n)]:
        if swap is not None:
            order[swap], order[swap + 1] = order[swap + 1], order[swap]
            before[swap + 1] = before[swap] | 1 << order[swap]
            step(swap)
            step(swap + 1)
        for f in range(n):
            shapley[f] += removed[f]
        seen.append((tuple(order), tuple(steps)))
    for o, s in seen:
        name = "".join(letters[f] for f in o)
        for i, f in enumerate(o):
            yield name, i + 1, *s[i], shapley[f]


def audit_cells(cells: DataFrame, letters: str, losses: list[str]) -> DataFrame:
    """The audit of each part from its cells (part, mask, n, losses..): a row for each order and step. A part has at
    most 2^n cells, which is all that a task holds of it."""
    if len(letters) > MOST_FILTERS:
        raise ValueError(f"{len(letters)} filters have more orders than can be returned")

    def audited(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((1 << len(letters), 1 + len(losses)), dtype=np.int64)
        counts[rows["mask"].to_numpy()] = rows[["n", *losses]].to_numpy()
        out = pd.DataFrame(walk(counts, letters), columns=["filter_order", "step", *names])
        out.insert(0, "part", key[0])
        return out

    names = ["kept", "removed", "redundant", "unique_fails", *(f"{x}_lost" for x in losses), "shapley"]
    schema = "part string, filter_order string, step int, " + ", ".join(f"{x} long" for x in names)
    return cells.groupBy("part").applyInPandas(audited, schema)


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return audit_cells(mask_cells(docs, labels), "ABCDE", ["good", "toxic"])


def oracle() -> str:
    """DuckDB SQL of the same rows: documents are counted for every order and step."""
    return r"""
        WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS low FROM documents),
        w AS (SELECT *, list_filter(string_split_regex(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM t),
        d AS MATERIALIZED (SELECT w.doc_id, part, [len(w) < 200, 100 * list_unique(w) < 50 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t),
                    regexp_matches(t, '[#$%&*|]'), coalesce(low < w.doc_id, false)] AS f,
                    coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic FROM w LEFT JOIN labels l ON w.doc_id = l.doc_id),
        n AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
        o AS (SELECT [a.i, b.i, c.i, e.i, g.i] AS o FROM n a, n b, n c, n e, n g WHERE len(list_distinct([a.i, b.i, c.i, e.i, g.i])) = 5),
        s AS (SELECT o, n.i AS step, o[n.i] AS x FROM o, n),
        r AS (SELECT d.part, s.o, s.step, s.x,
                    count(*) FILTER (NOT list_bool_or(list_transform(s.o[:s.step], lambda k: d.f[k]))) AS kept,
                    count(*) FILTER (d.f[s.x] AND NOT coalesce(list_bool_or(list_transform(s.o[:s.step - 1], lambda k: d.f[k])), false)) AS removed,
                    count(*) FILTER (d.f[s.x] AND coalesce(list_bool_or(list_transform(s.o[:s.step - 1], lambda k: d.f[k])), false)) AS redundant,
                    count(*) FILTER (d.f[s.x] AND len(list_filter(d.f, lambda y: y)) = 1) AS unique_fails,
                    count(*) FILTER (d.good AND d.f[s.x] AND NOT coalesce(list_bool_or(list_transform(s.o[:s.step - 1], lambda k: d.f[k])), false)) AS good_lost,
                    count(*) FILTER (d.toxic AND d.f[s.x] AND NOT coalesce(list_bool_or(list_transform(s.o[:s.step - 1], lambda k: d.f[k])), false)) AS toxic_lost
              FROM d, s GROUP BY ALL)
        SELECT part, array_to_string(list_transform(o, lambda k: 'ABCDE'[k]), '') AS filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM r
    """
