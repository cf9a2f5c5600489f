"""Connected components of an edge table by alternating stars, with a written table after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, spread_join


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (a, b), with the component's smallest node.

    A large star links each larger neighbour of a node to the smallest of its neighbourhood, a small star each
    smaller one; minima are aggregated before they are joined, and the edges of a node that very many have are dealt
    over tasks, so that no neighbourhood is gathered. Ends when a round changes nothing. Self-loops and repeated edges are allowed; no edges give no rows.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = spread_join(both.where("b > a"), low, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialise(large, "stars")  # small plans: the driver holds them all
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = spread_join(large, low, "a", "b")
        edges = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = materialise(edges, "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components didn't settle")
    stars = edges.groupBy("a").agg(F.min("b").alias("b"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
