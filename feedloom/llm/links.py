"""Connected components of a link table, as DataFrame rounds.

Alternating large-star and small-star steps: every step is a partial aggregate
(the smallest neighbour of a node) and a join back on the node, so a node with
any number of links is never gathered in one row, and adaptive execution
splits the joins of hot nodes. A round is written to the shared folder; the
number of rounds grows with the logarithm of the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import stored


def _mark(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return r.n, int(r.h)


def _star(edges: DataFrame, both: DataFrame, larger: bool) -> DataFrame:
    """One step: every node's links are replaced by links to the smallest of
    its neighbourhood. ``both`` holds the (node, neighbour) rows it looks at."""
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = both.where("v > u") if larger else both
    out = moved.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not larger:
        out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has a link; root is the smallest node
    of its component. Loops, repeated and reversed links are fine."""
    edges = stored(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "links")
    before = _mark(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        big = _star(edges, both, larger=True)
        small = _star(big, big.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), larger=False)
        edges = stored(small, "links")
        after = _mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
