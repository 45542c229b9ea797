"""Connected components of a graph of 64-bit nodes, by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, joined_by_size, released


def large_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """Each node's larger neighbours are joined to the least of its neighbours and itself."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return joined_by_size(both.where("b > a"), least, "a", "n", 2 * n_edges).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def small_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """Each node and its smaller neighbours are joined to the least of these. Edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    rest = joined_by_size(edges, least, "a", "n", n_edges).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for each node that has an edge and is no root itself.

    edges: a and b, two different long values. Minima are aggregated before any shuffle, and a node with many edges meets them by a
    broadcast of bounded size. Each half of a round is kept in the shared folder, and the one before it deleted; the number of rounds
    grows as the logarithm of a component's size. Loops and null ends are left out; repeated edges count once.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b AND a IS NOT NULL AND b IS NOT NULL").distinct())
    mark = lambda df: df.agg(F.count("a"), F.bit_xor(F.xxhash64("a", "b"))).first()
    before, seen = None, mark(now)
    while seen != before and seen[0]:
        for step in (large_star, small_star):
            last, now = now, cut(step(now, now.count()))
            released(last)
        before, seen = seen, mark(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
