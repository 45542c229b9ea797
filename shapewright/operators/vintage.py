"""Archived revisions of a corpus: ladders of other widths, codes that changed, what was known when, and how far it was from what is known now."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def realigned(rows: DataFrame, by: str, last: int, bin_: str = "bin", value: str = "pop") -> DataFrame:
    """rows with the bins of another ladder: those from last on are one open bin; a shorter ladder's open bin stays where it begins, those above it are absent.

    by: the column of a ladder, such as a revision; a ladder that does not go from 0 upward without a gap is an error.
    """
    ladders = rows.groupBy(by).agg(F.min(bin_).alias("lo"), F.max(bin_).alias("hi"), F.countDistinct(bin_).alias("n"))
    wrong = ladders.where((F.col("lo") != 0) | (F.col("n") != F.col("hi") + 1)).limit(3).collect()
    if wrong:
        raise ValueError(f"irregular ladders of {by}: {[r[0] for r in wrong]}")
    keys = [c for c in rows.columns if c not in (bin_, value)]
    return rows.groupBy(*keys, F.least(F.col(bin_), F.lit(last)).cast("int").alias(bin_)).agg(F.sum(value).alias(value))


def mapped(codes: DataFrame, entities: DataFrame, predecessors: DataFrame) -> DataFrame:
    """revision, code, entity and via of codes (revision, code): own where an entity has the code, predecessor where an older code
    stands in for an entity that has no row of its own in that revision, null for codes of neither.

    entities, predecessors: code, entity. Of several predecessors the smallest code counts.
    """
    own = codes.join(entities, "code").select("revision", "code", "entity", F.lit("own").alias("via"))
    older = codes.join(predecessors, "code").join(own.select("revision", "entity"), ["revision", "entity"], "left_anti")
    first = older.groupBy("revision", "entity").agg(F.min("code").alias("code")).select("revision", "code", "entity", F.lit("predecessor").alias("via"))
    both = own.unionByName(first)
    rest = codes.join(both.select("revision", "code"), ["revision", "code"], "left_anti")
    return both.unionByName(rest.select("revision", "code", F.lit(None).cast("int").alias("entity"), F.lit(None).cast("string").alias("via")))


def known_at(slices: DataFrame, origins: DataFrame) -> DataFrame:
    """t, revision and year: the latest revision that was out at each origin t, and the latest year in it up to t. slices: revision, year."""
    met = origins.join(slices, (F.col("revision") <= F.col("t")) & (F.col("year") <= F.col("t")))
    return met.groupBy("t").agg(F.max(F.struct("revision", "year")).alias("m")).select("t", "m.revision", "m.year")


def continuity(ranked: DataFrame, by: list[str], key: str, now: str, then: str, k: int) -> DataFrame:
    """by, n, jaccard of the k first, rho of the ranks, median and largest rank then of those that are first now, and how many stay within k and 2 k.

    ranked: by, key and two distances; ties go to the smaller key.
    """
    order = lambda c: F.row_number().over(Window.partitionBy(*by).orderBy(F.round(c, 9), key))
    mean = lambda c: F.rank().over(Window.partitionBy(*by).orderBy(F.round(c, 9))) + (F.count(F.lit(1)).over(Window.partitionBy(*by, F.round(c, 9))) - 1) / 2
    rows = ranked.where(F.col(now).isNotNull() & F.col(then).isNotNull()).select(*by, order(now).alias("a"), order(then).alias("b"), mean(now).alias("ra"), mean(then).alias("rb"))
    first, within = F.col("a") <= k, lambda m: F.count(F.when((F.col("a") <= k) & (F.col("b") <= m * k), 1))
    both = within(1)
    held = F.count(F.when(first, 1)) + F.count(F.when(F.col("b") <= k, 1)) - both
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (both / held).alias("jaccard"), F.corr("ra", "rb").alias("rho"), F.percentile(F.when(first, F.col("b")), 0.5).alias("median_rank"),
        F.max(F.when(first, F.col("b"))).alias("max_rank"), both.alias("within_k"), within(2).alias("within_2k"),
    )
