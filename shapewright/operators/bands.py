"""Percentile bands of distances: grids, labels, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The percentiles that bands are kept at, dense at both ends, where searches look. Labels change at the 5th, 25th, 75th and 95th.
GRID = (0, 1, 2, 5, 10, 15, 20, 25, 30, 40, 50, 60, 70, 75, 80, 85, 90, 95, 97, 98, 99, 99.5, 99.9, 100)
P5, P25, P75, P95 = (GRID.index(p) for p in (5, 25, 75, 95))


def bands(distances: DataFrame, *keys: str) -> DataFrame:
    """q: exact linear-interpolated percentiles of d on GRID, by keys."""
    return distances.groupBy(*keys).agg(F.percentile("d", F.array(*[F.lit(p / 100) for p in GRID])).alias("q"), F.count(F.lit(1)).alias("n"))


def label(d: Column, q: Column) -> Column:
    at = lambda i: F.get(q, F.lit(i))
    return F.when(d >= at(P95), "extreme").when(d >= at(P75), "far").when(d <= at(P5), "very_close").when(d <= at(P25), "close").otherwise("typical")


def percentile_of(d: Column, q: Column) -> Column:
    """Percentile of d by linear interpolation between the grid's quantiles."""
    grid = F.array(*[F.lit(float(p)) for p in GRID])
    i = F.size(F.filter(q, lambda x: x <= d)) - 1
    low, high = F.get(q, i), F.get(q, i + 1)
    inside = F.get(grid, i) + F.coalesce(F.try_divide(d - low, high - low), F.lit(0.0)) * (F.get(grid, i + 1) - F.get(grid, i))
    return F.when(d <= F.get(q, F.lit(0)), 0.0).when(d >= F.get(q, F.lit(len(GRID) - 1)), 100.0).otherwise(inside)
