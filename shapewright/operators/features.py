"""Features of a profile, z-scores, stages and shape classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec
from .corpus import BINS, WIDTH

NUMERIC = ("low", "mid", "high", "top", "low_dep", "high_dep", "total_dep", "base_slope_far", "base_slope_near", "modal_bin", "side_ratio", "mean_value", "median_value")
LOW, MID, HIGH, TOP = (0, 2), (2, 7), (7, 10), (8, 10)
"""Bins of the four groups: begin and end."""
MID_SIDES = (3, 7)


def part(v: Column, span: tuple[int, int]) -> Column:
    return vec.total(F.slice(v, span[0] + 1, span[1] - span[0]))


def median_value(s1: Column, c1: Column) -> Column:
    """Median by interpolation in the first bin whose running share reaches one half."""
    k = F.least(F.size(F.filter(c1, lambda x: F.round(x, 12) < 0.5)), F.lit(BINS - 1))
    before = F.when(k == 0, 0.0).otherwise(F.get(c1, F.greatest(k - 1, F.lit(0))))
    inside = F.when(F.get(s1, k) == 0, 0.0).otherwise(F.try_divide(0.5 - before, F.get(s1, k)))
    return WIDTH * k + WIDTH * F.least(F.greatest(inside, F.lit(0.0)), F.lit(1.0))


def features(profiles: DataFrame) -> DataFrame:
    s1, s = F.col("s1"), F.col("s")
    low, mid, high, top = (part(s1, x) for x in (LOW, MID, HIGH, TOP))
    one, two = vec.halves(s, BINS)
    return profiles.select(
        "entity", "year", "total",
        low.alias("low"), mid.alias("mid"), high.alias("high"), top.alias("top"),
        F.try_divide(low, mid).alias("low_dep"), F.try_divide(high, mid).alias("high_dep"), F.try_divide(low + high, mid).alias("total_dep"),
        F.try_divide(F.get(s1, F.lit(0)), F.get(s1, F.lit(4))).alias("base_slope_far"), F.try_divide(F.get(s1, F.lit(0)), F.get(s1, F.lit(2))).alias("base_slope_near"),
        (WIDTH * (F.array_position(F.transform(s1, lambda x: F.round(x, 12)), F.array_max(F.transform(s1, lambda x: F.round(x, 12)))) - 1)).cast("double").alias("modal_bin"),
        F.try_divide(part(one, MID_SIDES), part(two, MID_SIDES)).alias("side_ratio"),
        vec.total(F.transform(s1, lambda x, i: x * (WIDTH * i + WIDTH / 2))).alias("mean_value"),
        median_value(s1, F.col("c1")).alias("median_value"),
    )


def stage(median: Column, low: float = 20.0, high: float = 27.0) -> Column:
    return F.when(median < low, "expansive").when(median >= high, "constrictive").otherwise("stationary")


def zscores(features_: DataFrame, by: str = "year") -> DataFrame:
    """z_ columns against all entities of the same year; population deviation, 1 where it is 0."""
    w = Window.partitionBy(by)
    sd = lambda c: F.when(F.stddev_pop(c).over(w) > 1e-12, F.stddev_pop(c).over(w)).otherwise(1.0)
    return features_.select("entity", "year", "total", *NUMERIC, *[((F.col(c) - F.avg(c).over(w)) / sd(c)).alias(f"z_{c}") for c in NUMERIC])


def z_vector() -> Column:
    return F.array(*[F.coalesce(F.col(f"z_{c}"), F.lit(0.0)) for c in NUMERIC])


BUCKETS = ((0, 2), (2, 4), (4, 6), (6, 8), (8, 10))
TOLERANCE = 0.05


def compared(a: Column, b: Column) -> Column:
    """1, -1 or 0: whether b is above, below or within TOLERANCE of a, relative to the larger."""
    gap = (b - a) / F.greatest(a, b, F.lit(1e-12))
    return F.when(F.round(gap, 12) > TOLERANCE, 1).when(F.round(gap, 12) < -TOLERANCE, -1).otherwise(0)


def steps(s1: Column) -> Column:
    """The four comparisons of neighbouring buckets, written with +, - and 0."""
    level = [part(s1, b) / (WIDTH * (b[1] - b[0])) for b in BUCKETS]
    return F.concat(*[F.when(c == 1, "+").when(c == -1, "-").otherwise("0") for c in (compared(a, b) for a, b in zip(level, level[1:], strict=False))])
