"""Vectors as array<double> columns: sums and maps by higher-order functions, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SMOOTH = (0.054, 0.242, 0.399, 0.242, 0.054)
"""Fixed smoothing kernel, applied with repeated ends."""
CLR_EPS = 1e-6
COS_EPS = 1e-12


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def l1(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b) + COS_EPS)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scaled(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x * k)


def max_abs_diff(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def halves(v: Column, n: int) -> tuple[Column, Column]:
    return F.slice(v, 1, n), F.slice(v, n + 1, n)


def folded(v: Column, n: int) -> Column:
    """Both sides added, bin by bin."""
    return add(*halves(v, n))


def cumulative(v: Column) -> Column:
    """Running sums, in one pass over the array."""
    grown = F.aggregate(v, F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("v")), lambda a, x: F.struct((a["s"] + x).alias("s"), F.concat(a["v"], F.array(a["s"] + x)).alias("v")))
    return grown["v"]


def cumulative_halves(v: Column, n: int) -> Column:
    return F.concat(*[cumulative(x) for x in halves(v, n)])


def smooth(v: Column, n: int) -> Column:
    """Five-tap smoothing of one side of n bins, ends repeated."""
    at = lambda i, j: F.element_at(v, F.least(F.greatest(i + j, F.lit(1)), F.lit(n)))
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: sum((F.lit(k) * at(i, j - 2) for j, k in enumerate(SMOOTH)), F.lit(0.0)))


def smooth_halves(v: Column, n: int) -> Column:
    return F.concat(*[smooth(x, n) for x in halves(v, n)])


def roots(v: Column) -> Column:
    return F.transform(v, F.sqrt)


def logs(v: Column) -> Column:
    return F.transform(v, lambda x: F.log(x + CLR_EPS))


def centred(v: Column) -> Column:
    return F.transform(v, lambda x: x - total(v) / F.size(v))
