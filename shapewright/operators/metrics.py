"""Distances between profiles, as columns over two prepared rows (the second's columns begin with b_)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from .corpus import BINS, WIDTH

SIGMA = {"l2": 0.05, "w1": 0.8, "w1sex": 1.0, "trend": 0.06}
"""Scales of the blended and trend distances; sigma_all_pairs measures them on a corpus."""


def prepared(profiles: DataFrame, bins: int = BINS) -> DataFrame:
    """Adds what distances need of each profile once: smoothed, square-rooted and centred log vectors."""
    return profiles.withColumns({"sm": vec.smooth_halves(F.col("s"), bins), "sq": vec.roots(F.col("s")), "lg": vec.logs(F.col("s"))}).withColumn("clr", vec.centred(F.col("lg"))).drop("lg")


def _pair(name: str) -> tuple[Column, Column]:
    return F.col(name), F.col(f"b_{name}")


def l2() -> Column:
    return vec.l2(*_pair("s"))


def l2_folded() -> Column:
    return vec.l2(*_pair("s1"))


def w1() -> Column:
    return WIDTH * vec.l1(*_pair("c1"))


def w1sex() -> Column:
    return WIDTH * vec.l1(*_pair("c"))


def blend() -> Column:
    return 0.5 * l2() / SIGMA["l2"] + 0.5 * w1sex() / SIGMA["w1sex"]


def blend_folded() -> Column:
    return 0.5 * l2_folded() / SIGMA["l2"] + 0.5 * w1() / SIGMA["w1"]


def l2s() -> Column:
    return vec.l2(*_pair("sm"))


def hel() -> Column:
    return vec.l2(*_pair("sq")) / (2**0.5)


def clr() -> Column:
    return vec.l2(*_pair("clr"))


def balance() -> Column:
    """Half the shared weight of each bin times the difference of the first side's part in it, 0.5 where a bin is empty."""
    part = lambda s, s1: F.zip_with(F.slice(s, 1, BINS), s1, lambda x, y: F.when(y == 0, 0.5).otherwise(F.try_divide(x, y)))
    weight = F.zip_with(*_pair("s1"), lambda x, y: 0.5 * (x + y))
    gap = F.zip_with(part(F.col("s"), F.col("s1")), part(F.col("b_s"), F.col("b_s1")), lambda x, y: F.abs(x - y))
    return vec.dot(weight, gap)


def w1bal() -> Column:
    return w1() + 50 * balance()


def cosine() -> Column:
    return vec.cosine_distance(*_pair("s"))


METRICS: dict[str, Callable[[], Column]] = {"l2": l2, "w1": w1, "w1sex": w1sex, "blend": blend, "l2s": l2s, "hel": hel, "clr": clr, "w1bal": w1bal, "cosine": cosine}
"""Distances by name; a caller may add its own."""


def distance(name: str) -> Column:
    if name not in METRICS:
        raise ValueError(f"unknown distance {name!r}; known: {sorted(METRICS)}")
    return METRICS[name]()


def decomposition() -> Column:
    """Array of (pos, part of the squared difference), largest first, ties by place."""
    gaps = F.zip_with(*_pair("s"), lambda x, y: (x - y) * (x - y))
    with_place = F.transform(gaps, lambda g, i: F.struct((-F.round(g / vec.total(gaps), 9)).alias("neg"), i.alias("pos")))
    return F.transform(F.array_sort(with_place), lambda x: F.struct(x["pos"].alias("pos"), (-x["neg"]).alias("part")))
