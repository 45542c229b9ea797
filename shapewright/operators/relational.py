"""Joins and governance: remapping with orphans, priorities, as-of and band joins, coverage, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def remap(rows: DataFrame, code: str, known: DataFrame, known_code: str, drop: tuple = (), year: str = "year", expected: tuple | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows whose code is known, and the orphans: code, n, first and last year of each other code.

    Codes in drop are left out knowingly. With expected, any other orphan is an error, raised when the orphans are looked at here.
    """
    rows = rows.where(~F.col(code).isin(*drop)) if drop else rows
    keys = known.select(F.col(known_code).alias("_known")).distinct()
    good = rows.join(keys, F.col(code) == F.col("_known"), "left_semi")
    bad = rows.join(keys, F.col(code) == F.col("_known"), "left_anti").groupBy(F.col(code).alias("code")).agg(F.count(F.lit(1)).alias("n"), F.min(year).alias("first_year"), F.max(year).alias("last_year"))
    if expected is not None and (odd := [r[0] for r in bad.where(~F.col("code").isin(*expected)).select("code").limit(10).collect()]):
        raise ValueError(f"unexpected codes: {odd}")
    return good, bad


def by_priority(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """The row of the first source that has a key; earlier sources win. One grouping, no join."""
    ranked = [s.withColumn("_rank", F.lit(i)) for i, s in enumerate(sources)]
    whole = ranked[0]
    for s in ranked[1:]:
        whole = whole.unionByName(s)
    rest = [c for c in sources[0].columns if c not in keys]
    return whole.groupBy(*keys).agg(F.min_by(F.struct(*rest), "_rank").alias("v"), F.min("_rank").alias("source_rank")).select(*keys, "v.*", "source_rank")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, value: str, tolerance: Column | None = None) -> DataFrame:
    """left with the last value of right at or before its time, by keys.

    Both sides go through one sort by (keys, time) and a running last value, so the work is a shuffle and a sort whatever the
    density of right; no row is paired with all earlier ones. tolerance: condition over `as_of_time` and the left time.
    """
    a = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(None).cast(right.schema[right_time].dataType).alias("_rt"))
    b = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), F.col(value).alias("_v"), F.col(right_time).alias("_rt"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    met = a.unionByName(b).withColumn("_m", F.last(F.when(F.col("_side") == 0, F.struct("_rt", "_v")), ignorenulls=True).over(w)).where("_side = 1")
    out = met.select("_l.*", F.col("_m._rt").alias("as_of_time"), F.col("_m._v").alias("as_of_value"))
    return out if tolerance is None else out.withColumns({c: F.when(tolerance, F.col(c)) for c in ("as_of_value", "as_of_time")})


def band_pairs(left: DataFrame, right: DataFrame, value: str, width: float, keys: list[str], condition: Column | None = None) -> DataFrame:
    """Pairs with |value - b_value| <= width and equal keys, as an equi-join on buckets of that width.

    A left row looks into its own and the two neighbouring buckets. b_ names right's columns.
    """
    a = left.withColumn("_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda j: F.floor(F.col(value) / width) + j)))
    b = right.select(*[F.col(c).alias(f"b_{c}") for c in right.columns], F.floor(F.col(value) / width).alias("_bb"))
    on = F.col("_b") == F.col("_bb")
    for k in keys:
        on = on & (F.col(k) == F.col(f"b_{k}"))
    met = a.join(b, on).where(F.abs(F.col(value) - F.col(f"b_{value}")) <= width).drop("_b", "_bb")
    return met if condition is None else met.where(condition)


def band_tiers(rows: DataFrame, key: str, value: str, width: float, group: str) -> DataFrame:
    """key, n, first and tier of each row: how many others of its group are partners, and the least key among them.

    Partners are the others with |value - value| <= width (tier `caliper`); without any, those of the same tenth of the group
    (`decile`); without these, all others (`any`). A row alone in its group has none and is left out. Rows of equal value are
    counted first, and a group's values are sorted once, so no pairs are made. value: double; key: long.
    """
    import numpy as np
    import pandas as pd

    two = lambda a, b: np.sort(np.concatenate([a, b], axis=-1), axis=-1)
    none = np.iinfo(np.int64).max

    def least(a, b):  # the two least of two pairs of keys that may share some
        both = two(a, b)
        both[..., 1:][both[..., 1:] == both[..., :-1]] = none
        return np.sort(both, axis=-1)[..., :2]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("y", ignore_index=True)
        y, n = part["y"].to_numpy(), part["n"].to_numpy()
        tables = [np.stack([part["low"].to_numpy(), part["next"].to_numpy()], axis=1)]
        while (step := 1 << len(tables) - 1) * 2 <= len(y):
            tables.append(least(tables[-1][:-step], tables[-1][step:]))
        before = np.concatenate([[0], np.cumsum(n)])

        def over(low, high):  # rows, and the two least keys, of the values low to high - 1
            span = np.frexp(high - low)[1] - 1
            keys = np.empty((len(low), 2), np.int64)
            for k in np.unique(span):
                at = span == k
                keys[at] = least(tables[k][low[at]], tables[k][high[at] - (1 << k)])
            return before[high] - before[low], keys

        place = np.linspace(0, 1, 11)[1:-1] * (before[-1] - 1)
        at = lambda p: y[np.searchsorted(before, p, side="right") - 1]
        low, up = at(np.floor(place)), at(np.ceil(place))
        tenth = np.searchsorted(low + (up - low) * (place - np.floor(place)), y, side="right")
        bounds = {
            "caliper": (np.searchsorted(y, y - width), np.searchsorted(y, y + width, side="right")),
            "decile": (np.searchsorted(tenth, tenth), np.searchsorted(tenth, tenth, side="right")),
            "any": (np.zeros(len(y), np.int64), np.full(len(y), len(y))),
        }
        out, left = part[["g", "y"]].assign(n=0, a=0, b=0, tier=""), np.ones(len(y), bool)
        for tier, (low, high) in bounds.items():
            found, keys = over(low, high)
            now = left & (found > 1)
            out.loc[now, "n"], out.loc[now, "a"], out.loc[now, "b"], out.loc[now, "tier"] = found[now] - 1, keys[now, 0], keys[now, 1], tier
            left &= ~now
        return out[~left]

    rows = rows.select(F.col(key).alias("k"), F.col(group).alias("g"), F.col(value).alias("y"))
    same = rows.groupBy("g", "y").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("low"))
    second = rows.join(same.where("n > 1").select("g", "y", "low"), ["g", "y"]).where("k > low").groupBy("g", "y").agg(F.min("k").alias("next"))
    met = same.join(second, ["g", "y"], "left").withColumn("next", F.coalesce("next", F.lit(none)))
    g, k = rows.schema["g"].dataType.simpleString(), rows.schema["k"].dataType
    tiers = met.groupBy("g").applyInPandas(run, f"g {g}, y double, n long, a long, b long, tier string")
    first = F.when(F.col("a") == F.col("k"), F.col("b")).otherwise(F.col("a"))
    return rows.join(tiers, ["g", "y"]).select(F.col("k").alias(key), "n", first.cast(k).alias("first"), "tier")


def coverage(rows: DataFrame, keys: list[str], year: str = "year", actual: Column | None = None) -> DataFrame:
    """First, last and number of years, gaps, and the last year that is no forecast."""
    return rows.groupBy(*keys).agg(
        F.min(year).alias("first_year"),
        F.max(year).alias("last_year"),
        F.countDistinct(year).alias("n_years"),
        (F.max(year) - F.min(year) + 1 - F.countDistinct(year)).cast("int").alias("gaps"),
        F.max(F.when(actual if actual is not None else F.lit(True), F.col(year))).alias("last_actual"),
    )


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """check and n: rows of each frame that should be empty."""
    out = None
    for name, bad in checks.items():
        one = bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
        out = one if out is None else out.unionAll(one)
    return out


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), union))
