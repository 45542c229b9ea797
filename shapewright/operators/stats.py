"""Backtest statistics: prototypes, soft minima, standard errors, regressions by moments, bootstraps, decisions.

Sums over rows are made by Spark; what is solved on the driver are matrices of a few columns and series of a few periods.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_share(rows: DataFrame, value: str, share: float, by: list[str]) -> DataFrame:
    """Rows at or above the linear-interpolated quantile 1 - share of their group."""
    limits = rows.groupBy(*by).agg(F.percentile(value, 1 - share).alias("_limit"))
    return rows.join(limits, by).where(F.round(F.col(value), 12) >= F.round("_limit", 12)).drop("_limit")


def spaced(rows: DataFrame, key: str, year: str, rank: str, most: int, gap: int) -> DataFrame:
    """At most so many rows of each key, best rank first, each at least gap years from those taken.

    Each round takes a key's best row that is left and removes its neighbours; there are `most` rounds, each one window.
    """
    left, taken = rows, None
    for _ in range(most):
        first = left.groupBy(key).agg(F.min_by(F.struct(*rows.columns), rank).alias("r")).select("r.*")
        taken = first if taken is None else taken.unionAll(first)
        near = first.select(F.col(key).alias("_k"), F.col(year).alias("_y"))
        left = left.join(near, (F.col(key) == F.col("_k")) & (F.abs(F.col(year) - F.col("_y")) < gap), "left_anti")
    return taken


def soft_minimum(distances: DataFrame, keys: list[str], d: str = "d", tau: float = 0.25) -> DataFrame:
    """least, second and soft minimum of each key: -tau * log sum exp(-d / tau), stable by the least. second is null where there is one distance only."""
    least = distances.groupBy(*keys).agg(F.min(d).alias("least"))
    met = distances.join(least, keys)
    out = met.groupBy(*keys, "least").agg(F.count(F.when(F.col(d) == F.col("least"), 1)).alias("_n"), F.min(F.when(F.col(d) > F.col("least"), F.col(d))).alias("_next"), F.sum(F.exp(-(F.col(d) - F.col("least")) / tau)).alias("_e"))
    return out.select(*keys, "least", F.when(F.col("_n") > 1, F.col("least")).otherwise(F.col("_next")).alias("second"), (F.col("least") - tau * F.log("_e")).alias("soft"))


def totals_before(rows: DataFrame, order: str, amount: Column, parts: int = 64) -> DataFrame:
    """rows with before, the sum of amount over all rows of smaller order; orders are different from each other.

    Rows are dealt into so many stretches by quantiles of order; each stretch is summed on its own, and only the stretches' totals,
    `parts` rows at most, are summed in one place.
    """
    cuts = rows.agg(F.percentile_approx(order, F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(1000)).alias("_cuts"))  # one row
    dealt = rows.withColumn("_amount", amount).join(F.broadcast(cuts)).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col(order)))).drop("_cuts")
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_part").agg(F.sum("_amount").alias("_sum"))
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(ahead(Window.orderBy("_part"))), F.lit(0)).alias("_offset"))
    inner = F.coalesce(F.sum("_amount").over(ahead(Window.partitionBy("_part").orderBy(order))), F.lit(0))
    return dealt.withColumn("_inner", inner).join(F.broadcast(offsets), "_part").withColumn("before", F.col("_offset") + F.col("_inner")).drop("_part", "_amount", "_inner", "_offset")


def average_ranks(rows: DataFrame, value: str, name: str) -> DataFrame:
    """rows with the rank of a value from 1, ties sharing their mean: values are counted before they are ordered."""
    counted = rows.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = totals_before(counted, value, F.col("_n")).select(value, (F.col("before") + (F.col("_n") + 1) / 2).alias(name))
    return rows.join(ranked, value)


def cluster_se(rows: DataFrame, value: str, cluster: str) -> DataFrame:
    """mean and the standard error of a mean with clustered rows, by sums of clusters."""
    sums = rows.groupBy(cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    mean = sums.agg((F.sum("s") / F.sum("n")).alias("mean"), F.sum("n").alias("total"))
    return sums.join(F.broadcast(mean)).groupBy("mean", "total").agg((F.sqrt(F.sum((F.col("s") - F.col("n") * F.col("mean")) ** 2)) / F.first("total")).alias("se")).select("mean", "se")


def moments(rows: DataFrame, y: str, xs: list[str]) -> dict[str, float]:
    """Sums of products of the columns and a constant: all that least squares needs of the rows."""
    cols = {"one": F.lit(1.0), **{x: F.col(x).cast("double") for x in xs}, "y": F.col(y).cast("double")}
    names = list(cols)
    row = rows.agg(*[F.sum(cols[a] * cols[b]).alias(f"{a}|{b}") for i, a in enumerate(names) for b in names[i:]]).first()
    return row.asDict()


def ols(rows: DataFrame, y: str, xs: list[str]) -> tuple[list[float], np.ndarray]:
    """Coefficients (constant first) and the inverse of X'X."""
    m, names = moments(rows, y, xs), ["one", *xs]
    get = lambda a, b: m.get(f"{a}|{b}", m.get(f"{b}|{a}"))
    inverse = np.linalg.inv(np.array([[get(a, b) for b in names] for a in names]))
    return [float(b) for b in inverse @ np.array([get(a, "y") for a in names])], inverse


def clustered_ols(rows: DataFrame, y: str, xs: list[str], cluster: str) -> list[tuple[float, float]]:
    """Coefficients and standard errors clustered by a column: score sums by cluster, a sandwich of a few columns."""
    beta, inverse = ols(rows, y, xs)
    residual = F.col(y) - sum((F.lit(b) * (F.lit(1.0) if x is None else F.col(x)) for b, x in zip(beta, [None, *xs], strict=True)), F.lit(0.0))
    scores = rows.groupBy(cluster).agg(*[F.sum(residual * (F.lit(1.0) if x is None else F.col(x))).alias(f"s{i}") for i, x in enumerate([None, *xs])])
    n = len(xs) + 1
    meat_row = scores.agg(*[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"{i}|{j}") for i in range(n) for j in range(n)]).first()
    meat = np.array([[meat_row[f"{i}|{j}"] for j in range(n)] for i in range(n)])
    v = inverse @ meat @ inverse
    return [(b, math.sqrt(max(x, 0.0))) for b, x in zip(beta, np.diag(v), strict=True)]


def sandwich_ols(rows: DataFrame, y: str, xs: list[str], parts: list[tuple[int, list[str]]]) -> list[tuple[float, float]]:
    """Coefficients and standard errors of a signed sum of cluster variances; parts: sign and columns of each clustering (Cameron, Gelbach, Miller)."""
    beta, inverse = ols(rows, y, xs)
    scored, n = with_scores(rows, y, xs, beta), len(xs) + 1
    meat = np.zeros((n, n))
    for sign, by in parts:
        sums = scored.groupBy(*by).agg(*[F.sum(f"_s{i}").alias(f"s{i}") for i in range(n)])
        row = sums.agg(*[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"{i}|{j}") for i in range(n) for j in range(n)]).first()
        meat += sign * np.array([[row[f"{i}|{j}"] for j in range(n)] for i in range(n)])
    return [(b, math.sqrt(max(x, 0.0))) for b, x in zip(beta, np.diag(inverse @ meat @ inverse), strict=True)]


def with_scores(rows: DataFrame, y: str, xs: list[str], beta: list[float]) -> DataFrame:
    """rows with _s0, _s1, ...: the residual times the constant and each regressor."""
    terms = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    residual = F.col(y) - sum((F.lit(float(b)) * t for b, t in zip(beta, terms, strict=True)), F.lit(0.0))
    return rows.withColumns({f"_s{i}": residual * t for i, t in enumerate(terms)})


def driscoll_kraay_ols(rows: DataFrame, y: str, xs: list[str], period: str, lags: int) -> list[tuple[float, float]]:
    """Coefficients and Driscoll-Kraay standard errors: scores are summed by period, products of the sums up to so many lags weighed by Bartlett's kernel.

    Lags count periods that occur. What Spark returns is one row of sums over the periods.
    """
    beta, inverse = ols(rows, y, xs)
    n = len(xs) + 1
    sums = with_scores(rows, y, xs, beta).groupBy(period).agg(*[F.sum(f"_s{i}").alias(f"s{i}") for i in range(n)])
    w = Window.orderBy(period)  # one row for each period
    held = sums.select(*[F.col(f"s{i}") for i in range(n)], *[F.lag(f"s{i}", k).over(w).alias(f"s{i}_{k}") for i in range(n) for k in range(1, lags + 1)])
    cross = {(i, j, k): F.coalesce(F.sum(F.col(f"s{i}") * F.col(f"s{j}_{k}" if k else f"s{j}")), F.lit(0.0)) for i in range(n) for j in range(n) for k in range(lags + 1)}
    row = held.agg(*[c.alias("|".join(map(str, k))) for k, c in cross.items()]).first()
    lag = lambda k: np.array([[row[f"{i}|{j}|{k}"] for j in range(n)] for i in range(n)])
    meat = lag(0) + sum((1 - k / (lags + 1)) * (lag(k) + lag(k).T) for k in range(1, lags + 1))
    return [(b, math.sqrt(max(x, 0.0))) for b, x in zip(beta, np.diag(inverse @ meat @ inverse), strict=True)]


def long_run(rows: DataFrame, period: str, value: str, lags: int) -> DataFrame:
    """n, uniform and bartlett: long-run variances of a series with one row for each period, by autocovariances up to so many lags."""
    mean = rows.agg(F.avg(value)).scalar()
    w = Window.orderBy(period)  # one row for each period
    u = rows.select(period, (F.col(value) - mean).alias("u"))
    held = u.select("u", *[F.lag("u", k).over(w).alias(f"u{k}") for k in range(1, lags + 1)])
    gamma = [F.sum(F.col("u") * F.col(f"u{k}" if k else "u")) / F.count(F.lit(1)) for k in range(lags + 1)]
    total = lambda weigh: sum((F.coalesce(g, F.lit(0.0)) * weigh(k) for k, g in enumerate(gamma)), F.lit(0.0))
    return held.agg(F.count(F.lit(1)).alias("n"), total(lambda k: 2.0 if k else 1.0).alias("uniform"), total(lambda k: 2.0 * (1 - k / (lags + 1)) if k else 1.0).alias("bartlett"))


def long_run_variance(x: list[float], lags: int, bartlett: bool = True) -> float:
    """Of a series of a few periods: weighted autocovariances of demeaned values; uniform weights fall back to Bartlett's if not positive."""
    u = np.asarray(x, float) - np.mean(x)
    gamma = [float(u[j:] @ u[: len(u) - j]) / len(u) for j in range(min(lags, len(u) - 1) + 1)]
    total = gamma[0] + 2 * sum((1 - j / (lags + 1) if bartlett else 1.0) * g for j, g in enumerate(gamma) if j)
    return total if total > 0 or bartlett else long_run_variance(x, lags)


def normal_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def sign_test(wins: int, losses: int) -> float:
    """Two-sided exact binomial p of wins against losses."""
    n, k = wins + losses, min(wins, losses)
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0


def sign_p(wins: Column, losses: Column) -> Column:
    """sign_test() as a column: the logarithm of each binomial term from the one before."""
    n, k = wins + losses, F.least(wins, losses)
    start = F.struct((-n * math.log(2)).cast("double").alias("log"), F.exp(-n * math.log(2)).cast("double").alias("sum"))

    def step(a: Column, i: Column) -> Column:
        log = a["log"] + F.log((n - i + 1) / i)
        return F.struct(log.alias("log"), (a["sum"] + F.exp(log)).alias("sum"))

    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(F.filter(F.sequence(F.lit(0).cast("long"), k), lambda i: i > 0), start, step)["sum"]))


def uniform_of(*key: Column) -> Column:
    """A value in [0, 1) by md5 of keys: the same in every engine and on every retry."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[k.cast("string") for k in key])), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def distinct_places(n: Column, k: int, *key: Column) -> Column:
    """k different places from 0 to n - 1 in ascending order, by md5 of the key and which of them it is; all n where there are no more.

    The i-th is drawn from the n - i that are left: it is moved past each smaller one already taken.
    """
    start = F.array().cast("array<long>")

    def step(taken: Column, i: Column) -> Column:
        drawn = F.floor(uniform_of(*key, i) * (n - i)).cast("long")
        place = F.aggregate(taken, drawn, lambda p, t: p + (p >= t).cast("long"))
        return F.array_sort(F.array_append(taken, place))

    return F.aggregate(F.when(n > 0, F.sequence(F.lit(0).cast("long"), F.least(n, F.lit(k)).cast("long") - 1)).otherwise(start), start, step)


def draws_of(rows: DataFrame, by: list[str], order: str, value: str, k: int, draws: int, seed: int) -> DataFrame:
    """draw, the columns by, and value of k rows of each group drawn without replacement, so many times.

    Rows are numbered within their group once; a draw takes k numbers, and only these meet the rows. So draws cost what they take, not
    what they choose from.
    """
    numbered = rows.select(*by, value, (F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1).cast("long").alias("place"))
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    drawn = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))))
    places = drawn.select("draw", *by, F.explode(distinct_places(F.col("_n"), k, F.lit(seed), F.col("draw"), *[F.col(b) for b in by])).alias("place"))
    return places.join(numbered, [*by, "place"]).drop("place")


def bootstrap_means(group_sums: DataFrame, draws: int, key: str = "g", seed: int = 7, block: int = 1) -> DataFrame:
    """draw and mean: in each draw every group is replaced by one hashed at random, as groups are numbered 0 to n - 1.

    Groups are summed before they are drawn, so a draw costs as many rows as there are groups. With a block, so many groups in a row
    are drawn at once, the first following on the last, and the last block is cut at n. group_sums: key, s, n.
    """
    numbered = totals_before(group_sums, key, F.lit(1)).withColumnRenamed("before", "i")
    size = numbered.agg(F.count(F.lit(1))).scalar()
    spark = group_sums.sparkSession
    slots = spark.range(draws).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0), size.cast("int") - 1)).alias("slot"))
    begin = F.floor(uniform_of(F.lit(seed), F.col("draw"), F.floor(F.col("slot") / block)) * size)
    picked = slots.withColumn("i", ((begin + F.col("slot") % block) % size).cast("long"))
    return picked.join(numbered, "i").groupBy("draw").agg((F.sum("s") / F.sum("n")).alias("mean"))


def granted(conditions: DataFrame) -> DataFrame:
    """level and granted: all of a level's conditions hold; one that is not known counts as not met. conditions: level, name, met."""
    return conditions.groupBy("level").agg(F.min(F.coalesce("met", F.lit(False))).alias("granted"))
