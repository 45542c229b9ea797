"""Panel regressions with absorbed fixed effects, and their hold-out.

The effects of cells, such as a region's decade, are taken out of the moments: within sums of products are sums over rows less those of
the cells' means, so that no column is made for any cell and what reaches the driver are sums of a few regressors. A cell's effect is its
mean of y less that of the regressors; a cell that the fit has not seen takes the effect of the latest one of its region.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stats as St


@dataclass
class Fit:
    xs: list[str]
    beta: list[float]
    n: int
    n_cells: int
    r2: float


def means(rows: DataFrame, columns: list[str], cell: list[str]) -> DataFrame:
    """cell, n and m_ of each column: one row for each cell."""
    return rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in columns])


def within(rows: DataFrame, columns: list[str], cell: list[str]) -> DataFrame:
    """rows with the columns less their cell's means."""
    met = rows.join(means(rows, columns, cell).drop("n"), cell)
    return met.withColumns({c: F.col(c) - F.col(f"m_{c}") for c in columns}).drop(*[f"m_{c}" for c in columns])


def fitted(rows: DataFrame, y: str, xs: list[str], cell: list[str]) -> Fit:
    """Least squares of y on xs and an effect for each cell, from one aggregation by cell and one over cells."""
    names = [*xs, y]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    shift = rows.agg(*[F.avg(c).alias(c) for c in names]).first()  # a common shift keeps the sums of products small
    if shift[y] is None:
        raise ValueError("there are no rows to fit")
    at = {c: F.col(c) - F.lit(float(shift[c])) for c in names}
    by_cell = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), *[F.sum(at[c]).alias(c) for c in names], *[F.sum(at[a] * at[b]).alias(f"{a}|{b}") for a, b in pairs])
    row = by_cell.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("cells"), F.sum(f"{y}|{y}").alias("total"), *[F.sum(F.col(f"{a}|{b}") - F.col(a) * F.col(b) / F.col("n")).alias(f"{a}|{b}") for a, b in pairs]).first()
    get = lambda a, b: row[f"{a}|{b}"] if f"{a}|{b}" in row.asDict() else row[f"{b}|{a}"]
    xx, xy = np.array([[get(a, b) for b in xs] for a in xs]), np.array([get(a, y) for a in xs])
    beta = np.linalg.lstsq(xx, xy, rcond=None)[0]
    left = get(y, y) - beta @ xy
    return Fit(xs, [float(b) for b in beta], row["n"], row["cells"], 1 - float(left) / row["total"] if row["total"] else float("nan"))


def spec_rows(rows: DataFrame, y: str, specs: dict[str, list[str]], cell: list[str], entity: str, period: str, lags: int) -> list[tuple]:
    """(spec, term, beta, se_dk, se_2way, r2, n, n_cells): Driscoll-Kraay and two-way clustered standard errors of every spec's terms."""
    out = []
    inner = within(rows, list(dict.fromkeys([y, *[x for xs in specs.values() for x in xs]])), cell).persist()
    for name, xs in specs.items():
        fit = fitted(rows, y, xs, cell)
        kraay = St.driscoll_kraay_ols(inner, y, xs, period, lags)[1:]
        both = St.sandwich_ols(inner, y, xs, [(1, [entity]), (1, [period]), (-1, [entity, period])])[1:]
        out += [(name, x, b, dk[1], tw[1], fit.r2, fit.n, fit.n_cells) for x, b, dk, tw in zip(xs, fit.beta, kraay, both, strict=True)]
    inner.unpersist()
    return out


def effects(rows: DataFrame, fit: Fit, y: str, cell: list[str]) -> DataFrame:
    """cell and its effect."""
    out = means(rows, [y, *fit.xs], cell)
    return out.select(*cell, (F.col(f"m_{y}") - sum((F.lit(b) * F.col(f"m_{x}") for b, x in zip(fit.beta, fit.xs, strict=True)), F.lit(0.0))).alias("effect"))


def held_out(rows: DataFrame, y: str, specs: dict[str, list[str]], region: str, block: str, learn: Column, test: Column) -> DataFrame:
    """The test rows of regions that the fit has seen, with pred_mean and pred_ of each spec.

    Cells are blocks of time of a region; a test row takes the effect of its region's latest block among the rows to learn from.
    """
    train, out = rows.where(learn), rows.where(test)
    last = train.groupBy(region).agg(F.max(block).alias("_last"))
    out = out.join(last, region)
    for name, xs in specs.items():
        fit = fitted(train, y, xs, [region, block])
        own = effects(train, fit, y, [region, block]).select(F.col(region), F.col(block).alias("_last"), "effect")
        value = F.col("effect") + sum((F.lit(b) * F.col(x) for b, x in zip(fit.beta, xs, strict=True)), F.lit(0.0))
        out = out.join(own, [region, "_last"]).withColumn(f"pred_{name}", value).drop("effect")
    return out.withColumn("pred_mean", train.agg(F.avg(y)).scalar()).drop("_last")


def rank_correlations(rows: DataFrame, a: Column, b: Column, period: str) -> DataFrame:
    """period and rho: the correlation of average ranks of two values within each period that has three rows at least."""
    w = Window.partitionBy("_t")
    ranked = rows.select(F.col(period).alias("_t"), F.round(a, 9).alias("_a"), F.round(b, 9).alias("_b"))
    mean = lambda c: F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("_t", c)) - 1) / 2
    both = ranked.select("_t", mean("_a").alias("_ra"), mean("_b").alias("_rb"))
    return both.groupBy(F.col("_t").alias(period)).agg(F.count(F.lit(1)).alias("_n"), F.corr("_ra", "_rb").alias("rho")).where("_n >= 3").drop("_n")
