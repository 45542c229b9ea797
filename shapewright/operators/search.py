"""Similarity search set-at-a-time: candidates, nearest and farthest, best years, isolation, diversification."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import matrix, met
from .corpus import WIDTH, pairs
from .metrics import SIGMA, distance

FIELDS = ["entity", "year", "total", "s", "c", "s1", "c1"]
MODES = ("same", "today", "near", "range", "any")


@dataclass(frozen=True)
class Query:
    """Who may be a candidate. era_cut: last observed year; queries after it lift the cut unless era is `obs` for good (era_resolved)."""

    mode: str = "same"
    n: int = 1
    first: int | None = None
    last: int | None = None
    era_cut: int | None = None
    era: str = "obs"
    era_resolved: bool = False
    today: int = 2001
    floor: float = 0.0
    trend: int | None = None
    first_year: int = 1995

    def __post_init__(self) -> None:
        if self.mode not in MODES or self.era not in ("obs", "all"):
            raise ValueError(f"mode {self.mode!r} or era {self.era!r} is unknown")
        if self.first is not None and self.last is not None and self.first > self.last:
            low, high = self.last, self.first
            object.__setattr__(self, "first", low)
            object.__setattr__(self, "last", high)


def candidates(q: Query) -> Column:
    """The condition under which b_ columns are a candidate for a row; own entity never is."""
    y, by = F.col("year"), F.col("b_year")
    cond = {
        "same": by == y,
        "today": by == q.today,
        "near": F.abs(by - y) <= q.n,
        "range": by.between(q.first if q.first is not None else 0, q.last if q.last is not None else 9999),
        "any": F.lit(True),
    }[q.mode]
    cond = cond & (F.col("b_entity") != F.col("entity")) & (F.col("b_total") >= q.floor)
    if q.era == "obs" and q.era_cut is not None:
        cond = cond & ((by <= q.era_cut) | (F.lit(not q.era_resolved) & (y > q.era_cut)))
    if q.trend:
        cond = cond & (y - q.trend >= q.first_year) & (by - q.trend >= q.first_year)
    return cond


def matches(profiles: DataFrame, q: Query, metric: str = "blend", extra: tuple[str, ...] = ()) -> DataFrame:
    """entity, year, b_entity, b_year, dy, d for each query row and candidate; filters run before distances."""
    fields = [*FIELDS, *extra]
    if q.mode == "near":  # each year allowed is a key of an equi-join
        asked = profiles.select(*fields, F.explode(F.sequence(F.col("year") - q.n, F.col("year") + q.n)).alias("_by"))
        other = profiles.select(*[F.col(c).alias(f"b_{c}") for c in fields])
        met = asked.join(other, (F.col("_by") == F.col("b_year")) & candidates(q))
    else:
        met = pairs(profiles, profiles, candidates(q), fields)
    return met.select("entity", "year", "b_entity", "b_year", (F.col("b_year") - F.col("year")).cast("int").alias("dy"), F.round(distance(metric), 9).alias("d")).where(~F.isnan("d"))


SCANNED = T.StructType([T.StructField(n, T.IntegerType()) for n in ("entity", "year", "b_entity", "b_year", "dy")] + [T.StructField("d", T.DoubleType())] + [T.StructField(n, T.IntegerType()) for n in ("lo", "hi")])
ASKED, HELD = 512, 2048
"""Profiles of a block that asks, and of one that is searched; a task holds the distances of one such pair."""


def allowed(q: Query, year: np.ndarray, b_year: np.ndarray, apart: np.ndarray, b_total: np.ndarray) -> np.ndarray:
    """candidates() for arrays of query rows by candidates."""
    by = np.broadcast_to(b_year, apart.shape)
    ok = {
        "same": lambda: by == year,
        "today": lambda: by == q.today,
        "near": lambda: np.abs(by - year) <= q.n,
        "range": lambda: (by >= (q.first if q.first is not None else 0)) & (by <= (q.last if q.last is not None else 9999)),
        "any": lambda: np.ones(apart.shape, bool),
    }[q.mode]()
    ok = ok & apart & (b_total >= q.floor)
    if q.era == "obs" and q.era_cut is not None:
        ok &= (by <= q.era_cut) | ((not q.era_resolved) & (year > q.era_cut))
    if q.trend:
        ok &= (year - q.trend >= q.first_year) & (by - q.trend >= q.first_year)
    return ok


def blended(asked: pa.RecordBatch, held: pa.RecordBatch) -> np.ndarray:
    """The blended distance of every profile of a block to every one of another."""
    s, c, bs, bc = (matrix(side.column(n)).T.copy() for side in (asked, held) for n in ("s", "c"))
    squares, moved = np.zeros((asked.num_rows, held.num_rows)), np.zeros((asked.num_rows, held.num_rows))
    for j in range(len(s)):
        gap = s[j][:, None] - bs[j][None, :]
        squares += gap * gap
        moved += np.abs(c[j][:, None] - bc[j][None, :])
    return np.round(0.5 * np.sqrt(squares) / SIGMA["l2"] + 0.5 * (WIDTH * moved) / SIGMA["w1sex"], 9)


def scanned(profiles: DataFrame, q: Query, farthest: bool = False, queries: DataFrame | None = None, own_years: bool = False) -> DataFrame:
    """What best_of_entity(matches()) gives for the blended distance, but for candidates of one entity that lie in different blocks.

    Blocks of query rows meet blocks of profiles in the executors; a pair of blocks gives one row for each query row and entity: its
    best year, and the first and last year (lo, hi) allowed. queries: the rows that ask, by default all profiles. own_years: the other years of
    a row's own entity are candidates too.
    """
    far = 1.0 if not farthest else -1.0

    def best(asked: pa.RecordBatch, held: pa.RecordBatch) -> pa.RecordBatch:
        order = np.lexsort((held.column("year").to_numpy(), held.column("entity").to_numpy()))
        held = held.take(pa.array(order))
        entity, year = (asked.column(n).to_numpy()[:, None] for n in ("entity", "year"))
        b_entity, b_year = held.column("entity").to_numpy(), held.column("year").to_numpy()
        d = blended(asked, held)
        apart = (b_entity[None, :] != entity) | (own_years & (b_year[None, :] != year))
        ok = allowed(q, year, b_year[None, :], apart, held.column("total").to_numpy()[None, :]) & ~np.isnan(d)
        starts = np.flatnonzero(np.concatenate(([True], b_entity[1:] != b_entity[:-1])))
        size = np.diff(np.append(starts, len(b_entity)))
        cost = np.where(ok, far * d, np.inf)
        least = np.minimum.reduceat(cost, starts, axis=1)
        tie = np.where(ok & (cost == np.repeat(least, size, axis=1)), np.abs(b_year - year).astype(np.int64) * 100_000 + b_year, np.iinfo(np.int64).max)
        at = np.minimum.reduceat(tie, starts, axis=1) % 100_000
        lo = np.minimum.reduceat(np.where(ok, b_year, 99_999), starts, axis=1)
        hi = np.maximum.reduceat(np.where(ok, b_year, -1), starts, axis=1)
        row, col = np.nonzero(np.isfinite(least))
        y, by = year[row, 0], at[row, col]
        out = {"entity": entity[row, 0], "year": y, "b_entity": b_entity[starts][col], "b_year": by, "dy": by - y, "d": far * least[row, col], "lo": lo[row, col], "hi": hi[row, col]}
        return pa.RecordBatch.from_pydict({n: pa.array(v, pa.float64() if n == "d" else pa.int32()) for n, v in out.items()})

    asked = (profiles if queries is None else queries).select("entity", "year", "s", "c")
    return met(asked, profiles.select("entity", "year", "total", "s", "c"), best, SCANNED, ["entity", "year"], ["entity"], ASKED, HELD)


def soft_minima(profiles: DataFrame, held: DataFrame, tau: float = 0.25, metric: str = "w1sex", group: str | None = None) -> DataFrame:
    """least, second and soft minimum of each profile's distances to the rows of held; both: entity, year, c, and s for the blended metric.

    group: a column of both sides, of an integer type, in which they must agree; a profile is then counted once for each of its values.
    Where profiles have a column tau it takes the place of tau. A pair of blocks gives a profile's two least distances and the sum of
    exp(-(d - least) / tau), which add up over blocks. second is null where there is one distance only; profiles with none are left out.
    """
    columns = ["entity", "year", "c", *(["s"] if metric == "blend" else []), *([group] if group else [])]
    own = [*columns, *(["tau"] if "tau" in profiles.columns else [])]
    keys = ["entity", "year", *([group] if group else [])]

    def least(asked: pa.RecordBatch, other: pa.RecordBatch) -> pa.RecordBatch:
        if metric == "blend":
            d = blended(asked, other)
        else:
            c, bc = matrix(asked.column("c")).T, matrix(other.column("c")).T
            d = np.zeros((asked.num_rows, other.num_rows))
            for j in range(len(c)):
                d += np.abs(c[j][:, None] - bc[j][None, :])
            d *= WIDTH
        if group:
            d[asked.column(group).to_numpy()[:, None] != other.column(group).to_numpy()[None, :]] = np.inf
        width = asked.column("tau").to_numpy()[:, None] if "tau" in asked.schema.names else tau
        d = np.concatenate((d, np.full((len(d), 1), np.inf)), axis=1)
        two = np.sort(np.partition(d, 1, axis=1)[:, :2], axis=1)
        with np.errstate(invalid="ignore"):
            e = np.exp(-(d - two[:, :1]) / width).sum(axis=1)
        some = np.flatnonzero(np.isfinite(two[:, 0]))
        pairs_ = [[x for x in r if np.isfinite(x)] for r in two[some].tolist()]
        arrays = [*[asked.column(k).take(pa.array(some)) for k in keys], pa.array(pairs_, pa.list_(pa.float64())), pa.array(e[some]), pa.array(np.broadcast_to(np.asarray(width, float), (len(d), 1))[some, 0])]
        return pa.RecordBatch.from_arrays(arrays, names=[*keys, "two", "e", "tau"])

    schema = T.StructType([*[profiles.schema[k] for k in keys], T.StructField("two", T.ArrayType(T.DoubleType())), T.StructField("e", T.DoubleType()), T.StructField("tau", T.DoubleType())])
    parts = met(profiles.select(own), held.select(columns), least, schema, keys, ["entity", "year"], ASKED, HELD)
    first = F.get("two", F.lit(0))
    least_ = parts.groupBy(*keys).agg(F.min(first).alias("least"))
    both = parts.join(least_, keys).groupBy(*keys, "least").agg(F.sum(F.col("e") * F.exp(-(first - F.col("least")) / F.col("tau"))).alias("e"), F.min(F.struct(first.alias("a"), F.get("two", F.lit(1)).alias("b"))).alias("m"), F.count(F.when(first == F.col("least"), 1)).alias("n"), F.min(F.when(first > F.col("least"), first)).alias("next"), F.first("tau").alias("tau"))
    second = F.when(F.col("n") > 1, F.col("least")).otherwise(F.least("m.b", "next"))
    return both.select(*keys, "least", second.alias("second"), (F.col("least") - F.col("tau") * F.log("e")).alias("soft"))


def found_by(profiles: DataFrame, q: Query, metric: str, farthest: bool = False) -> DataFrame:
    """entity, year, b_entity, b_year, dy, d: the best year of each candidate entity. Candidates of the same or near years meet in a join, others in a scan."""
    if metric == "blend" and q.mode not in ("same", "near"):
        return best_of_entity(scanned(profiles, q, farthest).drop("lo", "hi"), farthest)
    return best_of_entity(matches(profiles, q, metric), farthest)


def best_of_entity(found: DataFrame, farthest: bool = False) -> DataFrame:
    """One year of each candidate entity: nearest (or farthest), then smallest |dy|, then earliest."""
    order = F.desc("d") if farthest else F.asc("d")
    w = Window.partitionBy("entity", "year", "b_entity").orderBy(order, F.abs("dy"), "b_year")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top(found: DataFrame, k: int, farthest: bool = False) -> DataFrame:
    """rank 1 to k of each query row; Spark's group limit prunes before the shuffle."""
    order = F.desc("d") if farthest else F.asc("d")
    w = Window.partitionBy("entity", "year").orderBy(order, F.abs("dy"), "b_year", "b_entity")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similar(profiles: DataFrame, q: Query, k: int = 5, metric: str = "blend") -> DataFrame:
    return top(found_by(profiles, q, metric), k)


def different(profiles: DataFrame, q: Query, k: int = 5, metric: str = "blend") -> DataFrame:
    return top(found_by(profiles, q, metric, farthest=True), k, farthest=True)


POOL_SHARE, MOST_POOL = 4, 2000


def pooled(found: DataFrame, k: int) -> DataFrame:
    """The farthest candidates of each query row: a quarter of them, k at least and MOST_POOL at most."""
    n = found.groupBy("entity", "year").agg(F.count(F.lit(1)).alias("_n"))
    size = F.greatest(F.ceil(F.col("_n") / POOL_SHARE), F.lit(k))
    return top(found, MOST_POOL, farthest=True).join(n, ["entity", "year"]).where(F.col("rank") <= size).drop("_n")


def diversified(profiles: DataFrame, q: Query, k: int = 3, beta: float = 0.5, metric: str = "blend") -> DataFrame:
    """Greedy choice from the farthest candidates: each round takes the largest d + beta * distance to those chosen.

    k - 1 rounds are unrolled; a round is one join of the pool with the profiles chosen and one window.
    """
    w = Window.partitionBy("entity", "year")
    held = pooled(found_by(profiles, q, metric, farthest=True), k).withColumnRenamed("rank", "rank_raw")
    shape = profiles.select(*[F.col(c).alias(f"b_{c}") for c in FIELDS])
    held = held.join(shape, ["b_entity", "b_year"]).withColumn("near", F.lit(None).cast("double")).withColumn("turn", F.when(F.col("rank_raw") == 1, 1))
    for turn in range(2, k + 1):
        last = held.where(F.col("turn") == turn - 1).select("entity", "year", *[F.col(f"b_{c}").alias(c if c not in ("entity", "year") else f"last_{c}") for c in FIELDS])
        met = held.join(last, ["entity", "year"])
        near = F.round(distance(metric), 9)
        met = met.withColumn("near", F.least(F.coalesce("near", near), near)).select(held.columns)
        score = F.when(F.col("turn").isNull(), F.round(F.col("d") + beta * F.col("near"), 9))
        met = met.withColumn("score", score).withColumn("_n", F.row_number().over(w.orderBy(F.desc_nulls_last("score"), "rank_raw")))
        held = met.withColumn("turn", F.when(F.col("turn").isNull() & (F.col("_n") == 1), turn).otherwise(F.col("turn"))).drop("score", "_n")
    return held.where("turn IS NOT NULL").select("entity", "year", "b_entity", "b_year", "d", "rank_raw", "turn")


def best_years(profiles: DataFrame, q: Query, metric: str = "blend") -> DataFrame:
    """Best year of each candidate entity, and whether it lies at the edge of the years allowed."""
    found = scanned(profiles, q) if metric == "blend" else matches(profiles, q, metric).withColumns({"lo": F.col("b_year"), "hi": F.col("b_year")})
    edges = found.groupBy("entity", "year", "b_entity").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    best = best_of_entity(found.drop("lo", "hi")).join(edges, ["entity", "year", "b_entity"])
    return best.select("entity", "year", "b_entity", "b_year", "d", ((F.col("b_year") == F.col("lo")) | (F.col("b_year") == F.col("hi"))).alias("boundary_hit"))


def isolation(profiles: DataFrame, k: int = 5, floor: float = 0.0, metric: str = "blend") -> DataFrame:
    """Mean distance to the k nearest of the same year."""
    return top(matches(profiles, Query(floor=floor), metric), k).groupBy("entity", "year").agg(F.avg("d").alias("isolation"))


def own_trajectory(profiles: DataFrame, gap: int = 2, metric: str = "blend") -> DataFrame:
    """Nearest own year at least gap years away."""
    met = pairs(profiles, profiles, (F.col("entity") == F.col("b_entity")) & (F.abs(F.col("year") - F.col("b_year")) >= gap), FIELDS)
    d = met.select("entity", "year", "b_year", F.round(distance(metric), 9).alias("d"))
    return d.groupBy("entity", "year").agg(F.min(F.struct("d", F.abs(F.col("b_year") - F.col("year")).alias("g"), "b_year")).alias("m")).select("entity", "year", F.col("m.b_year").alias("b_year"), F.col("m.d").alias("d"))
