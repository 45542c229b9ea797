"""Queries that put what is known of a profile, or of a pair, into one row."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bands as B
from ..operators import corpus as C
from ..operators import metrics as M
from ..operators import search as S
from .profile import BLEND, GRID_SQL, search_sql
from .registry import on_profiles, query, r6
from .series import LEVELS, levels

ANCHOR, HORIZONS = (7, 1996), (1, 2, 3)
BINS = {"low": (0, 1), "mid": (2, 6), "high": (7, 9)}


def shares(spark, d):
    """entity, year and the share of the bins of each of BINS, both sides together, from counts."""
    part = lambda low, high: F.sum(F.when(F.col("bin").between(low, high), F.col("pop")).otherwise(0.0)) / F.sum("pop")
    return C.cells(spark, d).groupBy("entity", "year").agg(*[part(*b).alias(n) for n, b in BINS.items()])


SHARES = "sh AS (SELECT entity, year, " + ", ".join(f"sum(CASE WHEN bin BETWEEN {a} AND {b} THEN pop ELSE 0 END) / sum(pop) AS {n}" for n, (a, b) in BINS.items()) + " FROM cells GROUP BY entity, year)"
NEARNESS = "CASE WHEN entity = {0} AND year = {1} THEN 'the anchor' WHEN pct <= 0.05 THEN 'nearest 5 %' WHEN pct <= 0.1 THEN 'nearest 10 %' WHEN pct <= 0.25 THEN 'nearest quarter' WHEN pct <= 0.5 THEN 'nearest half' ELSE 'farther half' END".format(*ANCHOR)


@query("disconnect_rows", on_profiles(
    f"SELECT entity, year, {', '.join(f'round({n}, 6) + 0.0 AS {n}' for n in BINS)}, round(low / nullif(mid, 0), 6) + 0.0 AS low_to_mid, d + 0.0 AS d, round(pct, 6) AS pct, {NEARNESS} AS band, {', '.join(f'round(m{h}, 6) + 0.0 AS m{h}' for h in HORIZONS)}, round(y_last / y, 6) + 0.0 AS m_last, CASE WHEN y IS NULL THEN 'no level' WHEN year + {HORIZONS[-1]} <= last THEN 'ok' ELSE 'clipped to ' || last END AS state FROM (SELECT sh.*, da.d, cume_dist() OVER (PARTITION BY year ORDER BY da.d) AS pct, lv.y, ll.y AS y_last, ll.last, {', '.join(f'l{h}.y / lv.y AS m{h}' for h in HORIZONS)} FROM sh JOIN da USING (entity, year) LEFT JOIN lv USING (entity, year) LEFT JOIN ll USING (entity) {' '.join(f'LEFT JOIN lv l{h} ON l{h}.entity = sh.entity AND l{h}.year = sh.year + {h}' for h in HORIZONS)})",
    f"{LEVELS}, {SHARES}, ll AS (SELECT entity, max(year) AS last, arg_max(y, year) AS y FROM lv GROUP BY entity), an AS (SELECT pos, s, c FROM p WHERE entity = {ANCHOR[0]} AND year = {ANCHOR[1]}), da AS (SELECT b.entity, b.year, round({BLEND.replace('a.', 'an.')}, 9) AS d FROM p b JOIN an USING (pos) GROUP BY b.entity, b.year)"))
def disconnect_rows(spark, d):
    """Every profile in a row: shares and their ratio, distance to an anchor with its percentile among the year's and its band, and how its level went on, cut at the last year there is."""
    p = C.profiles(spark, d).select("entity", "year", "s", "c")
    anchor = p.where((F.col("entity") == ANCHOR[0]) & (F.col("year") == ANCHOR[1])).select(F.col("s").alias("b_s"), F.col("c").alias("b_c"))  # one row
    rows = p.join(F.broadcast(anchor)).select("entity", "year", F.round(M.distance("blend"), 9).alias("d")).join(shares(spark, d), ["entity", "year"])
    rows = rows.withColumn("pct", F.cume_dist().over(Window.partitionBy("year").orderBy("d")))
    lv = levels(spark, d)
    last = lv.groupBy("entity").agg(F.max("year").alias("last"), F.max_by("y", "year").alias("y_last"))
    after = Window.partitionBy("entity").orderBy("year")
    ahead = lv.select("entity", "year", "y", *[F.first("y").over(after.rangeBetween(h, h)).alias(f"y{h}") for h in HORIZONS])
    met = rows.join(ahead, ["entity", "year"], "left").join(last, "entity", "left")
    at = (F.col("entity") == ANCHOR[0]) & (F.col("year") == ANCHOR[1])
    near = lambda limit: F.col("pct") <= limit
    band = F.when(at, "the anchor").when(near(0.05), "nearest 5 %").when(near(0.1), "nearest 10 %").when(near(0.25), "nearest quarter").when(near(0.5), "nearest half").otherwise("farther half")
    state = F.when(F.col("y").isNull(), "no level").when(F.col("year") + HORIZONS[-1] <= F.col("last"), "ok").otherwise(F.concat(F.lit("clipped to "), F.col("last").cast("string")))
    over = lambda c: r6(F.try_divide(F.col(c), F.col("y")))
    return met.select("entity", "year", *[r6(n).alias(n) for n in BINS], r6(F.try_divide("low", "mid")).alias("low_to_mid"), (F.col("d") + F.lit(0.0)).alias("d"), F.round("pct", 6).alias("pct"), band.alias("band"), *[over(f"y{h}").alias(f"m{h}") for h in HORIZONS], over("y_last").alias("m_last"), state.alias("state"))


@query("pair_page", on_profiles(
    f"SELECT r.entity, r.year, r.b_entity, r.d + 0.0 AS d, 'same:' || r.year AS band_kind, CASE WHEN r.d >= q[{B.P95 + 1}] THEN 'extreme' WHEN r.d >= q[{B.P75 + 1}] THEN 'far' WHEN r.d <= q[{B.P5 + 1}] THEN 'very_close' WHEN r.d <= q[{B.P25 + 1}] THEN 'close' ELSE 'typical' END AS label, {', '.join(f'round(y.{n} - x.{n}, 6) + 0.0 AS d_{n}' for n in BINS)}, CASE WHEN round(abs(y.low - x.low), 9) >= round(abs(y.high - x.high), 9) THEN 'low' ELSE 'high' END AS differs, format('{{}} % of all at the low end against {{}} %', (round(100 * x.low)::INT)::VARCHAR, (round(100 * y.low)::INT)::VARCHAR) AS said FROM ranked r JOIN bq USING (year) JOIN sh x ON x.entity = r.entity AND x.year = r.year JOIN sh y ON y.entity = r.b_entity AND y.year = r.year WHERE r.rank = 1",
    search_sql("a.year = b.year")[1] + f", {SHARES}, bq AS (SELECT year, quantile_cont(d, {GRID_SQL}) AS q FROM dd GROUP BY year)"))
def pair_page(spark, d):
    """Every profile with its nearest of the year: distance, the band it is held against and its label, how shares differ, which end differs most, and a sentence."""
    p = C.profiles(spark, d)
    found = S.matches(p, S.Query())
    grid = B.bands(found, "year").select("year", "q")
    own = shares(spark, d)
    other = own.select(F.col("entity").alias("b_entity"), "year", *[F.col(n).alias(f"b_{n}") for n in BINS])
    met = S.top(S.best_of_entity(found), 1).join(grid, "year").join(own, ["entity", "year"]).join(other, ["b_entity", "year"])
    gap = lambda n: F.col(f"b_{n}") - F.col(n)
    differs = F.when(F.round(F.abs(gap("low")), 9) >= F.round(F.abs(gap("high")), 9), "low").otherwise("high")
    percent = lambda c: F.round(100 * F.col(c)).cast("int").cast("string")
    said = F.format_string("%s %% of all at the low end against %s %%", percent("low"), percent("b_low"))
    return met.select("entity", "year", "b_entity", (F.col("d") + F.lit(0.0)).alias("d"), F.concat(F.lit("same:"), F.col("year").cast("string")).alias("band_kind"), B.label(F.col("d"), F.col("q")).alias("label"), *[r6(gap(n)).alias(f"d_{n}") for n in BINS], differs.alias("differs"), said.alias("said"))
