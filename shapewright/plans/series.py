"""Queries of time series and backtests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import series as T
from ..operators import stats as St
from ..session import table
from .registry import on_profiles, query, r6
from .relational import BARS, bars

LEVELS = "lv AS (SELECT c_nationkey AS entity, year(o_orderdate)::INT AS year, sum(o_totalprice) AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"


def levels(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), "o_totalprice").join(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("entity")), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy("entity", "year").agg(F.sum("o_totalprice").alias("y"))


GROWTH = LEVELS + ", gr AS (SELECT a.entity, a.year, 2 AS h, ln(b.y / a.y) / 2 AS g FROM lv a JOIN lv b ON a.entity = b.entity AND b.year = a.year + 2 UNION ALL SELECT a.entity, a.year, 3, ln(b.y / a.y) / 3 FROM lv a JOIN lv b ON a.entity = b.entity AND b.year = a.year + 3)"


def growths(spark, d):
    lv = levels(spark, d)
    return T.growth(lv, 2).withColumn("h", F.lit(2)).unionAll(T.growth(lv, 3).withColumn("h", F.lit(3)))


@query("growth_windows", f"WITH {GROWTH} SELECT entity, year, h::INT AS h, round(g, 6) + 0.0 AS g FROM gr")
def growth_windows(spark, d):
    return growths(spark, d).select("entity", "year", "h", r6("g").alias("g"))


@query("yoy_growth", f"WITH {LEVELS} SELECT entity, year, round(100 * ln(y / lag(y) OVER (PARTITION BY entity ORDER BY year)), 6) + 0.0 AS g FROM lv")
def yoy_growth(spark, d):
    w = Window.partitionBy("entity").orderBy("year")
    return levels(spark, d).select("entity", "year", r6(100 * F.log(F.try_divide(F.col("y"), F.lag("y").over(w)))).alias("g"))


@query("trailing_mean_min_count", f"WITH {LEVELS} SELECT entity, year, CASE WHEN count(y) OVER w >= 2 THEN round(avg(y) OVER w, 4) END AS m FROM lv WINDOW w AS (PARTITION BY entity ORDER BY year RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)")
def trailing_mean_min_count(spark, d):
    return levels(spark, d).select("entity", "year", F.round(T.trailing_mean("y", "entity", "year", 3, 2), 4).alias("m"))


@query("change_fwd_back", f"WITH {LEVELS} SELECT a.entity, a.year, round(coalesce(a.y - b.y, c.y - a.y), 4) + 0.0 AS change FROM lv a LEFT JOIN lv b ON b.entity = a.entity AND b.year = a.year - 3 LEFT JOIN lv c ON c.entity = a.entity AND c.year = a.year + 3")
def change_fwd_back(spark, d):
    return levels(spark, d).select("entity", "year", (F.round(T.change(3, "entity", "year", "y"), 4) + F.lit(0.0)).alias("change"))


SPLICE = LEVELS + """, sp AS (SELECT entity, year, CASE WHEN year <= 1997 THEN y END AS base, CASE WHEN (entity + year) % 5 <> 0 THEN y * 2 END AS w1, CASE WHEN (entity + year) % 7 <> 0 THEN y * 3 END AS w2 FROM lv),
rt AS (SELECT *, w1 / lag(w1) OVER w AS r1, w2 / lag(w2) OVER w AS r2 FROM sp WINDOW w AS (PARTITION BY entity ORDER BY year))"""


@query("splice_extend", f"WITH RECURSIVE {SPLICE}, rec AS (SELECT entity, year, base AS level, 'base' AS used FROM rt WHERE year = 1997 UNION ALL SELECT rt.entity, rt.year, rec.level * coalesce(r1, r2), CASE WHEN r1 IS NOT NULL THEN 'first' ELSE 'second' END FROM rec JOIN rt ON rt.entity = rec.entity AND rt.year = rec.year + 1 WHERE coalesce(r1, r2) IS NOT NULL) SELECT entity, year, round(level, 3) AS level, used FROM rec UNION ALL SELECT entity, year, round(base, 3), 'base' FROM rt WHERE year < 1997 AND base IS NOT NULL")
def splice_extend(spark, d):
    y = F.col("y")
    spine = levels(spark, d).select("entity", "year", F.when(F.col("year") <= 1997, y).alias("base"), F.when((F.col("entity") + F.col("year")) % 5 != 0, y * 2).alias("w1"), F.when((F.col("entity") + F.col("year")) % 7 != 0, y * 3).alias("w2"))
    return T.spliced(spine).where("level IS NOT NULL").select("entity", "year", F.round("level", 3).alias("level"), "used")


@query("drawdown", f"WITH {BARS} SELECT k, round(min(close / m - 1), 6) + 0.0 AS max_drawdown FROM (SELECT *, max(close) OVER (PARTITION BY k ORDER BY day) AS m FROM bars) GROUP BY k")
def drawdown(spark, d):
    return bars(spark, d).withColumn("dd", T.drawdown("k", "day", "close")).groupBy("k").agg(r6(F.min("dd")).alias("max_drawdown"))


@query("gap_guard", f"WITH {BARS}, h AS (SELECT * FROM bars WHERE day(day) % 4 < 2 OR k = 'click') SELECT k, count(*) AS n_bars, max(gap)::INT AS longest_gap, concat_ws(',', CASE WHEN count(*) < 20 THEN 'bars' END, CASE WHEN max(gap) > 2 THEN 'gap' END, CASE WHEN DATE '2024-02-02' - max(day) > 3 THEN 'live' END) AS failed FROM (SELECT *, day - lag(day) OVER (PARTITION BY k ORDER BY day) AS gap FROM h) GROUP BY k")
def gap_guard(spark, d):
    held = bars(spark, d).where((F.dayofmonth("day") % 4 < 2) | (F.col("k") == "click"))
    return T.guard(held, "k", "day", 20, 2, F.lit("2024-02-02").cast("date"), 3)


@query("calendar_ffill", f"WITH {BARS}, cal AS (SELECT DISTINCT day FROM bars), h AS (SELECT * FROM bars WHERE (day(day) + length(k)) % 3 = 0) SELECT k, day::VARCHAR AS day, round(last_value(close IGNORE NULLS) OVER (PARTITION BY k ORDER BY day), 6) + 0.0 AS close FROM (SELECT DISTINCT k FROM h) CROSS JOIN cal LEFT JOIN h USING (k, day)")
def calendar_ffill(spark, d):
    b = bars(spark, d)
    held = b.where((F.dayofmonth("day") + F.length("k")) % 3 == 0)
    return T.filled(held, b.select("day").distinct(), "k", "day", "close").select("k", F.col("day").cast("string").alias("day"), r6("close").alias("close"))


@query("year_end_level", "SELECT c_nationkey AS entity, year(o_orderdate)::INT AS year, round(arg_max(o_totalprice, (o_orderdate, o_orderkey)), 6) + 0.0 AS level FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def year_end_level(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").join(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("entity")), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy("entity", F.year("o_orderdate").alias("year")).agg(r6(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey"))).alias("level"))


@query("window_return", f"WITH {BARS}, w AS (SELECT *, max(close) OVER (PARTITION BY k ORDER BY day) AS m FROM bars WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-25') SELECT k, round(ln(arg_max(close, day) / arg_min(close, day)), 6) + 0.0 AS r_log, round(ln(arg_max(close, day) / arg_min(close, day)) / ((max(day) - min(day)) / 365.25), 5) + 0.0 AS r_ann, round(min(close / m - 1), 6) + 0.0 AS max_dd FROM w GROUP BY k")
def window_return(spark, d):
    w = bars(spark, d).where(F.col("day").between("2024-01-05", "2024-01-25")).withColumn("dd", T.drawdown("k", "day", "close"))
    r = F.log(F.try_divide(F.max_by("close", "day"), F.min_by("close", "day")))
    return w.groupBy("k").agg(r6(r).alias("r_log"), (F.round(r / (F.datediff(F.max("day"), F.min("day")) / 365.25), 5) + F.lit(0.0)).alias("r_ann"), r6(F.min("dd")).alias("max_dd"))


@query("proxy_legs", f"WITH {BARS}, r AS (SELECT k, day, close / lag(close) OVER (PARTITION BY k ORDER BY day) AS g FROM bars), m AS (SELECT day, CASE WHEN day < DATE '2024-01-15' THEN max(g) FILTER (k = 'click') ELSE 0.6 * max(g) FILTER (k = 'click') + 0.4 * max(g) FILTER (k = 'view') END AS g FROM r GROUP BY day) SELECT day::VARCHAR AS day, round(exp(sum(ln(g)) OVER (ORDER BY day)), 5) AS level FROM m WHERE g > 0")
def proxy_legs(spark, d):
    """A benchmark chained from legs: one instrument first, a fixed mixture of two later."""
    g = bars(spark, d).withColumn("g", F.try_divide(F.col("close"), F.lag("close").over(Window.partitionBy("k").orderBy("day"))))
    leg = lambda k: F.max(F.when(F.col("k") == k, F.col("g")))
    m = g.groupBy("day").agg(leg("click").alias("a"), leg("view").alias("b")).withColumn("g", F.when(F.col("day") < F.lit("2024-01-15").cast("date"), F.col("a")).otherwise(0.6 * F.col("a") + 0.4 * F.col("b"))).where("g > 0")
    w = Window.partitionBy(F.lit(1)).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # one row a day
    return m.select(F.col("day").cast("string").alias("day"), F.round(F.exp(F.sum(F.log("g")).over(w)), 5).alias("level"))


@query("then_what", f"WITH {LEVELS}, l AS (SELECT max(year) AS last FROM lv) SELECT a.entity, a.year, h::INT AS h, b.year AS to_year, round((power(b.y / a.y, 1.0 / (b.year - a.year)) - 1) * 100, 5) + 0.0 AS cagr FROM lv a, l, (VALUES (1), (3), (5)) t(h) JOIN lv b ON b.entity = a.entity AND b.year = least(a.year + h, last) WHERE b.year > a.year")
def then_what(spark, d):
    """What came of a level after some years, cut at the last year there is."""
    lv = levels(spark, d)
    last = lv.agg(F.max("year")).scalar()
    asked = lv.select("entity", "year", F.col("y").alias("y0"), F.explode(F.array(*map(F.lit, (1, 3, 5)))).alias("h")).withColumn("to_year", F.least(F.col("year") + F.col("h"), last))
    later = lv.select("entity", F.col("year").alias("to_year"), F.col("y").alias("y1"))
    n = F.col("to_year") - F.col("year")
    return asked.join(later, ["entity", "to_year"]).where(n > 0).select("entity", "year", "h", "to_year", (F.round((F.pow(F.try_divide(F.col("y1"), F.col("y0")), 1.0 / n) - 1) * 100, 5) + F.lit(0.0)).alias("cagr"))


@query("cohort_outcomes", f"WITH {GROWTH} SELECT year, count(*) AS n, round(quantile_cont(g, 0.25), 6) + 0.0 AS q1, round(median(g), 6) + 0.0 AS med, round(quantile_cont(g, 0.75), 6) + 0.0 AS q3, count(*) FILTER (g > (SELECT max(f.g) FROM gr f WHERE f.entity = 0 AND f.year = gr.year AND f.h = 2)) + 1 AS focal_rank FROM gr WHERE h = 2 GROUP BY year")
def cohort_outcomes(spark, d):
    g = growths(spark, d).where("h = 2").withColumn("focal", F.max(F.when(F.col("entity") == 0, F.col("g"))).over(Window.partitionBy("year")))
    return g.groupBy("year").agg(F.count(F.lit(1)).alias("n"), r6(F.percentile("g", 0.25)).alias("q1"), r6(F.percentile("g", 0.5)).alias("med"), r6(F.percentile("g", 0.75)).alias("q3"), (F.count(F.when(F.col("g") > F.col("focal"), 1)) + 1).alias("focal_rank"))


# backtest ----------------------------------------------------------------------------------------------------------

TOP = GROWTH + ", lim AS (SELECT year, quantile_cont(g, 0.8) AS q FROM gr WHERE h = 2 GROUP BY year), pr AS (SELECT entity, year, g FROM gr JOIN lim USING (year) WHERE h = 2 AND round(g, 12) >= round(q, 12))"


def prototypes(spark, d):
    return St.top_share(growths(spark, d).where("h = 2").drop("h"), "g", 0.2, ["year"])


@query("prototype_top_decile", f"WITH {TOP} SELECT entity, year, round(g, 6) + 0.0 AS g FROM pr")
def prototype_top_decile(spark, d):
    return prototypes(spark, d).select("entity", "year", r6("g").alias("g"))


SPACED = TOP.replace("WITH ", "") + """, rk AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY round(g, 9) DESC, year) AS r FROM pr), a1 AS (SELECT * FROM rk WHERE r = 1),
l2 AS (SELECT rk.* FROM rk JOIN a1 USING (entity) WHERE abs(rk.year - a1.year) >= 2), a2 AS (SELECT * FROM l2 QUALIFY r = min(r) OVER (PARTITION BY entity)),
l3 AS (SELECT l2.* FROM l2 JOIN a2 USING (entity) WHERE abs(l2.year - a2.year) >= 2), a3 AS (SELECT * FROM l3 QUALIFY r = min(r) OVER (PARTITION BY entity))"""


@query("prototype_spaced", f"WITH {SPACED} SELECT entity, year FROM a1 UNION ALL SELECT entity, year FROM a2 UNION ALL SELECT entity, year FROM a3")
def prototype_spaced(spark, d):
    ranked = prototypes(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc(F.round("g", 9)), "year")))
    return St.spaced(ranked, "entity", "year", "r", 3, 2).select("entity", "year")


PROTO_DIST = TOP + ", pd AS (SELECT a.entity, a.year, b.entity AS b_entity, b.year AS b_year, 5 * sum(abs(a.c - b.c)) AS d FROM p a JOIN p b ON a.pos = b.pos JOIN pr ON pr.entity = b.entity AND pr.year = b.year GROUP BY ALL)"


@query("min_soft_min", on_profiles("SELECT entity, year, round(min(d), 6) + 0.0 AS least, round(list_sort(list(d))[2], 6) + 0.0 AS second, round(min(d) - 0.25 * ln(sum(exp(-(d - m) / 0.25))), 6) + 0.0 AS soft FROM (SELECT *, min(d) OVER (PARTITION BY entity, year) AS m FROM pd) GROUP BY entity, year", PROTO_DIST))
def min_soft_min(spark, d):
    """Distances of every profile to the set of prototypes: the least, the second and the soft minimum."""
    from ..operators.search import soft_minima

    p = C.profiles(spark, d).select("entity", "year", "c")
    proto = p.join(prototypes(spark, d).select("entity", "year"), ["entity", "year"], "left_semi")
    out = soft_minima(p, proto)
    return out.select("entity", "year", *[r6(c).alias(c) for c in ("least", "second", "soft")])


@query("excess_top_quartile", f"WITH {GROWTH}, m AS (SELECT year, median(g) AS med, quantile_cont(g, 0.75) AS q FROM gr WHERE h = 2 GROUP BY year) SELECT entity, year, round(g - med, 6) + 0.0 AS excess, round(g, 12) >= round(q, 12) AS top_q FROM gr JOIN m USING (year) WHERE h = 2")
def excess_top_quartile(spark, d):
    g = growths(spark, d).where("h = 2")
    m = g.groupBy("year").agg(F.percentile("g", 0.5).alias("med"), F.percentile("g", 0.75).alias("q"))
    return g.join(m, "year").select("entity", "year", r6(F.col("g") - F.col("med")).alias("excess"), (F.round("g", 12) >= F.round("q", 12)).alias("top_q"))


@query("momentum_pick", f"WITH {GROWTH} SELECT year, entity, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY round(g, 9) DESC, entity) AS rank FROM gr WHERE h = 3) WHERE rank <= 3")
def momentum_pick(spark, d):
    w = Window.partitionBy("year").orderBy(F.desc(F.round("g", 9)), "entity")
    return growths(spark, d).where("h = 3").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("year", "entity", "rank")


EX = GROWTH + ", ex AS (SELECT entity, year, g - median(g) OVER (PARTITION BY year) AS e FROM gr WHERE h = 2)"


def excess(spark, d):
    g = growths(spark, d).where("h = 2")
    m = g.groupBy("year").agg(F.percentile("g", 0.5).alias("med"))
    return g.join(m, "year").select("entity", "year", (F.col("g") - F.col("med")).alias("e"))


@query("hit_rate_stats", f"WITH {EX} SELECT year, round(avg(e), 6) + 0.0 AS mean, count(*) AS n, round(avg((e > 1e-12)::INT), 6) AS hit FROM ex GROUP BY year")
def hit_rate_stats(spark, d):
    return excess(spark, d).groupBy("year").agg(r6(F.avg("e")).alias("mean"), F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("e") > 1e-12).cast("int")), 6).alias("hit"))


@query("n_eff", f"WITH {EX} SELECT count(DISTINCT (entity, floor((year - 1995) / 2))) AS n_eff, count(*) AS n FROM ex")
def n_eff(spark, d):
    return excess(spark, d).agg(F.countDistinct(F.struct("entity", F.floor((F.col("year") - 1995) / 2))).alias("n_eff"), F.count(F.lit(1)).alias("n"))


@query("cluster_se", f"WITH {EX}, m AS (SELECT avg(e) AS mean, count(*) AS n FROM ex) SELECT round(mean, 6) + 0.0 AS mean, round(sqrt((SELECT sum(power(s - k * mean, 2)) FROM (SELECT sum(e) AS s, count(*) AS k FROM ex GROUP BY entity))) / n, 6) AS se FROM m")
def cluster_se(spark, d):
    return St.cluster_se(excess(spark, d), "e", "entity").select(r6("mean").alias("mean"), F.round("se", 6).alias("se"))


@query("cluster_hac_se", f"WITH {EX}, c AS (SELECT *, e - avg(e) OVER () AS u FROM ex) SELECT round(sqrt(greatest(sum(a.u * b.u * (1 - abs(a.year - b.year) / 3.0)), 0)) / (SELECT count(*) FROM ex), 6) AS se FROM c a JOIN c b ON a.entity = b.entity AND abs(a.year - b.year) < 3")
def cluster_hac_se(spark, d):
    """Kernel-weighted products within an entity, by lags of its years instead of a self-join."""
    e = excess(spark, d)
    u = F.col("e") - e.agg(F.avg("e")).scalar()
    c = e.select("entity", "year", u.alias("u"))
    w = Window.partitionBy("entity").orderBy("year")
    at = lambda k: F.coalesce(F.first("u").over(w.rangeBetween(k, k)), F.lit(0.0))
    cross = F.col("u") * (F.col("u") + 2 * sum((at(k) * (1 - k / 3.0) for k in (1, 2)), F.lit(0.0)))
    return c.select(cross.alias("x")).agg(F.round(F.sqrt(F.greatest(F.sum("x"), F.lit(0.0))) / F.count(F.lit(1)), 6).alias("se"))


@query("ols_moments", f"WITH {GROWTH}, s AS (SELECT gr.g AS y, ln(lv.y) AS x FROM gr JOIN lv USING (entity, year) WHERE h = 2) SELECT round(regr_slope(y, x), 6) + 0.0 AS slope, round(regr_intercept(y, x), 5) + 0.0 AS intercept, count(*) AS n, round(corr(y, x), 6) + 0.0 AS r FROM s")
def ols_moments(spark, d):
    s = growths(spark, d).where("h = 2").join(levels(spark, d), ["entity", "year"]).select("g", F.log("y").alias("x"))
    return s.agg(r6(F.regr_slope("g", "x")).alias("slope"), (F.round(F.regr_intercept("g", "x"), 5) + F.lit(0.0)).alias("intercept"), F.count(F.lit(1)).alias("n"), r6(F.corr("g", "x")).alias("r"))


@query("spearman_methods", f"WITH {GROWTH}, s AS (SELECT gr.g, lv.y FROM gr JOIN lv USING (entity, year) WHERE h = 2), r AS (SELECT rank() OVER (ORDER BY round(g, 9)) + (count(*) OVER (PARTITION BY round(g, 9)) - 1) / 2.0 AS a, rank() OVER (ORDER BY round(y, 6)) + (count(*) OVER (PARTITION BY round(y, 6)) - 1) / 2.0 AS b FROM s) SELECT round(corr(a, b), 6) + 0.0 AS rho FROM r")
def spearman_methods(spark, d):
    """Correlation of average ranks, without a window over all rows."""
    s = growths(spark, d).where("h = 2").join(levels(spark, d), ["entity", "year"]).select(F.round("g", 9).alias("a"), F.round("y", 6).alias("b"))
    return St.average_ranks(St.average_ranks(s, "a", "ra"), "b", "rb").agg(r6(F.corr("ra", "rb")).alias("rho"))


DRAWS, BLOCK_YEARS = 5000, 2
UNI = "('0x' || substr(md5({}), 1, 13))::BIGINT / 4503599627370496.0"


def draws_sql(group: str, seed: int, block: int) -> str:
    """CTEs that end in {group}_ci: the interval of the mean by draws of a column's groups, so many in a row at once."""
    u = UNI.format(f"concat_ws(':', {seed}, draw, slot // {block})")
    return f"""{group}_g AS (SELECT {group}, sum(e) AS s, count(*) AS n, row_number() OVER (ORDER BY {group}) - 1 AS i FROM ex GROUP BY {group}), {group}_z AS (SELECT count(*) AS c FROM {group}_g),
{group}_sl AS (SELECT draw, ((floor({u} * c) + slot % {block}) % c)::INT AS i FROM range({DRAWS}) d(draw), (SELECT c, unnest(range(c)) AS slot FROM {group}_z)),
{group}_m AS (SELECT draw, sum(s) / sum(n) AS mean FROM {group}_sl JOIN {group}_g USING (i) GROUP BY draw), {group}_ci AS (SELECT quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM {group}_m)"""


CI_SQL = f"""WITH {EX}, {draws_sql("entity", 7, 1)}, {draws_sql("year", 8, BLOCK_YEARS)},
b AS (SELECT a.low AS entity_low, a.high AS entity_high, c.low AS block_low, c.high AS block_high, c.high - c.low > a.high - a.low AS wide, (SELECT count(DISTINCT year) <= {BLOCK_YEARS} FROM ex) AS degenerate FROM entity_ci a, year_ci c)
SELECT round(CASE WHEN wide THEN block_low ELSE entity_low END, 6) + 0.0 AS low, round(CASE WHEN wide THEN block_high ELSE entity_high END, 6) + 0.0 AS high, CASE WHEN wide THEN 'block' ELSE 'entity' END AS scheme,
       round(entity_low, 6) + 0.0 AS entity_low, round(entity_high, 6) + 0.0 AS entity_high, round(block_low, 6) + 0.0 AS block_low, round(block_high, 6) + 0.0 AS block_high, degenerate FROM b"""


@query("block_bootstrap_ci", CI_SQL)
def block_bootstrap_ci(spark, d):
    """Interval of the mean excess by DRAWS draws of entities and of circular blocks of years; low and high are the wider of the two.

    degenerate: a block holds all years, so that every draw of blocks is the whole series.
    """
    e = excess(spark, d)
    sums = lambda c: e.groupBy(F.col(c).alias("g")).agg(F.sum("e").alias("s"), F.count("e").alias("n"))
    ends = lambda x, n: x.agg(F.percentile("mean", 0.025).alias(f"{n}_low"), F.percentile("mean", 0.975).alias(f"{n}_high"))
    both = ends(St.bootstrap_means(sums("entity"), DRAWS), "entity").crossJoin(ends(St.bootstrap_means(sums("year"), DRAWS, seed=8, block=BLOCK_YEARS), "block"))
    both = both.crossJoin(e.agg((F.countDistinct("year") <= BLOCK_YEARS).alias("degenerate")))
    wide = F.col("block_high") - F.col("block_low") > F.col("entity_high") - F.col("entity_low")
    pick = lambda end: F.when(wide, F.col(f"block_{end}")).otherwise(F.col(f"entity_{end}"))
    return both.select(r6(pick("low")).alias("low"), r6(pick("high")).alias("high"), F.when(wide, "block").otherwise("entity").alias("scheme"), *[r6(f"{n}_{end}").alias(f"{n}_{end}") for n in ("entity", "block") for end in ("low", "high")], "degenerate")


def places_sql(seed: int) -> str:
    """CTEs sz, dr and pk: of three different places a year and draw each row's value e; a place moves past smaller ones already taken."""
    u = lambda i: UNI.format(f"concat_ws(':', {seed}, draw, year, {i})")
    return f"""nb AS (SELECT year, e, row_number() OVER (PARTITION BY year ORDER BY entity) - 1 AS place FROM ex), sz AS (SELECT year, count(*) AS n FROM ex GROUP BY year),
d1 AS (SELECT draw, year, n, floor({u(0)} * n)::BIGINT AS a FROM sz, range({DRAWS}) t(draw)), d2 AS (SELECT *, CASE WHEN n > 1 THEN b + (b >= a)::INT END AS b2 FROM (SELECT *, floor({u(1)} * (n - 1))::BIGINT AS b FROM d1)),
d3 AS (SELECT *, CASE WHEN n > 2 THEN c1 + (c1 >= greatest(a, b2))::INT END AS c2 FROM (SELECT *, c + (c >= least(a, b2))::INT AS c1 FROM (SELECT *, floor({u(2)} * (n - 2))::BIGINT AS c FROM d2))),
pk AS (SELECT draw, year, e FROM (SELECT draw, year, unnest([a, b2, c2]) AS place FROM d3) JOIN nb USING (year, place))"""


@query("null_n1", f"WITH {EX}, {places_sql(11)} SELECT draw, round(avg(e), 6) + 0.0 AS mean FROM pk GROUP BY draw")
def null_n1(spark, d):
    """Three entities a year drawn at random, DRAWS times."""
    return null_draws(spark, d).select("draw", r6("mean").alias("mean"))


def null_draws(spark, d):
    return St.draws_of(excess(spark, d), ["year"], "entity", "e", 3, DRAWS, 11).groupBy("draw").agg(F.avg("e").alias("mean"))


@query("decision_levels", f"WITH {EX}, s AS (SELECT avg(e) AS m, avg((e > 0)::INT) AS h, count(*) AS n FROM ex), c AS (SELECT 'L1' AS level, n > 50 AS met FROM s UNION ALL SELECT 'L1', h BETWEEN 0.2 AND 0.8 FROM s UNION ALL SELECT 'L2', m > 1 FROM s UNION ALL SELECT 'L2', TRUE UNION ALL SELECT 'L3', NULL) SELECT level, bool_and(coalesce(met, FALSE)) AS granted FROM c GROUP BY level")
def decision_levels(spark, d):
    s = excess(spark, d).agg(F.avg("e").alias("m"), F.avg((F.col("e") > 0).cast("int")).alias("h"), F.count(F.lit(1)).alias("n"))
    rules = [("L1", F.col("n") > 50), ("L1", F.col("h").between(0.2, 0.8)), ("L2", F.col("m") > 1), ("L2", F.lit(True)), ("L3", F.lit(None).cast("boolean"))]
    return St.granted(s.select(F.inline(F.array(*[F.struct(F.lit(a).alias("level"), b.alias("met")) for a, b in rules]))))
