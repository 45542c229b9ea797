"""Queries of backtest studies: standard errors, nulls, bootstraps, windows by source, governance of series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import relational as R
from ..operators import series as T
from ..operators import stats as St
from ..session import table
from .registry import on_profiles, query, r6
from .relational import BARS, bars
from .series import BLOCK_YEARS, DRAWS, EX, GROWTH, LEVELS, UNI, excess, growths, levels, places_sql

PERIODS = EX + ", h AS (SELECT year AS t, avg(e) AS u FROM ex GROUP BY year), c AS (SELECT t, row_number() OVER (ORDER BY t) AS i, u - avg(u) OVER () AS u FROM h), n AS (SELECT count(*) AS n FROM c), g AS (SELECT j, sum(a.u * b.u) / any_value(n) AS gamma FROM range(0, 3) r(j), n, c a JOIN c b ON a.i = b.i + j GROUP BY j)"
UNIFORM, BARTLETT = "sum(gamma * CASE j WHEN 0 THEN 1 ELSE 2 END)", "sum(gamma * CASE j WHEN 0 THEN 1 ELSE 2 * (1 - j / 3.0) END)"
LAGS = 2


def per_period(spark, d):
    """The mean excess of each year, in order."""
    return excess(spark, d).groupBy("year").agg(F.avg("e").alias("u"))


@query("long_run_variance", f"WITH {PERIODS} SELECT 'uniform' AS kernel, round({UNIFORM}, 9) + 0.0 AS v FROM g UNION ALL SELECT 'bartlett', round({BARTLETT}, 9) + 0.0 FROM g")
def long_run_variance(spark, d):
    return St.long_run(per_period(spark, d), "year", "u", LAGS).select(F.inline(F.array(*[F.struct(F.lit(k).alias("kernel"), (F.round(k, 9) + F.lit(0.0)).alias("v")) for k in ("uniform", "bartlett")])))


@query("hansen_hodrick_se", f"WITH {PERIODS}, v AS (SELECT {UNIFORM} AS u, {BARTLETT} AS b FROM g) SELECT round(sqrt(CASE WHEN u > 0 THEN u ELSE b END / n), 8) AS se, u <= 0 AS fell_back FROM v, n")
def hansen_hodrick_se(spark, d):
    """Uniform kernel; Bartlett's where the variance is not positive."""
    v = St.long_run(per_period(spark, d), "year", "u", LAGS)
    return v.select(F.round(F.sqrt(F.when(F.col("uniform") > 0, F.col("uniform")).otherwise(F.col("bartlett")) / F.col("n")), 8).alias("se"), (F.col("uniform") <= 0).alias("fell_back"))


@query("newey_west_se", f"WITH {PERIODS}, v AS (SELECT {BARTLETT} AS b FROM g) SELECT round(sqrt(greatest(b, 0) / n), 8) AS se FROM v, n")
def newey_west_se(spark, d):
    return St.long_run(per_period(spark, d), "year", "u", LAGS).select(F.round(F.sqrt(F.greatest("bartlett", F.lit(0.0)) / F.col("n")), 8).alias("se"))


@query("naive_se", f"WITH {EX} SELECT round(stddev_samp(e) / sqrt(count(*)), 8) AS se FROM ex")
def naive_se(spark, d):
    return excess(spark, d).agg(F.round(F.stddev_samp("e") / F.sqrt(F.count("e")), 8).alias("se"))


SAMPLE = GROWTH + ", s AS (SELECT gr.entity, gr.year, gr.g AS y, ln(lv.y) AS x FROM gr JOIN lv USING (entity, year) WHERE h = 2), b AS (SELECT regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0, count(*)::DOUBLE AS n, sum(x) AS sx, sum(x * x) AS sxx FROM s), u AS (SELECT s.*, y - b0 - b1 * x AS u FROM s, b), i AS (SELECT n / (n * sxx - sx * sx) AS i11, -sx / (n * sxx - sx * sx) AS i01 FROM b)"


def meat_sql(by: str, name: str) -> str:
    return f"{name} AS (SELECT sum(h0 * h0) AS m00, sum(h0 * h1) AS m01, sum(h1 * h1) AS m11 FROM (SELECT sum(u) AS h0, sum(u * x) AS h1 FROM u GROUP BY {by}))"


def variance_sql(m: str = "") -> str:
    return f"(i01 * i01 * {m}m00 + 2 * i01 * i11 * {m}m01 + i11 * i11 * {m}m11)"


def sample(spark, d):
    return growths(spark, d).where("h = 2").join(levels(spark, d), ["entity", "year"]).select("entity", "year", "g", F.log("y").alias("x"))


@query("clustered_ols", f"WITH {SAMPLE}, {meat_sql('entity', 'm')} SELECT round(b1, 6) + 0.0 AS slope, round(sqrt(greatest({variance_sql()}, 0)), 6) AS se FROM b, i, m")
def clustered_ols(spark, d):
    (_, (slope, se)) = St.clustered_ols(sample(spark, d), "g", ["x"], "entity")
    return spark.createDataFrame([(slope, se)], "slope double, se double").select(r6("slope").alias("slope"), F.round("se", 6).alias("se"))


@query("two_way_cluster", f"WITH {SAMPLE}, {meat_sql('entity', 'a')}, {meat_sql('year', 'c')}, {meat_sql('entity, year', 'e')} SELECT round(b1, 6) + 0.0 AS slope, round(sqrt(greatest({variance_sql('a.')} + {variance_sql('c.')} - {variance_sql('e.')}, 0)), 6) AS se FROM b, i, a, c, e")
def two_way_cluster(spark, d):
    """Variance by entity plus that by year less that by both."""
    (_, (slope, se)) = St.sandwich_ols(sample(spark, d), "g", ["x"], [(1, ["entity"]), (1, ["year"]), (-1, ["entity", "year"])])
    return spark.createDataFrame([(slope, se)], "slope double, se double").select(r6("slope").alias("slope"), F.round("se", 6).alias("se"))


@query("dk_scores", f"WITH {SAMPLE}, h AS (SELECT year, sum(u) AS h0, sum(u * x) AS h1, row_number() OVER (ORDER BY year) AS k FROM u GROUP BY year), w AS (SELECT CASE WHEN a.k = b.k THEN 1 ELSE 2 * (1 - (a.k - b.k) / 3.0) END AS w, a.h0 * b.h0 AS m00, (a.h0 * b.h1 + a.h1 * b.h0) / 2 AS m01, a.h1 * b.h1 AS m11 FROM h a JOIN h b ON a.k - b.k BETWEEN 0 AND 2), m AS (SELECT sum(w * m00) AS m00, sum(w * m01) AS m01, sum(w * m11) AS m11 FROM w) SELECT round(b1, 6) + 0.0 AS slope, round(sqrt(greatest({variance_sql()}, 0)), 6) AS se FROM b, i, m")
def dk_scores(spark, d):
    """Driscoll-Kraay: scores are summed by period, and the periods' sums weighed by Bartlett's kernel."""
    (_, (slope, se)) = St.driscoll_kraay_ols(sample(spark, d), "g", ["x"], "year", LAGS)
    return spark.createDataFrame([(slope, se)], "slope double, se double").select(r6("slope").alias("slope"), F.round("se", 6).alias("se"))


@query("one_sided_p", f"WITH {EX}, o AS (SELECT avg(e) AS obs FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY entity) AS k FROM ex) WHERE k <= 3), {places_sql(11)}, m AS (SELECT draw, avg(e) AS mean FROM pk GROUP BY draw) SELECT round((count(*) FILTER (round(mean, 9) >= round(obs, 9)) + 1) / (count(*) + 1.0), 9) AS p FROM m, o")
def one_sided_p(spark, d):
    """How many draws of the null reach what was observed, one added above and below."""
    from .series import null_draws

    e = excess(spark, d)
    first = e.withColumn("k", F.row_number().over(Window.partitionBy("year").orderBy("entity"))).where("k <= 3")
    obs = first.agg(F.avg("e")).scalar()
    return null_draws(spark, d).agg(F.round((F.count(F.when(F.round("mean", 9) >= F.round(obs, 9), 1)) + 1) / (F.count(F.lit(1)) + 1.0), 9).alias("p"))


N2 = EX + f""", l AS (SELECT ex.*, ln(lv.y) AS ly FROM ex JOIN lv USING (entity, year)), pick AS (SELECT * FROM (SELECT l.*, row_number() OVER (PARTITION BY l.year ORDER BY round(b.g, 9) DESC, l.entity) AS k FROM l JOIN gr b ON b.h = 2 AND b.entity = l.entity AND b.year = l.year - 2) WHERE k <= 3),
pool AS (SELECT p.year, p.entity, q.entity AS other, q.e FROM pick p JOIN l q ON p.year = q.year AND p.entity <> q.entity AND abs(p.ly - q.ly) <= 0.35)"""


@query("null_n2", f"WITH {N2}, nb AS (SELECT year, entity, e, row_number() OVER (PARTITION BY year, entity ORDER BY other) - 1 AS place, count(*) OVER (PARTITION BY year, entity) AS n FROM pool), dr AS (SELECT DISTINCT draw, year, entity, floor({UNI.format("concat_ws(':', 12, draw, year, entity, 0)")} * n)::BIGINT AS place FROM nb, range({DRAWS}) t(draw)) SELECT draw, count(*) AS n, round(avg(e), 6) + 0.0 AS mean FROM dr JOIN nb USING (year, entity, place) GROUP BY draw")
def null_n2(spark, d):
    """Each of three momentum picks a year is replaced by one at random of its year within the caliper of its log level, DRAWS times. Picks without partner are left out."""
    rows = excess(spark, d).join(levels(spark, d), ["entity", "year"]).select("entity", "year", "e", F.log("y").alias("ly"))
    pick = picks_of(spark, d).join(rows.select("entity", "year", "ly"), ["entity", "year"])
    pool = pick.join(rows.select(F.col("entity").alias("other"), "year", "e", F.col("ly").alias("oy")), "year").where((F.col("entity") != F.col("other")) & (F.abs(F.col("ly") - F.col("oy")) <= 0.35))
    drawn = St.draws_of(pool, ["year", "entity"], "other", "e", 1, DRAWS, 12)
    return drawn.groupBy("draw").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("e")).alias("mean"))


def picks_of(spark, d):
    """Three entities a year: those of the highest growth over the two years before."""
    before = growths(spark, d).where("h = 2").select("entity", (F.col("year") + 2).alias("year"), F.col("g").alias("was"))
    now = excess(spark, d).select("entity", "year").join(before, ["entity", "year"])
    w = Window.partitionBy("year").orderBy(F.desc(F.round("was", 9)), "entity")
    return now.withColumn("k", F.row_number().over(w)).where("k <= 3").select("entity", "year")


PAIRED = EX + """, gd AS (SELECT entity, avg(e) FILTER (year % 2 = 0) - avg(e) FILTER (year % 2 = 1) AS dd FROM ex GROUP BY entity), gg AS (SELECT entity, dd AS s, 1 AS n, row_number() OVER (ORDER BY entity) - 1 AS i FROM gd WHERE dd IS NOT NULL), z AS (SELECT count(*) AS c FROM gg),
yg AS (SELECT (year + year % 2)::INT AS g, avg(e) FILTER (year % 2 = 0) - avg(e) FILTER (year % 2 = 1) AS s FROM ex GROUP BY 1), yn AS (SELECT s, row_number() OVER (ORDER BY g) - 1 AS i FROM yg WHERE s IS NOT NULL), yz AS (SELECT count(*) AS c FROM yn)"""
YEARLY = f"ys AS (SELECT draw, ((floor({UNI.format(f"concat_ws(':', 10, draw, slot // {BLOCK_YEARS})")} * c) + slot % {BLOCK_YEARS}) % c)::INT AS i FROM range({DRAWS}) t(draw), (SELECT c, unnest(range(c)) AS slot FROM yz)), ym AS (SELECT draw, avg(s) AS mean FROM ys JOIN yn USING (i) GROUP BY draw), yi AS (SELECT quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM ym)"


@query("paired_bootstrap", f"WITH {PAIRED}, sl AS (SELECT draw, floor({UNI.format("concat_ws(':', 9, draw, slot)")} * c)::INT AS i FROM range({DRAWS}) t(draw), (SELECT c, unnest(range(c)) AS slot FROM z)), m AS (SELECT draw, sum(s) / sum(n) AS mean FROM sl JOIN gg USING (i) GROUP BY draw), ei AS (SELECT quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM m), {YEARLY} SELECT round(CASE WHEN yi.high - yi.low > ei.high - ei.low THEN yi.low ELSE ei.low END, 6) + 0.0 AS low, round(CASE WHEN yi.high - yi.low > ei.high - ei.low THEN yi.high ELSE ei.high END, 6) + 0.0 AS high, CASE WHEN yi.high - yi.low > ei.high - ei.low THEN 'years' ELSE 'entities' END AS scheme, round((SELECT avg(s) FROM gg), 6) + 0.0 AS diff FROM ei, yi")
def paired_bootstrap(spark, d):
    """Interval of the mean difference of two halves of the years: entities drawn as pairs of both, and pairs of years drawn in blocks; the wider one counts."""
    ex, even = excess(spark, d), F.col("year") % 2 == 0
    gap = F.avg(F.when(even, F.col("e"))) - F.avg(F.when(~even, F.col("e")))
    own = lambda g: ex.groupBy(g.alias("g")).agg(gap.alias("s")).where("s IS NOT NULL").withColumn("n", F.lit(1))
    ends = lambda means, n: means.agg(F.percentile("mean", 0.025).alias(f"{n}_low"), F.percentile("mean", 0.975).alias(f"{n}_high"))
    sums = own(F.col("entity"))
    years = own((F.col("year") + F.col("year") % 2).cast("int"))
    both = ends(St.bootstrap_means(sums, DRAWS, seed=9), "e").crossJoin(ends(St.bootstrap_means(years, DRAWS, seed=10, block=BLOCK_YEARS), "y")).crossJoin(sums.agg(r6(F.avg("s")).alias("diff")))  # one row each
    wide = F.col("y_high") - F.col("y_low") > F.col("e_high") - F.col("e_low")
    return both.select(*[r6(F.when(wide, F.col(f"y_{c}")).otherwise(F.col(f"e_{c}"))).alias(c) for c in ("low", "high")], F.when(wide, "years").otherwise("entities").alias("scheme"), "diff")


@query("pooled_stats", f"WITH {EX}, h AS (SELECT year, avg(e) AS m FROM ex GROUP BY year) SELECT count(*) AS periods, round(avg(m), 6) + 0.0 AS mean, round(avg((m > 1e-12)::INT), 6) AS hit, round(avg(m) / (stddev_samp(m) / sqrt(count(*))), 4) + 0.0 AS z FROM h")
def pooled_stats(spark, d):
    h = excess(spark, d).groupBy("year").agg(F.avg("e").alias("m"))
    return h.agg(F.count(F.lit(1)).alias("periods"), r6(F.avg("m")).alias("mean"), F.round(F.avg((F.col("m") > 1e-12).cast("int")), 6).alias("hit"), (F.round(F.avg("m") / (F.stddev_samp("m") / F.sqrt(F.count("m"))), 4) + F.lit(0.0)).alias("z"))


TWO = LEVELS + ", sp AS (SELECT entity, year, CASE WHEN (entity + year) % 5 <> 0 THEN y * 2 END AS w1, CASE WHEN (entity + year) % 7 <> 0 THEN y * 3 END AS w2 FROM lv)"


@query("window_source_choice", f"WITH {TWO} SELECT a.entity, a.year, CASE WHEN a.w1 IS NOT NULL AND b.w1 IS NOT NULL THEN 'first' ELSE 'second' END AS source, round(CASE WHEN a.w1 IS NOT NULL AND b.w1 IS NOT NULL THEN ln(b.w1 / a.w1) ELSE ln(b.w2 / a.w2) END / 2, 6) + 0.0 AS g FROM sp a JOIN sp b ON a.entity = b.entity AND b.year = a.year + 2 WHERE (a.w1 IS NOT NULL AND b.w1 IS NOT NULL) OR (a.w2 IS NOT NULL AND b.w2 IS NOT NULL)")
def window_source_choice(spark, d):
    """Growth over a window from one source at both ends, the first if it has both; sources are never mixed."""
    y = F.col("y")
    sp = levels(spark, d).select("entity", "year", F.when((F.col("entity") + F.col("year")) % 5 != 0, y * 2).alias("w1"), F.when((F.col("entity") + F.col("year")) % 7 != 0, y * 3).alias("w2"))
    w = Window.partitionBy("entity").orderBy("year").rangeBetween(2, 2)
    g = lambda c: F.log(F.try_divide(F.first(c).over(w), F.col(c))) / 2
    out = sp.select("entity", "year", g("w1").alias("a"), g("w2").alias("b")).where("a IS NOT NULL OR b IS NOT NULL")
    return out.select("entity", "year", F.when(F.col("a").isNotNull(), "first").otherwise("second").alias("source"), r6(F.coalesce("a", "b")).alias("g"))


@query("partial_tail_windows", f"WITH {LEVELS}, l AS (SELECT entity, max(year) AS last FROM lv GROUP BY entity) SELECT a.entity, a.year, (b.year - a.year)::INT AS span, b.year - a.year < 4 AS partial, round(ln(b.y / a.y) / (b.year - a.year), 6) + 0.0 AS g FROM lv a JOIN l USING (entity) JOIN lv b ON b.entity = a.entity AND b.year = least(a.year + 4, last) WHERE b.year > a.year")
def partial_tail_windows(spark, d):
    """Windows of four years; those that would end after the last year end there and are marked."""
    lv = levels(spark, d)
    asked = lv.withColumn("to", F.least(F.col("year") + 4, F.max("year").over(Window.partitionBy("entity"))))
    met = asked.join(lv.select("entity", F.col("year").alias("to"), F.col("y").alias("y1")), ["entity", "to"]).where("to > year")
    span = F.col("to") - F.col("year")
    return met.select("entity", "year", span.cast("int").alias("span"), (span < 4).alias("partial"), r6(F.log(F.try_divide(F.col("y1"), F.col("y"))) / span).alias("g"))


@query("rescale_ratio", f"WITH {TWO} SELECT round(median(w2 / w1), 6) + 0.0 AS ratio, count(*) AS n FROM sp WHERE year = 1997 AND w1 IS NOT NULL AND w2 IS NOT NULL")
def rescale_ratio(spark, d):
    """The median over entities of one source's level over another's in the year where they are tied."""
    y = F.col("y")
    sp = levels(spark, d).where("year = 1997").select(F.when((F.col("entity") + F.col("year")) % 5 != 0, y * 2).alias("w1"), F.when((F.col("entity") + F.col("year")) % 7 != 0, y * 3).alias("w2"))
    both = sp.where("w1 IS NOT NULL AND w2 IS NOT NULL")
    return both.agg(r6(F.percentile(F.try_divide(F.col("w2"), F.col("w1")), 0.5)).alias("ratio"), F.count(F.lit(1)).alias("n"))


@query("decile_bucket", f"WITH {GROWTH}, q AS (SELECT year, quantile_cont(g, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM gr WHERE h = 2 GROUP BY year) SELECT entity, year, len(list_filter(q, lambda x: round(x, 12) <= round(g, 12)))::INT AS bucket FROM gr JOIN q USING (year) WHERE h = 2")
def decile_bucket(spark, d):
    """How many of a year's nine cuts a value reaches: equal values share a bucket."""
    g = growths(spark, d).where("h = 2")
    cuts = g.groupBy("year").agg(F.percentile("g", F.array(*[F.lit(k / 10) for k in range(1, 10)])).alias("q"))
    return g.join(cuts, "year").select("entity", "year", F.size(F.filter("q", lambda x: F.round(x, 12) <= F.round("g", 12))).alias("bucket"))


@query("percentile_rank_share", f"WITH {GROWTH} SELECT entity, year, round(cume_dist() OVER (PARTITION BY year ORDER BY round(g, 9)), 9) AS share FROM gr WHERE h = 2")
def percentile_rank_share(spark, d):
    """The share of a year's values that are at most this one."""
    return growths(spark, d).where("h = 2").select("entity", "year", F.round(F.cume_dist().over(Window.partitionBy("year").orderBy(F.round("g", 9))), 9).alias("share"))


@query("disconnect_multiples", f"WITH {LEVELS}, l AS (SELECT max(year) AS last FROM lv) SELECT a.entity, a.year, h::INT AS h, round(b.y / a.y, 6) + 0.0 AS multiple, a.year + h > last AS clipped FROM lv a, l, (VALUES (1), (2), (3)) t(h) JOIN lv b ON b.entity = a.entity AND b.year = least(a.year + h, last)")
def disconnect_multiples(spark, d):
    """Multiples of a level after one, two and three years, cut at the last year there is."""
    lv = levels(spark, d)
    last = lv.agg(F.max("year")).scalar()
    asked = lv.select("entity", "year", "y", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("h")).withColumn("to", F.least(F.col("year") + F.col("h"), last))
    met = asked.join(lv.select("entity", F.col("year").alias("to"), F.col("y").alias("y1")), ["entity", "to"])
    return met.select("entity", "year", "h", r6(F.try_divide(F.col("y1"), F.col("y"))).alias("multiple"), (F.col("year") + F.col("h") > last).alias("clipped"))


HELD = f"{BARS}, h AS (SELECT * FROM bars WHERE day(day) % 4 < 2 OR k = 'click')"


@query("series_guard", "WITH b AS (SELECT user_id AS k, ts::DATE AS day, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY ALL), g AS (SELECT *, day - lag(day) OVER (PARTITION BY k ORDER BY day) AS gap FROM b) SELECT k, concat_ws(',', CASE WHEN count(*) < 5 THEN 'bars' END, CASE WHEN min(day) > DATE '2024-01-08' THEN 'late' END, CASE WHEN DATE '2024-01-31' - max(day) > 5 AND arg_max(last_type, day) <> 'error' THEN 'live' END, CASE WHEN arg_max(last_type, day) = 'error' AND DATE '2024-01-31' - max(day) <= 2 THEN 'delisted' END, CASE WHEN max(gap) > 10 THEN 'gap' END) AS failed FROM g GROUP BY k")
def series_guard(spark, d):
    """All five rules a series must pass, here the daily bars of every user: enough bars, an early first one, a late last one unless it ended, none that looks live though it ended, no long gap.

    A series has ended where its last event is an error.
    """
    e = table(spark, d, "events").select(F.col("user_id").alias("k"), F.to_date("ts").alias("day"), "ts", "event_id", "event_type")
    b = e.groupBy("k", "day").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type")).withColumn("gap", T.gap_days("k", "day"))
    a = b.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("lo"), F.max("day").alias("hi"), F.max("gap").alias("gap"), (F.max_by("last_type", "day") == "error").alias("ended"))
    left = F.datediff(F.lit("2024-01-31").cast("date"), "hi")
    rules = [(F.col("n") < 5, "bars"), (F.col("lo") > F.lit("2024-01-08").cast("date"), "late"), ((left > 5) & ~F.col("ended"), "live"), ((left <= 2) & F.col("ended"), "delisted"), (F.col("gap") > 10, "gap")]
    return a.select("k", F.array_join(F.array_compact(F.array(*[F.when(c, n) for c, n in rules])), ",").alias("failed"))


@query("inception_choice", f"WITH {HELD}, s AS (SELECT k, min(day) AS lo, max(day) AS hi FROM h GROUP BY k), c AS (SELECT DISTINCT day FROM bars) SELECT c.day::VARCHAR AS day, arg_min(k, (lo, k)) AS k FROM c JOIN s ON c.day BETWEEN lo AND hi GROUP BY c.day")
def inception_choice(spark, d):
    """For each day the series that began first of those that still run."""
    b = bars(spark, d)
    s = b.where((F.dayofmonth("day") % 4 < 2) | (F.col("k") == "click")).groupBy("k").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    runs = s.select("k", "lo", F.explode(F.sequence("lo", "hi")).alias("day"))
    return b.select("day").distinct().join(runs, "day").groupBy("day").agg(F.min_by("k", F.struct("lo", "k")).alias("k")).select(F.col("day").cast("string").alias("day"), "k")


@query("outcome_status", f"WITH {GROWTH}, e AS (SELECT DISTINCT entity, year FROM lv) SELECT e.entity, e.year, round(gr.g, 6) + 0.0 AS g, CASE WHEN gr.g IS NOT NULL THEN 'ok' WHEN e.year > 1999 THEN 'open' ELSE 'missing' END AS status FROM e LEFT JOIN gr ON gr.entity = e.entity AND gr.year = e.year AND gr.h = 2")
def outcome_status(spark, d):
    """Every entity and year with its outcome, or why it has none."""
    e = levels(spark, d).select("entity", "year")
    met = e.join(growths(spark, d).where("h = 2").select("entity", "year", "g"), ["entity", "year"], "left")
    return met.select("entity", "year", r6("g").alias("g"), F.when(F.col("g").isNotNull(), "ok").when(F.col("year") > 1999, "open").otherwise("missing").alias("status"))


@query("basket_mean", f"WITH {BARS}, w AS (SELECT k, arg_min(close, day) AS a, arg_max(close, day) AS b, count(*) AS n FROM bars WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' GROUP BY k) SELECT round(avg(b / a), 6) + 0.0 AS gross, count(*) AS n, count(*) FILTER (n < 21) AS incomplete FROM w")
def basket_mean(spark, d):
    """An equal-weight basket's mean gross return over a window, and how many legs lack bars."""
    w = bars(spark, d).where(F.col("day").between("2024-01-05", "2024-01-25")).groupBy("k").agg(F.min_by("close", "day").alias("a"), F.max_by("close", "day").alias("b"), F.count(F.lit(1)).alias("n"))
    return w.agg(r6(F.avg(F.try_divide(F.col("b"), F.col("a")))).alias("gross"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("n") < 21, 1)).alias("incomplete"))


@query("compounded_growth", f"WITH {BARS}, r AS (SELECT k, day, close / lag(close) OVER (PARTITION BY k ORDER BY day) AS f FROM bars) SELECT k, round(exp(sum(ln(f))), 6) + 0.0 AS growth FROM r WHERE f > 0 GROUP BY k")
def compounded_growth(spark, d):
    f = F.try_divide(F.col("close"), F.lag("close").over(Window.partitionBy("k").orderBy("day")))
    return bars(spark, d).withColumn("f", f).where("f > 0").groupBy("k").agg(r6(F.exp(F.sum(F.log("f")))).alias("growth"))


@query("trading_days_between", f"WITH {BARS}, c AS (SELECT day FROM bars WHERE k = 'click'), s AS (SELECT k, min(day) AS lo, max(day) AS hi FROM bars WHERE day(day) % 4 < 2 GROUP BY k) SELECT k, count(*) FILTER (c.day > lo AND c.day <= hi) AS n FROM s, c GROUP BY k")
def trading_days_between(spark, d):
    """Days of the benchmark's calendar after a series' first bar up to its last, counted by places in the calendar."""
    b = bars(spark, d)
    calendar = b.where("k = 'click'").select("day", F.lit(1).alias("is"))
    s = b.where(F.dayofmonth("day") % 4 < 2).groupBy("k").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    days = s.select("k", F.col("lo"), F.explode(F.sequence("lo", "hi")).alias("day")).join(calendar, "day", "left")
    return days.groupBy("k").agg(F.count(F.when((F.col("day") > F.col("lo")) & F.col("is").isNotNull(), 1)).alias("n"))


@query("answer_signature", f"WITH {BARS} SELECT c.k, CASE WHEN count(b.day) = 0 THEN 'no_data' WHEN count(b.day) = 1 THEN 'one_bar' ELSE 'series' END AS shape FROM (SELECT DISTINCT k FROM bars) c LEFT JOIN bars b ON b.k = c.k AND b.day < DATE '2024-01-01' + length(c.k)::INT - 5 GROUP BY c.k")
def answer_signature(spark, d):
    b = bars(spark, d)
    early = F.col("day") < F.date_add(F.lit("2024-01-01").cast("date"), F.length("k") - 5)
    n = F.count(F.when(early, 1))
    return b.groupBy("k").agg(F.when(n == 0, "no_data").when(n == 1, "one_bar").otherwise("series").alias("shape"))


@query("last_bar_of_year", "SELECT c_nationkey AS entity, year(o_orderdate)::INT AS year, max(o_orderdate::DATE)::VARCHAR AS last FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def last_bar_of_year(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day")).join(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("entity")), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy("entity", F.year("day").alias("year")).agg(F.max("day").cast("string").alias("last"))


@query("cross_check", f"WITH {GROWTH}, li AS (SELECT c_nationkey AS entity, year(o_orderdate)::INT AS year, sum(l_extendedprice * (1 - l_discount)) AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL), pu AS (SELECT a.entity, a.year, ln(b.y / a.y) / 2 AS published FROM li a JOIN li b ON a.entity = b.entity AND b.year = a.year + 2) SELECT entity, year, round(100 * g, 4) + 0.0 AS found, round(100 * published, 4) + 0.0 AS published, round(abs(100 * (g - published)), 6) <= 5 AS agrees FROM gr JOIN pu USING (entity, year) WHERE h = 2")
def cross_check(spark, d):
    """Yearly growth of orders' totals against that of another source, the lines' net prices, within five points."""
    owners = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year")).join(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("entity")), F.col("o_custkey") == F.col("c_custkey"))
    net = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    lines = net.join(owners, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("entity", "year").agg(F.sum("net").alias("y"))
    both = growths(spark, d).where("h = 2").join(T.growth(lines, 2).withColumnRenamed("g", "published"), ["entity", "year"])
    return both.select("entity", "year", *[(F.round(100 * F.col(c), 4) + F.lit(0.0)).alias(n) for c, n in (("g", "found"), ("published", "published"))], (F.round(F.abs(100 * (F.col("g") - F.col("published"))), 6) <= 5).alias("agrees"))


@query("log_to_percent", f"WITH {GROWTH} SELECT entity, year, h::INT AS h, round((exp(g) - 1) * 100, 6) + 0.0 AS cagr, round((exp(g * h) - 1) * 100, 6) + 0.0 AS total FROM gr")
def log_to_percent(spark, d):
    return growths(spark, d).select("entity", "year", "h", r6(F.expm1("g") * 100).alias("cagr"), r6(F.expm1(F.col("g") * F.col("h")) * 100).alias("total"))


@query("last_year_with_data", f"WITH {TWO} SELECT entity, max(year) FILTER (w1 IS NOT NULL) AS last_first, max(year) FILTER (w2 IS NOT NULL) AS last_second FROM sp GROUP BY entity")
def last_year_with_data(spark, d):
    year = F.col("year")
    has = lambda n: F.max(F.when((F.col("entity") + year) % n != 0, year))
    return levels(spark, d).groupBy("entity").agg(has(5).alias("last_first"), has(7).alias("last_second"))


@query("three_band_distance", on_profiles("SELECT entity, year, b_entity, round(sqrt(sum((za - zb) * (za - zb))), 6) + 0.0 AS d FROM (SELECT a.entity, a.year, b.entity AS b_entity, a.z AS za, b.z AS zb FROM zz a JOIN zz b ON a.year = b.year AND a.f = b.f AND a.entity <> b.entity) GROUP BY ALL", " f3 AS (SELECT entity, year, CASE WHEN bin < 2 THEN 'low' WHEN bin < 7 THEN 'mid' ELSE 'high' END AS f, sum(s) AS v FROM t GROUP BY ALL), zz AS (SELECT entity, year, f, (v - avg(v) OVER w) / CASE WHEN stddev_pop(v) OVER w > 1e-12 THEN stddev_pop(v) OVER w ELSE 1.0 END AS z FROM f3 WINDOW w AS (PARTITION BY year, f))"))
def three_band_distance(spark, d):
    """Distance of three z-scored shares, scored over the candidates of the year."""
    from ..operators import features as X

    names = ("low", "mid", "high")
    z = X.zscores(X.features(C.profiles(spark, d))).select("entity", "year", *[f"z_{c}" for c in names])
    other = z.select(F.col("entity").alias("b_entity"), "year", *[F.col(f"z_{c}").alias(f"b_{c}") for c in names])
    gap = sum(((F.col(f"z_{c}") - F.col(f"b_{c}")) ** 2 for c in names), F.lit(0.0))
    return z.join(other, "year").where("entity <> b_entity").select("entity", "year", "b_entity", r6(F.sqrt(gap)).alias("d"))


@query("candidate_pool", on_profiles("SELECT a.entity, a.year FROM k a JOIN k b ON b.entity = a.entity AND b.year = a.year - 2 WHERE a.total >= (SELECT median(total) FROM k) AND a.entity <> 3"))
def candidate_pool(spark, d):
    """Profiles that may be candidates: large enough, with a year two before, and not the anchor."""
    k = C.profiles(spark, d).select("entity", "year", "total")
    floor = k.agg(F.percentile("total", 0.5)).scalar()
    old = k.select("entity", (F.col("year") + 2).cast("int").alias("year"))
    return k.where((F.col("total") >= floor) & (F.col("entity") != 3)).join(old, ["entity", "year"], "left_semi").select("entity", "year")


@query("self_agreement", "WITH j AS (SELECT doc_id, quality, toxic, source, lang FROM labels JOIN documents USING (doc_id)), f AS (SELECT source, lang, arg_min(quality, doc_id) AS a, arg_max(quality, doc_id) AS b, count(*) AS n FROM j GROUP BY ALL HAVING count(*) > 1) SELECT source, count(*) AS pairs, count(*) FILTER (a = b) AS agree, count(*) FILTER (a = b) >= 0.75 * count(*) AS passed FROM f GROUP BY source")
def self_agreement(spark, d):
    """First and last judgment of each pair of source and language; a source passes with three quarters alike."""
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id")
    f = j.groupBy("source", "lang").agg(F.min_by("quality", "doc_id").alias("a"), F.max_by("quality", "doc_id").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    same = F.count(F.when(F.col("a") == F.col("b"), 1))
    return f.groupBy("source").agg(F.count(F.lit(1)).alias("pairs"), same.alias("agree"), (same >= 0.75 * F.count(F.lit(1))).alias("passed"))


@query("budget_violations", "SELECT source, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents GROUP BY source HAVING sum(octet_length(encode(text))) > 20000")
def budget_violations(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.sum(F.octet_length("text")).cast("long").alias("bytes")).where("bytes > 20000")


PARTS_SQL = "sum(('0x' || substr(md5(text), 1, 15))::HUGEINT)::VARCHAR || ':' || sum(('0x' || substr(md5(text), 16, 15))::HUGEINT)::VARCHAR || ':' || count(*)"


def data_digest(text):
    """A digest of a group's texts whatever their order: sums of two parts of their md5, and how many they are."""
    part = lambda i: F.sum(F.conv(F.substring(F.md5(text.cast("binary")), i, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return F.concat_ws(":", part(1), part(16), F.count(F.lit(1)).cast("string"))


@query("verdict_staleness", f"WITH d AS (SELECT lang, source, text, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS gone FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL), n AS (SELECT lang, source, {PARTS_SQL} AS now FROM d WHERE NOT gone GROUP BY ALL), r AS (SELECT lang, source, {PARTS_SQL} AS recorded FROM d GROUP BY ALL) SELECT lang, source, CASE WHEN now IS NULL THEN 'gone' WHEN now = recorded THEN 'fresh' ELSE 'stale' END AS state FROM r LEFT JOIN n USING (lang, source)")
def verdict_staleness(spark, d):
    """Verdicts on the documents of each language and source hold for the digest they were recorded with; since then the toxic documents were taken away."""
    docs = table(spark, d, "documents").where("text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL").select("doc_id", "lang", "source", "text")
    toxic = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    of = lambda rows, name: rows.groupBy("lang", "source").agg(data_digest(F.col("text")).alias(name))
    met = of(docs, "recorded").join(of(docs.join(toxic, "doc_id", "left_anti"), "now"), ["lang", "source"], "left")
    state = F.when(F.col("now").isNull(), "gone").when(F.col("now") == F.col("recorded"), "fresh").otherwise("stale")
    return met.select("lang", "source", state.alias("state"))


@query("jaccard_sets", "WITH a AS (SELECT n_regionkey AS r, list(DISTINCT n_nationkey) AS s FROM nation GROUP BY 1), b AS (SELECT c_nationkey % 5 AS r, list(DISTINCT c_nationkey) AS s FROM customer WHERE c_acctbal > 5000 GROUP BY 1) SELECT a.r, round(len(list_intersect(a.s, coalesce(b.s, []))) / len(list_distinct(list_concat(a.s, coalesce(b.s, []))))::DOUBLE, 6) AS j FROM a LEFT JOIN b USING (r)")
def jaccard_sets(spark, d):
    a = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r")).agg(F.collect_set("n_nationkey").alias("s"))
    b = table(spark, d, "customer").where("c_acctbal > 5000").groupBy((F.col("c_nationkey") % 5).alias("r")).agg(F.collect_set("c_nationkey").alias("t"))
    return a.join(b, "r", "left").select("r", F.round(R.jaccard(F.col("s"), F.coalesce("t", F.array().cast("array<int>"))), 6).alias("j"))


@query("first_events", "SELECT event_id, any_value(event_type) AS event_type FROM events GROUP BY event_id")
def first_events(spark, d):
    from ..streaming import windows as W

    return W.first_events(table(spark, d, "events")).select("event_id", "event_type")
