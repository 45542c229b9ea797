"""Queries of rebalanced benchmarks and funds' ladders.

Daily bars of five kinds of events stand for prices of instruments, ISO weeks for years. Funds are nations: their yearly returns are the
growth of their orders' totals, in documents of which some lack years, some end early and some pay cash.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import funds as Fu
from .registry import query, r6
from .relational import BARS, bars
from .series import LEVELS, levels

BASE, SECOND, THIRD, WHOLE = "click", "view", "purchase", "signup"
SECOND_FROM, LATE_FROM, WHOLE_FROM = dt.date(2024, 1, 9), dt.date(2024, 1, 15), dt.date(2024, 1, 22)
EARLY, LATER, LATE = {BASE: 1.0}, {BASE: 0.6, SECOND: 0.4}, {BASE: 0.5, SECOND: 0.4, THIRD: 0.1}


def weights(day, rule):
    """One leg until the second begins, then two, or three for a later entry; the whole once it begins."""
    as_map = lambda w: F.create_map(*[F.lit(x) for kv in w.items() for x in kv])
    return F.when(day >= F.lit(WHOLE_FROM), as_map({WHOLE: 1.0})).when(rule == "late", as_map(LATE)).when(day >= F.lit(SECOND_FROM), as_map(LATER)).otherwise(as_map(EARLY))


def legs(spark, d):
    began = F.when(F.col("k") == SECOND, F.lit(SECOND_FROM)).when(F.col("k") == WHOLE, F.lit(WHOLE_FROM)).otherwise(F.lit(dt.date(1900, 1, 1)))
    kept = bars(spark, d).where(F.col("k").isin(BASE, SECOND, THIRD, WHOLE) & (F.col("day") >= began))
    return Fu.aligned(kept.select(F.col("k").alias("leg"), "day", F.col("close").alias("price")), BASE)


def week_ends(days):
    return days.groupBy(F.date_trunc("week", "day").alias("w")).agg(F.max("day").alias("day")).select("day")


def rule_of(entry):
    return F.when(entry >= F.lit(WHOLE_FROM), "whole").when(entry >= F.lit(LATE_FROM), "late").otherwise("early")


PHASE = "CASE WHEN day >= DATE '2024-01-22' THEN 'whole' WHEN rule = 'late' THEN 'late' WHEN day >= DATE '2024-01-09' THEN 'later' ELSE 'early' END"
UNITS = {"c": {"early": 1.0, "later": 0.6, "late": 0.5}, "v": {"later": 0.4, "late": 0.4}, "p": {"late": 0.1}, "s": {"whole": 1.0}}
HELD = ", ".join(f"CASE phase {' '.join(f"WHEN '{k}' THEN {x}" for k, x in w.items())} ELSE 0.0 END * value / coalesce({c}, 1) AS u{c}" for c, w in UNITS.items())
WORTH = " + ".join(f"r.u{c} * coalesce(n.{c}, 0)" for c in UNITS)

FOLD = f"""{BARS}, cal AS (SELECT DISTINCT day FROM bars WHERE k = '{BASE}'),
legs AS (SELECT k, day, last_value(close IGNORE NULLS) OVER (PARTITION BY k ORDER BY day) AS price FROM (SELECT DISTINCT k FROM bars) CROSS JOIN cal LEFT JOIN (SELECT * FROM bars WHERE k NOT IN ('{SECOND}', '{WHOLE}') OR (k = '{SECOND}' AND day >= DATE '2024-01-09') OR (k = '{WHOLE}' AND day >= DATE '2024-01-22')) USING (k, day)),
wide AS (SELECT day, max(price) FILTER (k = '{BASE}') AS c, max(price) FILTER (k = '{SECOND}') AS v, max(price) FILTER (k = '{THIRD}') AS p, max(price) FILTER (k = '{WHOLE}') AS s, row_number() OVER (ORDER BY day) AS i FROM legs GROUP BY day),
marks AS (SELECT max(day) AS day FROM cal GROUP BY date_trunc('week', day) UNION SELECT min(day) FROM cal WHERE day >= DATE '2024-01-09' UNION SELECT min(day) FROM cal WHERE day >= DATE '2024-01-22'),
win AS (SELECT a.day AS entry, b.day AS exit, CASE WHEN a.day >= DATE '2024-01-22' THEN 'whole' WHEN a.day >= DATE '2024-01-15' THEN 'late' ELSE 'early' END AS rule FROM cal a JOIN cal b ON a.day < b.day),
fold AS (
  SELECT entry, exit, rule, day, i, value, phase, marks, legs, {HELD} FROM (SELECT entry, exit, rule, day, i, c, v, p, s, 1.0::DOUBLE AS value, {PHASE} AS phase, 1 AS marks, 1 AS legs FROM win JOIN wide ON day = entry)
  UNION ALL
  SELECT entry, exit, rule, day, i, value, phase, marks, legs, CASE WHEN mark THEN nc ELSE uc END, CASE WHEN mark THEN nv ELSE uv END, CASE WHEN mark THEN np ELSE up END, CASE WHEN mark THEN ns ELSE us END
  FROM (SELECT *, {HELD.replace(" AS u", " AS n")} FROM (
    SELECT entry, exit, rule, day, i, value, c, v, p, s, mark, CASE WHEN mark THEN {PHASE} ELSE old END AS phase, marks + mark::INT AS marks, legs + (mark AND {PHASE} <> old)::INT AS legs, uc, uv, up, us
    FROM (SELECT r.entry, r.exit, r.rule, n.day, n.i, {WORTH} AS value, n.c, n.v, n.p, n.s, n.day < r.exit AND n.day IN (SELECT day FROM marks) AS mark, r.phase AS old, r.marks, r.legs, r.uc, r.uv, r.up, r.us FROM fold r JOIN wide n ON n.i = r.i + 1 AND n.day <= r.exit)))
)"""


def benchmark(spark, d, windows, prices):
    days = prices.where(F.col("leg") == BASE).select("day")
    starts = [days.where(F.col("day") >= F.lit(x)).agg(F.min("day").alias("day")) for x in (SECOND_FROM, WHOLE_FROM)]
    marks = week_ends(days).union(starts[0]).union(starts[1]).distinct()
    return Fu.rebalanced(windows, prices, marks, weights)


@query("rebalanced_benchmark", f"WITH RECURSIVE {FOLD} SELECT entry::VARCHAR AS entry, exit::VARCHAR AS exit, rule, round(value, 6) + 0.0 AS gross, marks::BIGINT AS n_marks, legs::BIGINT AS n_legs FROM fold WHERE day = exit")
def rebalanced_benchmark(spark, d):
    """Multiples over every window of days of a basket whose legs follow the entry and what has begun, brought to its weights at week ends; the SQL goes day by day."""
    prices = legs(spark, d)
    days = prices.where(F.col("leg") == BASE).select("day")
    pairs = days.select(F.col("day").alias("entry")).join(days.select(F.col("day").alias("exit")), F.col("entry") < F.col("exit"))
    out = benchmark(spark, d, pairs.withColumn("rule", rule_of(F.col("entry"))), prices)
    return out.select(F.col("entry").cast("string").alias("entry"), F.col("exit").cast("string").alias("exit"), "rule", r6("gross").alias("gross"), "n_marks", "n_legs")


@query("benchmark_ladder", f"WITH RECURSIVE {FOLD}, we AS (SELECT max(day) AS day FROM cal GROUP BY date_trunc('week', day)), st AS (SELECT lag(day) OVER (ORDER BY day) AS a, day AS b FROM we) SELECT b::VARCHAR AS day, round(exp(sum(ln(value)) OVER (ORDER BY b)), 6) + 0.0 AS level FROM st JOIN fold ON entry = a AND exit = b AND day = b")
def benchmark_ladder(spark, d):
    """The benchmark chained from week end to week end, each stretch with the rule of its own entry."""
    prices = legs(spark, d)
    w = Window.orderBy("day")  # one row for each week
    steps = week_ends(prices.where(F.col("leg") == BASE).select("day")).select(F.lag("day").over(w).alias("entry"), F.col("day").alias("exit")).where("entry IS NOT NULL")
    out = benchmark(spark, d, steps.withColumn("rule", rule_of(F.col("entry"))), prices)
    return out.select(F.col("exit").cast("string").alias("day"), r6(F.exp(F.sum(F.log("gross")).over(Window.orderBy("exit")))).alias("level"))


# ladders -----------------------------------------------------------------------------------------------------------

WINDOWS = ((1995, 1998), (1996, 2001), (1997, 2000))
ENDED, PAID, HALTED = 0, 3, 5
"""Remainders by 7 of nations whose fund was liquidated, paid out from a known value, or halted without one."""

LADDER = f"""{LEVELS}, gro AS (SELECT entity AS e, year AS y, y / lag(y) OVER (PARTITION BY entity ORDER BY year) - 1 AS tr FROM lv),
kept AS (SELECT e, y, CASE WHEN (e + y) % 6 <> 0 THEN tr END AS tr FROM gro WHERE tr IS NOT NULL AND NOT (e % 7 IN ({ENDED}, {PAID}) AND y >= 1999) AND NOT (e % 7 = {HALTED} AND y > 1999)),
lad AS (SELECT e, y, tr, 'calendar_year' AS kind, make_date(y, 1, 1) AS date_from, make_date(y, 12, 31) AS date_to FROM kept UNION ALL
  SELECT e, y, tr / 2, CASE WHEN e % 14 = 0 THEN 'liquidation' ELSE 'partial' END, DATE '1999-01-01', CASE WHEN e % 14 = 0 THEN DATE '1999-05-15' ELSE DATE '1999-03-31' END FROM gro WHERE e % 7 = {ENDED} AND y = 1999 AND tr IS NOT NULL),
fu AS (SELECT DISTINCT entity AS e, CASE entity % 7 WHEN {ENDED} THEN 1999 WHEN {PAID} THEN 1999 WHEN {HALTED} THEN 1999 END AS ends, CASE entity % 7 WHEN {PAID} THEN (2 * entity + 5) / 100.0 END AS cash, entity % 7 IN ({PAID}, {HALTED}) AS pays FROM lv),
win AS (SELECT * FROM (VALUES {", ".join(map(str, WINDOWS))}) t(a, b)),
yrs AS (SELECT e, y, max(tr) FILTER (kind = 'calendar_year') AS cal, max(tr) FILTER (kind = 'liquidation') AS liq, max(tr) FILTER (kind = 'partial') AS part FROM lad GROUP BY e, y),
fold AS (
  SELECT e, a, b, a AS y, 1.0::DOUBLE AS v, 1.0::DOUBLE AS peak, 0.0::DOUBLE AS dd, 0 AS open, FALSE AS over FROM fu, win
  UNION ALL
  SELECT e, a, b, y, v, greatest(peak, v), least(dd, v / greatest(peak, v) - 1), open, over FROM (
    SELECT r.e, r.a, r.b, r.y + 1 AS y, r.peak, r.dd, r.v * CASE WHEN r.over THEN 1 WHEN cash IS NOT NULL AND r.y = 1998 THEN cash WHEN ends = r.y + 1 THEN 1 + coalesce(liq, cal, part, 0) ELSE 1 + coalesce(cal, part, 0) END AS v,
      r.open + CASE WHEN r.over OR (cash IS NOT NULL AND r.y = 1998) THEN 0 WHEN ends = r.y + 1 AND liq IS NOT NULL THEN 0 WHEN ends = r.y + 1 AND cal IS NOT NULL THEN pays::INT WHEN ends = r.y + 1 THEN 1 ELSE (cal IS NULL)::INT END AS open,
      r.over OR (cash IS NOT NULL AND r.y = 1998) OR coalesce(ends = r.y + 1, FALSE) AS over
    FROM fold r JOIN fu USING (e) LEFT JOIN yrs ON yrs.e = r.e AND yrs.y = r.y + 1 WHERE r.y < r.b)
)"""


def documents(spark, d):
    """doc: a JSON document for each nation, as an issuer's transcribed figures."""
    year = F.col("year")
    tr = levels(spark, d).withColumn("tr", F.col("y") / F.lag("y").over(Window.partitionBy("entity").orderBy("year")) - 1)
    group = F.col("entity") % 7
    kept = F.col("tr").isNotNull() & ~(group.isin(ENDED, PAID) & (year >= 1999)) & ~((group == HALTED) & (year > 1999))
    value = F.when((F.col("entity") + year) % 6 != 0, F.col("tr"))
    own = F.struct(year.alias("year"), F.when(F.col("entity") % 2 == 1, value).alias("tr_nav"), F.when(F.col("entity") % 2 == 0, 100 * value).alias("tr_pct"))
    stub = F.when((group == ENDED) & (year == 1999) & F.col("tr").isNotNull(), F.struct(F.when(F.col("entity") % 14 == 0, "1999-01-01..1999-05-15").otherwise("1999-01-01..1999-03-31").alias("period"), (F.col("tr") / 2).alias("tr_nav")))
    some = lambda c: F.filter(F.collect_list(c), lambda x: x.isNotNull())
    byfund = tr.groupBy("entity").agg(some(F.when(kept, own)).alias("years"), some(stub).alias("partial_periods"))
    e = F.col("entity").cast("double")
    cash = F.when(group == PAID, F.struct(F.lit("1998-12-31").alias("reference_day"), F.lit(100.0).alias("nav"), F.lit(None).cast("double").alias("implied_nav"), (2 * e).alias("distributions"), F.lit(5.0).alias("residual")))
    cash = cash.when(group == HALTED, F.struct(F.lit(None).cast("string").alias("reference_day"), F.lit(None).cast("double").alias("nav"), F.lit(100.0).alias("implied_nav"), (60 + e).alias("distributions"), F.lit(1.0).alias("residual")))
    last = F.when(group == ENDED, "1999-05-15").when(group == PAID, "1999-03-01").when(group == HALTED, "1999-06-01")
    return byfund.select(F.to_json(F.struct(F.col("entity").cast("string").alias("ticker"), last.alias("last_trading_day"), "years", "partial_periods", cash.alias("cash_ladder"))).alias("doc"))


def windows(spark):
    return spark.createDataFrame(list(WINDOWS), "first int, last int")


@query("ladder_rows", f"WITH {LADDER[: LADDER.index('fu AS')].rstrip().rstrip(',')} SELECT e AS ticker, y AS year, round(tr, 6) + 0.0 AS tr_nav, kind, date_from::VARCHAR AS date_from, date_to::VARCHAR AS date_to FROM lad")
def ladder_rows(spark, d):
    """Documents parsed to rows by year and stub, with the kind of each."""
    out = Fu.ladder(Fu.funds(documents(spark, d)))
    return out.select(F.col("ticker").cast("int").alias("ticker"), "year", r6("tr_nav").alias("tr_nav"), "kind", *[F.col(c).cast("string").alias(c) for c in ("date_from", "date_to")])


@query("ladder_windows", f"WITH RECURSIVE {LADDER} SELECT e AS ticker, a AS first, b AS last, round(v, 6) + 0.0 AS gross, round(dd, 6) + 0.0 AS max_dd, open AS n_open, CASE WHEN open > 0 THEN 'incomplete' WHEN over THEN 'liquidated' ELSE 'running' END AS state FROM fold WHERE y = b")
def ladder_windows(spark, d):
    """Every fund's multiple, drawdown and state over some windows, with liquidations, cash and years that are not known; the SQL goes year by year."""
    out = Fu.compounded(Fu.funds(documents(spark, d)), windows(spark))
    return out.select(F.col("ticker").cast("int").alias("ticker"), "first", "last", r6("gross").alias("gross"), r6("max_dd").alias("max_dd"), "n_open", "state")


@query("ladder_gap_sensitivity", f"WITH RECURSIVE {LADDER}, me AS (SELECT a, b, avg(v) AS mean, count(*) AS n FROM fold WHERE y = b GROUP BY ALL), h AS (SELECT e, cal, (61 + e) / 100.0 AS share FROM yrs WHERE e % 7 = {HALTED} AND y = 1999 AND cal IS NOT NULL), x AS (SELECT h.e, win.a, win.b, cal, share, coalesce((SELECT exp(sum(ln(1 + k.cal))) FROM yrs k WHERE k.e = h.e AND k.y > win.a AND k.y < 1999 AND k.cal IS NOT NULL), 1) AS ref FROM h, win WHERE win.a < 1999 AND win.b >= 1999) SELECT e AS ticker, a AS first, b AS last, round(ref * (1 + cal), 6) + 0.0 AS mark, round(ref * share, 6) + 0.0 AS recovered, round(ln(mean) / (b - a), 6) + 0.0 AS basket, round(ln(mean + (ref * share - ref * (1 + cal)) / n) / (b - a), 6) + 0.0 AS basket_alt FROM x JOIN me USING (a, b)")
def ladder_gap_sensitivity(spark, d):
    """What an unsourced value of halted funds would change: their mark against what was recovered, and the mean of all funds."""
    out = Fu.gap_sensitivity(Fu.funds(documents(spark, d)), windows(spark))
    return out.select(F.col("ticker").cast("int").alias("ticker"), "first", "last", *[r6(c).alias(c) for c in ("mark", "recovered", "basket", "basket_alt")])
