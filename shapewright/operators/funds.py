"""Benchmarks of several legs that are rebalanced, and funds' ladders of yearly returns with liquidations and cash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def aligned(bars: DataFrame, reference: str) -> DataFrame:
    """leg, day, price on the days of the reference leg: each leg's last bar of that day or before; days before its first bar are left out. bars: leg, day, price."""
    days = bars.where(F.col("leg") == reference).select("day").distinct()
    asked = bars.select("leg").distinct().join(days).select("leg", "day", F.lit(None).cast("double").alias("price"), F.lit(True).alias("asked"))
    both = bars.select("leg", "day", "price", F.lit(False).alias("asked")).unionByName(asked)
    w = Window.partitionBy("leg").orderBy("day", "asked").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("price", F.last("price", ignorenulls=True).over(w)).where(F.col("asked") & F.col("price").isNotNull()).drop("asked")


def rebalanced(windows: DataFrame, prices: DataFrame, marks: DataFrame, weights: Callable[[Column, Column], Column]) -> DataFrame:
    """windows (entry, exit, rule) with gross, n_marks and n_legs of a basket that is brought to its weights at entry and at every mark before exit.

    prices: leg, day, price, of all legs on all days that matter. marks: day. weights(day, rule) is a map of each leg's share. Between two
    marks the holdings stand, so a stretch multiplies the value by the sum of shares times price relatives, and stretches multiply: no
    day is visited but the marks, and windows don't wait for each other.
    """
    at = windows.join(marks, (F.col("day") > F.col("entry")) & (F.col("day") < F.col("exit")))
    ends = F.explode(F.array(F.struct(F.col("entry").alias("day"), F.lit(1).alias("mark")), F.struct(F.col("exit").alias("day"), F.lit(0).alias("mark"))))
    points = at.select("entry", "exit", "rule", "day", F.lit(1).alias("mark")).distinct().unionAll(windows.select("entry", "exit", "rule", ends.alias("e")).select("entry", "exit", "rule", "e.*"))
    w = Window.partitionBy("entry", "exit", "rule").orderBy("day")
    parts = points.withColumn("until", F.lead("day").over(w)).where("until IS NOT NULL").withColumn("shares", weights(F.col("day"), F.col("rule")))
    parts = parts.withColumn("moved", ~F.col("shares").cast("string").eqNullSafe(F.lag(F.col("shares").cast("string")).over(w)))
    held = parts.select("entry", "exit", "rule", "day", "until", "moved", F.explode("shares").alias("leg", "share"))
    price = lambda when, name: prices.select("leg", F.col("day").alias(when), F.col("price").alias(name))
    met = held.join(price("day", "p0"), ["leg", "day"], "left").join(price("until", "p1"), ["leg", "until"], "left")
    stretch = met.groupBy("entry", "exit", "rule", "day", "moved").agg(F.sum(F.col("share") * F.col("p1") / F.col("p0")).alias("gross"), F.count(F.when(F.col("p0").isNull() | F.col("p1").isNull(), 1)).alias("absent"))
    gross = F.when(F.sum("absent") == 0, F.exp(F.sum(F.log("gross"))))
    return stretch.groupBy("entry", "exit", "rule").agg(gross.alias("gross"), F.count(F.lit(1)).alias("n_marks"), F.count(F.when(F.col("moved"), 1)).alias("n_legs"))


DOCUMENT = (
    "ticker string, last_trading_day date, liquidation_date date, years array<struct<year:int,tr_nav:double,tr_pct:double>>, partial_periods array<struct<period:string,tr_nav:double,tr_pct:double>>, "
    "cash_ladder struct<reference_day:date,nav:double,implied_nav:double,distributions:double,residual:double>"
)


def funds(documents: DataFrame, column: str = "doc") -> DataFrame:
    """ticker, fund_end, years, partial_periods and cash_ladder of documents in JSON; fund_end: the later of the last trading day and the liquidation.

    A document that cannot be read is an error, as its fund would else be left out.
    """
    parsed = documents.select(F.from_json(column, DOCUMENT, {"mode": "FAILFAST"}).alias("f")).select("f.*")
    return parsed.select("ticker", F.greatest("last_trading_day", "liquidation_date").alias("fund_end"), F.col("last_trading_day"), F.col("liquidation_date"), F.coalesce("years", F.array()).alias("years"), F.coalesce("partial_periods", F.array()).alias("partial_periods"), "cash_ladder")


def ladder(funds_: DataFrame) -> DataFrame:
    """ticker, year, tr_nav (null: not found), kind, date_from, date_to of each calendar year and stub.

    A stub from the first of January that reaches one of the fund's end dates is its liquidation; others are partial.
    """
    rate = lambda r: F.coalesce(r["tr_nav"], r["tr_pct"] / 100)
    day = lambda y, md: F.to_date(F.concat(y.cast("string"), F.lit(md)))
    whole = funds_.select("ticker", F.explode("years").alias("r"))
    whole = whole.select("ticker", F.col("r.year").alias("year"), rate(F.col("r")).alias("tr_nav"), F.lit("calendar_year").alias("kind"), day(F.col("r.year"), "-01-01").alias("date_from"), day(F.col("r.year"), "-12-31").alias("date_to"))
    stubs = funds_.select("ticker", F.least("last_trading_day", "liquidation_date").alias("first_end"), F.explode("partial_periods").alias("r"))
    stubs = stubs.select("ticker", "first_end", rate(F.col("r")).alias("tr_nav"), *[F.to_date(F.split_part("r.period", F.lit(".."), F.lit(i))).alias(n) for i, n in ((1, "date_from"), (2, "date_to"))])
    ends = (F.date_format("date_from", "MM-dd") == "01-01") & F.coalesce(F.col("date_to") >= F.col("first_end"), F.lit(False))
    return whole.unionByName(stubs.select("ticker", F.year("date_to").alias("year"), "tr_nav", F.when(ends, "liquidation").otherwise("partial").alias("kind"), "date_from", "date_to"))


def year_maps(rows: DataFrame) -> DataFrame:
    """ticker with cal, liq and part: returns by year of its calendar years, liquidation and stubs from January; the longest stub of a year counts."""
    known = rows.where("tr_nav IS NOT NULL")
    one = known.where((F.col("kind") != "partial") | (F.date_format("date_from", "MM-dd") == "01-01")).groupBy("ticker", "kind", "year").agg(F.max_by("tr_nav", "date_to").alias("tr"))
    entries = lambda kind: F.map_from_entries(F.filter(F.collect_list(F.when(F.col("kind") == kind, F.struct("year", "tr"))), lambda x: x.isNotNull()))
    return one.groupBy("ticker").agg(entries("calendar_year").alias("cal"), entries("liquidation").alias("liq"), entries("partial").alias("part"))


def compounded(funds_: DataFrame, windows: DataFrame) -> DataFrame:
    """ticker, first, last, gross, max_dd, n_open and state of every fund over every window of year-ends (first, last).

    A year's return multiplies the value. In the year that the fund ends its liquidation stub does, else its calendar year, else a stub;
    after it the value stands as cash. Where a reference value is known, what was paid and what is left of it take the place of the year
    after. Spans that nothing covers leave the value and count as open, which makes the state incomplete; else it is liquidated or
    running. A fund has a fold over a window's years, which are few.
    """
    maps = year_maps(ladder(funds_))
    empty = F.map_from_entries(F.array().cast("array<struct<year:int,tr:double>>"))
    rows = funds_.join(maps, "ticker", "left").withColumns({c: F.coalesce(c, empty) for c in ("cal", "liq", "part")}).join(windows)
    start = F.struct(F.lit(1.0).alias("v"), F.lit(1.0).alias("peak"), F.lit(0.0).alias("dd"), F.lit(0).alias("open"), F.lit(False).alias("over"))
    cash = (F.coalesce("cash_ladder.distributions", F.lit(0.0)) + F.coalesce("cash_ladder.residual", F.lit(0.0))) / F.col("cash_ladder.nav")

    def step(s: Column, y: Column) -> Column:
        cal, liq, part = (F.try_element_at(F.col(c), y) for c in ("cal", "liq", "part"))
        paid = F.coalesce((F.year("cash_ladder.reference_day") == y - 1) & F.col("cash_ladder.nav").isNotNull(), F.lit(False))
        ends = F.coalesce(F.year("fund_end") == y, F.lit(False))
        rate = F.when(ends, F.coalesce(liq, cal, part)).otherwise(F.coalesce(cal, part))
        uncovered = F.when(paid, 0).when(ends & liq.isNotNull(), 0).when(ends & cal.isNotNull(), F.col("cash_ladder").isNotNull().cast("int")).when(ends, 1).otherwise(cal.isNull().cast("int"))
        v = s["v"] * F.when(paid, cash).otherwise(1 + F.coalesce(rate, F.lit(0.0)))
        peak = F.greatest(s["peak"], v)
        moved = F.struct(v.alias("v"), peak.alias("peak"), F.least(s["dd"], v / peak - 1).alias("dd"), (s["open"] + uncovered).alias("open"), (paid | ends).alias("over"))
        return F.when(s["over"], s).otherwise(moved)

    out = rows.withColumn("s", F.aggregate(F.when(F.col("first") < F.col("last"), F.sequence(F.col("first") + 1, F.col("last"))).otherwise(F.array().cast("array<int>")), start, step))
    state = F.when(F.col("s.open") > 0, "incomplete").when(F.col("s.over"), "liquidated").otherwise("running")
    return out.select("ticker", "first", "last", F.col("s.v").alias("gross"), F.col("s.dd").alias("max_dd"), F.col("s.open").alias("n_open"), state.alias("state"))


def gap_sensitivity(funds_: DataFrame, windows: DataFrame) -> DataFrame:
    """How far the mark of the year a fund halted understates what its implied, unsourced value says was recovered, and what that does to the mean of all funds.

    ticker, first, last, mark, recovered, and basket and basket_alt, the yearly log returns of the equal-weight mean without and with it.
    """
    all_ = compounded(funds_, windows)
    mean = all_.groupBy("first", "last").agg(F.avg("gross").alias("mean"), F.count(F.lit(1)).alias("n"))
    cl, halt = F.col("cash_ladder"), F.year("last_trading_day")
    open_ = funds_.where(cl["implied_nav"].isNotNull() & cl["nav"].isNull()).select("ticker", halt.alias("halt"), ((F.coalesce(cl["distributions"], F.lit(0.0)) + F.coalesce(cl["residual"], F.lit(0.0))) / cl["implied_nav"]).alias("share"))
    rows = open_.join(year_maps(ladder(funds_)).select("ticker", "cal"), "ticker").join(windows).where((F.col("halt") > F.col("first")) & (F.col("halt") <= F.col("last")) & F.map_contains_key("cal", F.col("halt")))
    before = F.aggregate(F.filter(F.sequence(F.col("first") + 1, F.col("halt")), lambda y: y < F.col("halt")), F.lit(1.0), lambda v, y: v * (1 + F.coalesce(F.try_element_at("cal", y), F.lit(0.0))))
    told = rows.select("ticker", "first", "last", (before * (1 + F.element_at("cal", F.col("halt")))).alias("mark"), (before * F.col("share")).alias("recovered"))
    span = F.col("last") - F.col("first")
    return told.join(mean, ["first", "last"]).select("ticker", "first", "last", "mark", "recovered", (F.log("mean") / span).alias("basket"), (F.log(F.col("mean") + (F.col("recovered") - F.col("mark")) / F.col("n")) / span).alias("basket_alt"))
