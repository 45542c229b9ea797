"""Time series: growth, splicing, drawdown, gaps, alignment, windows of returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def growth(levels: DataFrame, horizon: int, key: str = "entity", year: str = "year", value: str = "y") -> DataFrame:
    """g, the mean log growth from year to year + horizon, where both are there: one window over dense or gappy years."""
    w = Window.partitionBy(key).orderBy(year).rangeBetween(horizon, horizon)
    later = F.first(value).over(w)
    return levels.withColumn("g", F.log(F.try_divide(later, F.col(value))) / horizon).where("g IS NOT NULL").select(key, year, "g")


def change(span: int, key: str, year: str, value: str) -> Column:
    """Value minus that of span years before, or what the next span years bring where there is none before."""
    w = Window.partitionBy(key).orderBy(year)
    back, ahead = F.first(value).over(w.rangeBetween(-span, -span)), F.first(value).over(w.rangeBetween(span, span))
    return F.coalesce(F.col(value) - back, ahead - F.col(value))


def trailing_mean(value: str, key: str, year: str, span: int, least: int) -> Column:
    """Mean of the last span years where at least so many have a value."""
    w = Window.partitionBy(key).orderBy(year).rangeBetween(1 - span, 0)
    return F.when(F.count(value).over(w) >= least, F.avg(value).over(w))


def spliced(spine: DataFrame, key: str = "entity", year: str = "year", base: str = "base", first: str = "w1", second: str = "w2") -> DataFrame:
    """level: base to its last year, then grown by the ratios of first, or of second where first has none, to the first year without either.

    One window orders a key's years; the product of ratios is a running sum of logs that holds while a running minimum says that no
    year was missing. Gaps inside base stay missing. used tells what a level comes from.
    """
    w = Window.partitionBy(key).orderBy(year)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    ratio = lambda c: F.when(F.lag(year).over(w) == F.col(year) - 1, F.log(F.try_divide(F.col(c), F.lag(c).over(w))))
    out = spine.withColumn("last_base", F.max(F.when(F.col(base).isNotNull(), F.col(year))).over(Window.partitionBy(key))).withColumn("r1", ratio(first)).withColumn("r2", ratio(second))
    after = F.col(year) > F.col("last_base")
    out = out.withColumn("step", F.when(after, F.coalesce("r1", "r2"))).withColumn("ok", F.when(after, F.coalesce("r1", "r2").isNotNull().cast("int")).otherwise(1))
    out = out.withColumn("whole", F.min("ok").over(run)).withColumn("sum", F.sum("step").over(run)).withColumn("start", F.last(base, ignorenulls=True).over(run))
    level = F.when(~after, F.col(base)).when(after & (F.col("whole") == 1), F.col("start") * F.exp("sum"))
    used = F.when(~after, F.when(F.col(base).isNotNull(), "base")).when(F.col("whole") == 1, F.when(F.col("r1").isNotNull(), "first").otherwise("second"))
    return out.select(key, year, level.alias("level"), used.alias("used"))


def drawdown(key: str, time: str, value: str) -> Column:
    """Value over its running maximum, less 1."""
    top = F.max(value).over(Window.partitionBy(key).orderBy(time).rowsBetween(Window.unboundedPreceding, 0))
    return F.try_divide(F.col(value), top) - 1


def gap_days(key: str, day: str) -> Column:
    return F.datediff(F.col(day), F.lag(day).over(Window.partitionBy(key).orderBy(day)))


def guard(bars: DataFrame, key: str, day: str, least_bars: int, most_gap: int, today: Column, live_days: int) -> DataFrame:
    """n_bars, longest_gap and failed, the rules that a series breaks."""
    gaps = bars.withColumn("_gap", gap_days(key, day))
    out = gaps.groupBy(key).agg(F.count(F.lit(1)).alias("n_bars"), F.max("_gap").alias("longest_gap"), F.max(day).alias("last_day"))
    rules = F.array_compact(F.array(F.when(F.col("n_bars") < least_bars, "bars"), F.when(F.col("longest_gap") > most_gap, "gap"), F.when(F.datediff(today, F.col("last_day")) > live_days, "live")))
    return out.select(key, "n_bars", "longest_gap", F.array_join(rules, ",").alias("failed"))


def filled(rows: DataFrame, calendar: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Every key on every time of the calendar, with the last value at or before it."""
    spine = rows.select(key).distinct().crossJoin(calendar.select(time).distinct())  # the rows that are asked for
    w = Window.partitionBy(key).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return spine.join(rows.select(key, time, value), [key, time], "left").withColumn(value, F.last(value, ignorenulls=True).over(w))
