"""Queries of joins, sets, governance and integrity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import relational as R
from ..session import table
from .registry import on_profiles, query, r6


@query("left_chain_span", """SELECT n_nationkey AS entity, n_name AS name, c.n AS n_customers, s.n AS n_suppliers, round(c.best, 6) + 0.0 AS best FROM nation
LEFT JOIN (SELECT c_nationkey, count(*) AS n, max(c_acctbal) AS best FROM customer GROUP BY ALL) c ON c_nationkey = n_nationkey
LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY ALL) s ON s_nationkey = n_nationkey""")
def left_chain_span(spark, d):
    """Each side is aggregated before it is joined."""
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_customers"), F.max("c_acctbal").alias("best"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_suppliers"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return n.join(c, "k", "left").join(s, "k", "left").select(F.col("k").alias("entity"), "name", "n_customers", "n_suppliers", r6("best").alias("best"))


@query("full_outer_panel", """SELECT coalesce(a.y, b.y)::INT AS year, coalesce(a.k, b.k) AS entity, round(coalesce(a.v, b.v), 6) + 0.0 AS v, CASE WHEN a.v IS NOT NULL THEN 'orders' ELSE 'lines' END AS source FROM
(SELECT year(o_orderdate) AS y, c_nationkey AS k, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey < 15 GROUP BY ALL) a FULL JOIN
(SELECT year(l_shipdate) AS y, c_nationkey AS k, sum(l_extendedprice) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_nationkey > 10 GROUP BY ALL) b ON a.y = b.y AND a.k = b.k""")
def full_outer_panel(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("entity"))
    oc = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    a = oc.where("entity < 15").groupBy(F.year("o_orderdate").alias("year"), "entity").agg(F.sum("o_totalprice").alias("a"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_extendedprice")
    b = lines.join(oc.where("entity > 10").select("o_orderkey", "entity"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.year("l_shipdate").alias("year"), "entity").agg(F.sum("l_extendedprice").alias("b"))
    return a.join(b, ["year", "entity"], "full_outer").select("year", "entity", r6(F.coalesce("a", "b")).alias("v"), F.when(F.col("a").isNotNull(), "orders").otherwise("lines").alias("source"))


@query("semi_known", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_known(spark, d):
    known = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(known, F.col("o_custkey") == F.col("c_custkey"), "left_semi")


@query("anti_orphans", "SELECT c_nationkey AS code, count(*) AS n, min(year(o_orderdate))::INT AS first_year, max(year(o_orderdate))::INT AS last_year FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey < 12) GROUP BY ALL")
def anti_orphans(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("year")).join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return R.remap(rows, "c_nationkey", table(spark, d, "supplier").where("s_nationkey < 12"), "s_nationkey")[1].withColumnRenamed("code", "code")


@query("priority_union", "SELECT k, round(arg_min(v, r), 6) + 0.0 AS v, min(r)::INT AS source_rank FROM (SELECT c_nationkey AS k, max(c_acctbal) AS v, 0 AS r FROM customer WHERE c_nationkey % 3 = 0 GROUP BY ALL UNION ALL SELECT s_nationkey, max(s_acctbal), 1 FROM supplier GROUP BY ALL) GROUP BY k")
def priority_union(spark, d):
    a = table(spark, d, "customer").where("c_nationkey % 3 = 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_acctbal").alias("v"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_acctbal").alias("v"))
    return R.by_priority([a, b], ["k"]).select("k", r6("v").alias("v"), "source_rank")


BARS = "bars AS (SELECT event_type AS k, ts::DATE AS day, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY ALL)"


def bars(spark, d):
    """Last value of each event type and day."""
    e = table(spark, d, "events").select(F.col("event_type").alias("k"), F.to_date("ts").alias("day"), "ts", "event_id", "value")
    return e.groupBy("k", "day").agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"))


@query("daily_bars", f"WITH {BARS} SELECT k, day::VARCHAR AS day, round(close, 6) + 0.0 AS close FROM bars")
def daily_bars(spark, d):
    return bars(spark, d).select("k", F.col("day").cast("string").alias("day"), r6("close").alias("close"))


SPARSE = BARS + ", sparse AS (SELECT * FROM bars WHERE day(day) % 4 = 1), asked AS (SELECT DISTINCT k, day FROM bars)"
ASOF = "SELECT a.k, a.day, s.day AS d0, s.close FROM asked a ASOF LEFT JOIN sparse s ON a.k = s.k AND s.day <= a.day"


def as_of_days(spark, d, tolerance=None):
    b = bars(spark, d)
    return R.as_of(b.select("k", "day"), b.where(F.dayofmonth("day") % 4 == 1).withColumnRenamed("day", "bar_day"), ["k"], "day", "bar_day", "close", tolerance)


@query("asof_last_bar", f"WITH {SPARSE} SELECT k, day::VARCHAR AS day, d0::VARCHAR AS bar_day, round(close, 6) + 0.0 AS close FROM ({ASOF})")
def asof_last_bar(spark, d):
    return as_of_days(spark, d).select("k", F.col("day").cast("string").alias("day"), F.col("as_of_time").cast("string").alias("bar_day"), r6("as_of_value").alias("close"))


@query("asof_tolerance", f"WITH {SPARSE} SELECT k, day::VARCHAR AS day, CASE WHEN day - d0 <= 2 THEN round(close, 6) + 0.0 END AS close FROM ({ASOF})")
def asof_tolerance(spark, d):
    return as_of_days(spark, d, F.datediff("day", "as_of_time") <= 2).select("k", F.col("day").cast("string").alias("day"), r6("as_of_value").alias("close"))


TIERS_SQL = """WITH c AS (SELECT c_custkey AS k, c_nationkey AS g, ln(c_acctbal) AS y FROM customer WHERE c_acctbal > 1000),
q AS (SELECT g, quantile_cont(y, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS cuts FROM c GROUP BY g), t AS (SELECT c.*, len(list_filter(cuts, lambda x: x <= y)) AS tenth FROM c JOIN q USING (g)),
m AS (SELECT a.k, count(*) FILTER (abs(a.y - b.y) <= 0.35) AS n1, min(b.k) FILTER (abs(a.y - b.y) <= 0.35) AS f1, count(*) FILTER (a.tenth = b.tenth) AS n2, min(b.k) FILTER (a.tenth = b.tenth) AS f2, count(*) AS n3, min(b.k) AS f3
      FROM t a JOIN t b ON a.g = b.g AND a.k <> b.k GROUP BY a.k)
SELECT k AS custkey, CASE WHEN n1 > 0 THEN n1 WHEN n2 > 0 THEN n2 ELSE n3 END AS n, coalesce(f1, f2, f3) AS first, CASE WHEN n1 > 0 THEN 'caliper' WHEN n2 > 0 THEN 'decile' ELSE 'any' END AS tier FROM m"""


@query("caliper_band_join", TIERS_SQL)
def caliper_band_join(spark, d):
    """Partners of each customer within a caliper of the log balance, else in its tenth of the nation, else any of the nation."""
    c = table(spark, d, "customer").where("c_acctbal > 1000").select(F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("nation"), F.log("c_acctbal").alias("y"))
    return R.band_tiers(c, "custkey", "y", 0.35, "nation")


@query("interval_overlap", on_profiles("SELECT a.entity, a.year, bool_or(abs(a.year - b.year) < 2) AS overlap FROM k a JOIN k b ON a.entity = b.entity WHERE b.year % 3 = 0 GROUP BY ALL"))
def interval_overlap(spark, d):
    """Whether a window of two years meets one of the entity's marked years."""
    k = C.cells(spark, d).select("entity", "year").distinct()
    marked = k.where("year % 3 = 0").select(F.col("entity").alias("e"), F.col("year").alias("y"))
    return k.join(marked, F.col("entity") == F.col("e")).groupBy("entity", "year").agg(F.max(F.abs(F.col("year") - F.col("y")) < 2).alias("overlap"))


@query("except_diff", "(SELECT 'customers' AS only_in, c_nationkey AS k FROM customer EXCEPT SELECT 'customers', s_nationkey FROM supplier) UNION ALL (SELECT 'suppliers', s_nationkey FROM supplier EXCEPT SELECT 'suppliers', c_nationkey FROM customer WHERE c_nationkey > 4)")
def except_diff(spark, d):
    c, s = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.subtract(s).select(F.lit("customers").alias("only_in"), "k").unionAll(s.subtract(c.where("k > 4")).select(F.lit("suppliers").alias("only_in"), "k"))


@query("store_diff", on_profiles("SELECT entity, year, round(max(abs(s - CASE WHEN entity = 3 AND bin = 0 THEN s * 0.5 ELSE s END)), 6) + 0.0 AS worst FROM prof GROUP BY ALL HAVING worst > 0"))
def store_diff(spark, d):
    """Profiles that differ between two stores, by the largest gap of a share."""
    now = C.shares(C.cells(spark, d)).select("entity", "year", "pos", "bin", "s")
    old = now.withColumn("s", F.when((F.col("entity") == 3) & (F.col("bin") == 0), F.col("s") * 0.5).otherwise(F.col("s")))
    met = now.join(old.select("entity", "year", "pos", F.col("s").alias("o")), ["entity", "year", "pos"])
    return met.groupBy("entity", "year").agg(r6(F.max(F.abs(F.col("s") - F.col("o")))).alias("worst")).where("worst > 0")


@query("coverage", """SELECT c_nationkey AS entity, 'orders' AS series, min(y)::INT AS first_year, max(y)::INT AS last_year, count(DISTINCT y) AS n_years, (max(y) - min(y) + 1 - count(DISTINCT y))::INT AS gaps, (max(y) FILTER (y <= 1999))::INT AS last_actual
FROM (SELECT c_nationkey, year(o_orderdate) AS y FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000) GROUP BY ALL
UNION ALL SELECT s_nationkey, 'suppliers', min(1995)::INT, max(1995)::INT, 1, 0, 1995 FROM supplier GROUP BY ALL""")
def coverage(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 300000").select("o_custkey", F.year("o_orderdate").alias("year")).join(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("entity")), F.col("o_custkey") == F.col("c_custkey"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("entity"), F.lit(1995).alias("year"))
    both = o.select("entity", "year", F.lit("orders").alias("series")).unionByName(s.withColumn("series", F.lit("suppliers")))
    return R.coverage(both, ["entity", "series"], actual=F.col("year") <= 1999)


@query("coverage_summary", """SELECT count(*) FILTER (n >= 6) AS enough, string_agg(k::VARCHAR, ',' ORDER BY k) FILTER (n < 6) AS below FROM (SELECT c_nationkey AS k, count(DISTINCT year(o_orderdate)) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000 GROUP BY ALL)""")
def coverage_summary(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 400000").select("o_custkey", F.year("o_orderdate").alias("year")).join(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k")), F.col("o_custkey") == F.col("c_custkey"))
    n = o.groupBy("k").agg(F.countDistinct("year").alias("n"))
    below = F.sort_array(F.collect_list(F.when(F.col("n") < 6, F.col("k"))))
    return n.agg(F.count(F.when(F.col("n") >= 6, 1)).alias("enough"), F.when(F.size(below) > 0, F.array_join(F.transform(below, lambda x: x.cast("string")), ",")).alias("below"))


@query("integrity_suite", on_profiles("""SELECT 'bins' AS "check", count(*) AS n FROM (SELECT entity, year FROM cells GROUP BY ALL HAVING count(*) <> 20 OR min(bin) <> 0 OR max(bin) <> 9)
UNION ALL SELECT 'negative', count(*) FROM cells WHERE pop < 0 UNION ALL SELECT 'share_sum', count(*) FROM (SELECT entity, year FROM prof GROUP BY ALL HAVING abs(sum(s) - 1) >= 1e-12)
UNION ALL SELECT 'dangling', count(*) FROM cells WHERE entity NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT 'u16', count(*) FROM cells WHERE FALSE"""))
def integrity_suite(spark, d):
    cells = C.cells(spark, d)
    shares = C.shares(cells)
    return R.violations({
        "bins": cells.groupBy("entity", "year").agg(F.count(F.lit(1)).alias("n"), F.min("bin").alias("lo"), F.max("bin").alias("hi")).where("n <> 20 OR lo <> 0 OR hi <> 9"),
        "negative": cells.where("pop < 0"),
        "share_sum": shares.groupBy("entity", "year").agg(F.sum("s").alias("s")).where("abs(s - 1) >= 1e-12"),
        "dangling": cells.join(table(spark, d, "nation"), F.col("entity") == F.col("n_nationkey"), "left_anti"),
        "u16": C.quantised(shares).groupBy("entity", "year").agg(F.sum("u").alias("u")).where("u <> 65535"),
    })


@query("licence_filter", "SELECT source, count(*) AS n FROM documents JOIN (VALUES ('src0', TRUE), ('src1', FALSE), ('src2', TRUE)) l(src, ok) ON src = source WHERE ok GROUP BY ALL")
def licence_filter(spark, d):
    rights = spark.createDataFrame([("src0", True), ("src1", False), ("src2", True)], "source string, ok boolean")
    return table(spark, d, "documents").select("source").join(F.broadcast(rights.where("ok")), "source").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("source_lists", "SELECT lang, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, count(*) FILTER (n_chars > 2000) AS n_long FROM documents GROUP BY lang")
def source_lists(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count(F.when(F.col("n_chars") > 2000, 1)).alias("n_long"))


@query("pivot_wide", "SELECT year(o_orderdate)::INT AS year, " + ", ".join(f"count(*) FILTER (o_orderstatus = '{s}') AS \"{s}\"" for s in "FOP") + " FROM orders GROUP BY ALL")
def pivot_wide(spark, d):
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), "o_orderstatus")
    return o.groupBy("year").pivot("o_orderstatus", list("FOP")).agg(F.count(F.lit(1))).na.fill(0)


@query("unpivot_long", "SELECT p_partkey AS id, 'size' AS indicator, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part WHERE p_retailprice IS NOT NULL")
def unpivot_long(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return p.unpivot("id", ["size", "price"], "indicator", "value").where("value IS NOT NULL")


@query("alias_duplicates", "SELECT p_brand AS alias, count(DISTINCT p_type) AS n FROM part GROUP BY ALL HAVING count(DISTINCT p_type) > 1")
def alias_duplicates(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("alias")).agg(F.countDistinct("p_type").alias("n")).where("n > 1")


@query("first_of_source", "SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def first_of_source(spark, d):
    """The first row of each key in order: an aggregate with partial minima, no window."""
    e = table(spark, d, "events").select("event_type", "user_id", "ts", "event_id")
    return e.groupBy("event_type", "user_id").agg(F.min(F.struct("ts", "event_id")).alias("m")).select("event_type", "user_id", "m.event_id")


@query("grouped_hits", "SELECT p_type, p_partkey, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 8")
def grouped_hits(spark, d):
    w = Window.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, d, "part").select("p_type", "p_partkey", "p_retailprice").withColumn("rank", F.row_number().over(w)).where("rank <= 8").select("p_type", "p_partkey", "rank")


@query("largest_revisions", "SELECT o_orderkey, round(o_totalprice, 6) + 0.0 AS v FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def largest_revisions(spark, d):
    return table(spark, d, "orders").select("o_orderkey", r6("o_totalprice").alias("v")).orderBy(F.desc("v"), "o_orderkey").limit(10)
