"""Queries behind pages and records: flags, time shifts, sweeps, windows by instrument, ladders, SQL functions, small parsers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bands as B
from ..operators import corpus as C
from ..operators import features as Fe
from ..operators import metrics as M
from ..operators import search as S
from ..session import register_distances, table
from .evaluation import EMB, K, search_vectors
from .profile import BLEND, FEATURES, GRID_SQL, L2, W1, mmr_sql, over_pairs, search_sql
from .registry import on_profiles, query, r6
from .relational import BARS, bars
from .series import LEVELS, levels


@query("feature_flags", on_profiles("SELECT entity, year, CASE WHEN median_value < 20 THEN 'expansive' WHEN median_value >= 27 THEN 'constrictive' ELSE 'stationary' END AS stage, side_ratio > 1.1 AS skewed, modal_bin >= 35 AS urn FROM fe", FEATURES))
def feature_flags(spark, d):
    """The features that are no numbers: stage, a side that outweighs the other in the middle, a peak near the top."""
    f = Fe.features(C.profiles(spark, d))
    return f.select("entity", "year", Fe.stage(F.col("median_value")).alias("stage"), (F.col("side_ratio") > 1.1).alias("skewed"), (F.col("modal_bin") >= 35).alias("urn"))


SHIFT = search_sql("TRUE")[1] + f", bg AS (SELECT quantile_cont(m, {GRID_SQL}) AS q FROM (SELECT min(d) AS m FROM dd GROUP BY entity, year, b_entity))"


@query("time_shift_bands", on_profiles(f"SELECT entity, year, b_entity, b_year, CASE WHEN d >= q[{B.P95 + 1}] THEN 'extreme' WHEN d >= q[{B.P75 + 1}] THEN 'far' WHEN d <= q[{B.P5 + 1}] THEN 'very_close' WHEN d <= q[{B.P25 + 1}] THEN 'close' ELSE 'typical' END AS label FROM one, bg", SHIFT))
def time_shift_bands(spark, d):
    """The best year of each other entity and how close that is among best years."""
    best = S.best_of_entity(S.scanned(C.profiles(spark, d), S.Query("any")).drop("lo", "hi"))
    grid = F.broadcast(B.bands(best).select("q"))  # one row
    return best.join(grid).select("entity", "year", "b_entity", "b_year", B.label(F.col("d"), F.col("q")).alias("label"))


@query("mmr_beta_sweep", " UNION ALL ".join(f"SELECT {beta}::DOUBLE AS beta, s.* FROM ({mmr_sql(3, beta)}) s" for beta in (0.0, 0.5, 1.0)))
def mmr_beta_sweep(spark, d):
    """Diversified opposites for several weights; with 0 they are the farthest."""
    p, out = C.profiles(spark, d), None
    for beta in (0.0, 0.5, 1.0):
        new = S.diversified(p, S.Query(), beta=beta).select(F.lit(beta).alias("beta"), "entity", "year", "b_entity", F.col("rank_raw").cast("int").alias("rank_raw"), F.col("turn").cast("int").alias("turn"), (F.col("d") + F.lit(0.0)).alias("d"))
        out = new if out is None else out.unionAll(new)
    return out


@query("knn_where", f"WITH {EMB}, nn AS (SELECT a.id, b.id AS b_id, round(1 - list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)) + 1e-12), 9) AS d FROM e a JOIN e b ON a.id <> b.id AND a.id % 10 = 0 AND b.label < 5) SELECT id, b_id, rank, round(d, 6) + 0.0 AS d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, b_id)::INT AS rank FROM nn QUALIFY rank <= {K})")
def knn_where(spark, d):
    """Nearest vectors among those that a predicate lets in, which is applied before any distance."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")
    return search_vectors(e.where("id % 10 = 0"), e.where("label < 5"), K).select("id", "b_id", "rank", r6("d").alias("d"))


@query("sql_distances", on_profiles("SELECT entity, year, b_entity, round(d, 6) + 0.0 AS d FROM dist WHERE d < 5", over_pairs(BLEND)))
def sql_distances(spark, d):
    """The blended distance as a function of SQL."""
    register_distances(spark)
    p = C.profiles(spark, d).select("entity", "year", "s", "c")
    met = p.join(p.select(F.col("entity").alias("b_entity"), "year", F.col("s").alias("bs"), F.col("c").alias("bc")), "year").where("entity <> b_entity")
    return met.select("entity", "year", "b_entity", F.expr("blend_d(s, bs, c, bc)").alias("d")).where("d < 5").select("entity", "year", "b_entity", r6("d").alias("d"))


WINDOWS = (("all", "2024-01-01", "2024-01-31"), ("first", "2024-01-01", "2024-01-15"), ("second", "2024-01-16", "2024-01-31"))


@query("instrument_windows", f"WITH {BARS} SELECT k, w, count(*) AS n, round(ln(arg_max(close, day) / arg_min(close, day)), 6) + 0.0 AS r_log FROM bars JOIN (VALUES {', '.join(str(w) for w in WINDOWS)}) t(w, a, b) ON day BETWEEN a::DATE AND b::DATE GROUP BY ALL")
def instrument_windows(spark, d):
    """Every series over every window that it has bars in."""
    windows = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b")) for w, a, b in WINDOWS])
    held = bars(spark, d).withColumn("t", F.explode(windows)).where("day BETWEEN t.a AND t.b")
    return held.groupBy("k", F.col("t.w").alias("w")).agg(F.count(F.lit(1)).alias("n"), r6(F.log(F.try_divide(F.max_by("close", "day"), F.min_by("close", "day")))).alias("r_log"))


NAV = LEVELS + ", nav AS (SELECT entity, year, CASE WHEN (entity + year) % 6 <> 0 THEN y END AS v, entity % 7 = 0 AND year >= 1999 AS dead FROM lv)"


@query("ladder_compounding", f"WITH {NAV}, l AS (SELECT *, year = min(year) OVER (PARTITION BY entity) AS first, coalesce(min(CASE WHEN dead THEN year END) OVER (PARTITION BY entity), 9999) AS stop, v / lag(v) OVER (PARTITION BY entity ORDER BY year) AS r FROM nav), g AS (SELECT *, min(CASE WHEN NOT first AND year < stop AND r IS NULL THEN year END) OVER (PARTITION BY entity) AS gap FROM l) SELECT entity, round(exp(coalesce(sum(ln(r)) FILTER (NOT first AND year < stop AND year < coalesce(gap, 9999)), 0)), 6) + 0.0 AS multiple, CASE WHEN any_value(gap) IS NOT NULL THEN 'incomplete' WHEN any_value(stop) < 9999 THEN 'liquidated' ELSE 'running' END AS state FROM g GROUP BY entity")
def ladder_compounding(spark, d):
    """A ladder of year-end values compounded to its liquidation, then held as cash; it stops at the first year without a value."""
    year, w = F.col("year"), Window.partitionBy("entity")
    nav = levels(spark, d).select("entity", "year", F.when((F.col("entity") + year) % 6 != 0, F.col("y")).alias("v"), ((F.col("entity") % 7 == 0) & (year >= 1999)).alias("dead"))
    r = F.try_divide(F.col("v"), F.lag("v").over(w.orderBy("year")))
    ladder = nav.withColumns({"first": year == F.min("year").over(w), "stop": F.coalesce(F.min(F.when(F.col("dead"), year)).over(w), F.lit(9999)), "r": r})
    live = ~F.col("first") & (year < F.col("stop"))
    ladder = ladder.withColumn("gap", F.min(F.when(live & F.col("r").isNull(), year)).over(w))
    held = F.sum(F.when(live & (year < F.coalesce("gap", F.lit(9999))), F.log("r")))
    state = F.when(F.first("gap").isNotNull(), "incomplete").when(F.first("stop") < 9999, "liquidated").otherwise("running")
    return ladder.groupBy("entity").agg(r6(F.exp(F.coalesce(held, F.lit(0.0)))).alias("multiple"), state.alias("state"))


@query("best_standing", f"WITH {NAV}, s AS (SELECT entity % 5 AS region, entity, CASE WHEN bool_or(dead) THEN 2 WHEN count(*) FILTER (v IS NULL) > 1 THEN 1 ELSE 0 END AS rank FROM nav GROUP BY ALL) SELECT region, arg_min(entity, (rank, entity)) AS entity, CASE min(rank) WHEN 0 THEN 'running' WHEN 1 THEN 'patchy' ELSE 'liquidated' END AS status FROM s GROUP BY region")
def best_standing(spark, d):
    """The status of a region is that of its member in the best standing."""
    year = F.col("year")
    nav = levels(spark, d).select("entity", F.when((F.col("entity") + year) % 6 != 0, F.col("y")).alias("v"), ((F.col("entity") % 7 == 0) & (year >= 1999)).alias("dead"))
    s = nav.groupBy("entity").agg(F.when(F.max("dead"), 2).when(F.count(F.when(F.col("v").isNull(), 1)) > 1, 1).otherwise(0).alias("rank"))
    best = s.groupBy((F.col("entity") % 5).alias("region")).agg(F.min(F.struct("rank", "entity")).alias("m"))
    return best.select("region", F.col("m.entity").alias("entity"), F.when(F.col("m.rank") == 0, "running").when(F.col("m.rank") == 1, "patchy").otherwise("liquidated").alias("status"))


@query("corrections_win", "SELECT n_nationkey, coalesce(c.name, n_name) AS name, c.name IS NOT NULL AS corrected FROM nation LEFT JOIN (VALUES (3, 'Third'), (99, 'Nowhere')) c(k, name) ON c.k = n_nationkey")
def corrections_win(spark, d):
    fixes = spark.createDataFrame([(3, "Third"), (99, "Nowhere")], "k int, name string")
    met = table(spark, d, "nation").join(fixes, F.col("n_nationkey") == F.col("k"), "left")
    return met.select("n_nationkey", F.coalesce("name", "n_name").alias("name"), F.col("name").isNotNull().alias("corrected"))


@query("meta_upsert", "SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v FROM (SELECT 'rows_' || n_regionkey AS k, count(*) AS v FROM nation GROUP BY 1) a FULL JOIN (VALUES ('rows_1', 100), ('built', 1)) b(k, v) ON a.k = b.k")
def meta_upsert(spark, d):
    """Facts about a build by key; new values take the place of old ones."""
    old = table(spark, d, "nation").groupBy(F.concat(F.lit("rows_"), F.col("n_regionkey").cast("string")).alias("k")).agg(F.count(F.lit(1)).alias("v"))
    new = spark.createDataFrame([("rows_1", 100), ("built", 1)], "k string, w long")
    return old.join(new, "k", "full_outer").select("k", F.coalesce("w", "v").alias("v"))


@query("year_window", on_profiles("SELECT DISTINCT year, greatest(1996, lo)::INT AS first, CASE WHEN year <= 1999 THEN least(1999, hi) ELSE hi END::INT AS last FROM k, (SELECT min(year) AS lo, max(year) AS hi FROM k)"))
def year_window(spark, d):
    """The years that a query of a year may look at: to the last observed one, or to the end for a query after it."""
    years = C.cells(spark, d).select("year").distinct()
    hi, lo = years.agg(F.max("year")).scalar(), years.agg(F.min("year")).scalar()
    return years.select("year", F.greatest(F.lit(1996), lo).cast("int").alias("first"), F.when(F.col("year") <= 1999, F.least(F.lit(1999), hi)).otherwise(hi).cast("int").alias("last"))


@query("parameter_whitelist", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'view' END AS mode, least(greatest(coalesce(try_cast(props->>'$.k' AS BIGINT), 5), 1), 50) AS k FROM events")
def parameter_whitelist(spark, d):
    """Parameters as they may be used: unknown words fall back, numbers are kept inside their range."""
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(5))
    return table(spark, d, "events").select("event_id", F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).otherwise("view").alias("mode"), F.least(F.greatest(k, F.lit(1)), F.lit(50)).cast("long").alias("k"))


@query("markdown_table", "SELECT n_nationkey, trim(n_name) AS name, n_regionkey::VARCHAR AS region FROM nation")
def markdown_table(spark, d):
    """Cells of the rows of a table in Markdown."""
    line = F.concat(F.lit("| "), F.col("n_nationkey").cast("string"), F.lit(" | "), "n_name", F.lit(" |"), F.col("n_regionkey").cast("string"), F.lit(" |"))
    return table(spark, d, "nation").select(line.alias("line")).select(F.transform(F.split("line", r"\|"), lambda x: F.trim(x)).alias("cells")).select(F.get("cells", F.lit(1)).cast("int").alias("n_nationkey"), F.get("cells", F.lit(2)).alias("name"), F.get("cells", F.lit(3)).alias("region"))


CHOICES = f"{over_pairs(L2)}, {over_pairs(W1).replace('dist AS', 'dw AS')}, {over_pairs(BLEND).replace('dist AS', 'db AS')}, n1 AS (SELECT entity, year, arg_min(b_entity, (round(d, 9), b_entity)) AS a FROM dist GROUP BY ALL), n2 AS (SELECT entity, year, arg_min(b_entity, (round(d, 9), b_entity)) AS b FROM dw GROUP BY ALL)"


@query("metric_prefers", on_profiles("SELECT entity, year, a, b, CASE WHEN round(x.d, 9) = round(y.d, 9) THEN NULL WHEN x.d < y.d THEN 'first' ELSE 'second' END AS prefers FROM n1 JOIN n2 USING (entity, year) JOIN db x ON x.entity = n1.entity AND x.year = n1.year AND x.b_entity = a JOIN db y ON y.entity = n1.entity AND y.year = n1.year AND y.b_entity = b".replace("SELECT entity, year, a,", "SELECT n1.entity, n1.year, a,"), CHOICES))
def metric_prefers(spark, d):
    """Of a profile's nearest by one metric and its nearest by another, the one that a third metric prefers; neither where they are equally near, as one profile always is."""
    found = same_year_pairs(spark, d)
    near = lambda m: F.min_by("b_entity", F.struct(m, "b_entity"))
    two = found.groupBy("entity", "year").agg(near("l2").alias("a"), near("w1sex").alias("b"), F.collect_list(F.struct("b_entity", "blend")).alias("all"))  # a year's profiles
    at = lambda c: F.get(F.filter("all", lambda x: x["b_entity"] == F.col(c)), F.lit(0))["blend"]
    both = two.select("entity", "year", "a", "b", at("a").alias("x"), at("b").alias("y"))
    return both.select("entity", "year", "a", "b", F.when(F.col("x") < F.col("y"), "first").when(F.col("x") > F.col("y"), "second").alias("prefers"))


def same_year_pairs(spark, d):
    """entity, year, b_entity and the distances l2, w1sex and blend, to nine places."""
    met = C.pairs(C.profiles(spark, d), C.profiles(spark, d), (F.col("b_year") == F.col("year")) & (F.col("b_entity") != F.col("entity")), S.FIELDS)
    return met.select("entity", "year", "b_entity", *[F.round(M.distance(m), 9).alias(m) for m in ("l2", "w1sex", "blend")])


@query("bytes_by_family", "SELECT lang, count(*) AS n, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents GROUP BY lang")
def bytes_by_family(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


@query("combined_hashes", "SELECT source, sha256(string_agg(h, '' ORDER BY h)) AS sha256 FROM (SELECT source, sha256(text) AS h FROM documents WHERE text IS NOT NULL) GROUP BY source")
def combined_hashes(spark, d):
    """One hash of each source's files, whatever their order."""
    from ..sources import files as Src

    h = table(spark, d, "documents").where("text IS NOT NULL").select("source", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return Src.combined_hash(h, "source")
