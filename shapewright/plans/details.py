"""Queries of labels, formats, units, axes, pairs of profiles and samples of pairs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import bands as B
from ..operators import corpus as C
from ..operators import features as Fe
from ..operators import metrics as M
from ..operators import search as S
from ..operators import stats as St
from ..session import table
from ..sources import files as Src
from .profile import BLEND, FEATURES, GRID_SQL, L2, W1, over_pairs
from .registry import on_profiles, query, r6
from .relational import BARS, bars
from .series import LEVELS, UNI, levels

# labels and formats --------------------------------------------------------------------------------------------------

FOLD = "lower(translate({}, '" + X.ACCENTED + "', '" + X.PLAIN + "'))"


@query("label_normaliser", f"SELECT doc_id, trim(regexp_replace({FOLD.format('text')}, '[^a-z0-9]+', ' ', 'g')) AS label FROM documents")
def label_normaliser(spark, d):
    """Plain lower-case letters and digits, anything else one blank."""
    return table(spark, d, "documents").select("doc_id", F.trim(F.regexp_replace(X.folded(F.col("text")), "[^a-z0-9]+", " ")).alias("label"))


@query("file_names", "SELECT n_nationkey, substr(regexp_replace(lower(concat_ws('-', n_name, r_name, 'profile', repeat('long ', n_nationkey::INT))), '[^a-z0-9]+', '-', 'g'), 1, 120) || '.csv' AS name FROM nation JOIN region ON n_regionkey = r_regionkey")
def file_names(spark, d):
    """Names of exported files: slugs of their parts, 120 characters at most before the ending."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    whole = F.concat_ws("-", "n_name", "r_name", F.lit("profile"), F.repeat(F.lit("long "), F.col("n_nationkey")))
    return n.select("n_nationkey", F.concat(F.substring(F.regexp_replace(F.lower(whole), "[^a-z0-9]+", "-"), 1, 120), F.lit(".csv")).alias("name"))


@query("compact_numbers", "SELECT o_orderkey, CASE WHEN v >= 1000000 THEN (v // 1000000)::BIGINT || 'M' WHEN v >= 1000 THEN (v // 1000)::BIGINT || 'k' ELSE v::VARCHAR END AS persons, CASE WHEN p > 0 THEN '+' ELSE '' END || p || '%' AS change FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS v, (floor(o_totalprice)::BIGINT % 41 - 20) AS p FROM orders)")
def compact_numbers(spark, d):
    v = F.floor("o_totalprice").cast("long")
    p = v % 41 - 20
    short = F.when(v >= 1_000_000, F.concat(F.floor(v / 1_000_000).cast("string"), F.lit("M"))).when(v >= 1000, F.concat(F.floor(v / 1000).cast("string"), F.lit("k"))).otherwise(v.cast("string"))
    return table(spark, d, "orders").select("o_orderkey", short.alias("persons"), F.concat(F.when(p > 0, "+").otherwise(""), p.cast("string"), F.lit("%")).alias("change"))


@query("note_list", "SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(concat(p_name, ' ; ', p_brand, ';; ', p_type), ';'), lambda x: trim(x)), lambda x: x <> ''), '|') AS notes FROM part")
def note_list(spark, d):
    whole = F.concat("p_name", F.lit(" ; "), "p_brand", F.lit(";; "), "p_type")
    return table(spark, d, "part").select("p_partkey", F.array_join(F.filter(F.transform(F.split(whole, ";"), lambda x: F.trim(x)), lambda x: x != ""), "|").alias("notes"))


URLS = r"https?://[^\s\"<>]+"


@query("drop_urls", rf"SELECT page_id, len(regexp_extract_all(html, '{URLS}'))::INT AS n_urls, md5(trim(regexp_replace(regexp_replace(html, '{URLS}', '', 'g'), '\s+', ' ', 'g'))) AS said FROM pages WHERE html IS NOT NULL")
def drop_urls(spark, d):
    """Pages without their urls, runs of blanks one: how many there were, and a digest of the rest."""
    rest = F.trim(F.regexp_replace(F.regexp_replace("html", URLS, ""), r"\s+", " "))
    return table(spark, d, "pages").where("html IS NOT NULL").select("page_id", F.regexp_count("html", F.lit(URLS)).alias("n_urls"), F.md5(rest.cast("binary")).alias("said"))


@query("render_template", "SELECT n_nationkey, regexp_replace('In ' || n_name || '  there are ' || count(c_custkey) || '   customers.', ' +', ' ', 'g') AS said FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name")
def render_template(spark, d):
    """A sentence from a template, runs of blanks one."""
    n = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    said = F.format_string("In %s  there are %d   customers.", "n_name", F.coalesce("n", F.lit(0)))
    return table(spark, d, "nation").join(n, "n_nationkey", "left").select("n_nationkey", F.regexp_replace(said, " +", " ").alias("said"))


@query("parse_period", f"WITH {BARS}, p AS (SELECT k, min(day) || '..' || max(day) AS period FROM bars GROUP BY k) SELECT k, split_part(period, '..', 1) AS first, split_part(period, '..', 2) AS last, round((split_part(period, '..', 2)::DATE - split_part(period, '..', 1)::DATE) / 365.25, 6) AS years FROM p")
def parse_period(spark, d):
    """The dates of a..b and the years between them."""
    p = bars(spark, d).groupBy("k").agg(F.concat_ws("..", F.min("day").cast("string"), F.max("day").cast("string")).alias("period"))
    part = lambda i: F.get(F.split("period", r"\.\."), F.lit(i))
    return p.select("k", part(0).alias("first"), part(1).alias("last"), F.round(F.datediff(part(1).cast("date"), part(0).cast("date")) / 365.25, 6).alias("years"))


@query("era_class", on_profiles("SELECT entity, year, CASE WHEN year <= 1998 THEN 'observed' WHEN year <= 1999 THEN 'nowcast' ELSE 'projected' END AS era FROM k"))
def era_class(spark, d):
    y = F.col("year")
    return C.profiles(spark, d).select("entity", "year", F.when(y <= 1998, "observed").when(y <= 1999, "nowcast").otherwise("projected").alias("era"))


@query("json_rename", "SELECT event_id, '{\"key\":{\"n\":' || (props->>'$.k') || '}}' AS props FROM events")
def json_rename(spark, d):
    """A nested key under a new name."""
    n = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select("event_id", F.to_json(F.struct(F.struct(n.alias("n")).alias("key"))).alias("props"))


@query("fiscal_years", "SELECT n_nationkey, CASE WHEN y < 50 THEN 2000 + y ELSE 1900 + y END::INT AS year FROM (SELECT n_nationkey, (n_nationkey * 4 + 3) % 100 AS y FROM nation)")
def fiscal_years(spark, d):
    header = F.concat(F.lit("FY"), F.lpad(((F.col("n_nationkey") * 4 + 3) % 100).cast("string"), 2, "0"))
    return table(spark, d, "nation").select("n_nationkey", Src.fiscal_year(header).alias("year"))


@query("name_lookup", "WITH o(k) AS (VALUES ('nation 3'), ('NATION_7'), ('the seventh'), ('nowhere')), m(k, e) AS (VALUES ('the seventh', 7)) SELECT o.k, coalesce(m.e, n_nationkey)::INT AS entity, coalesce(m.e, n_nationkey) IS NULL AS unmapped FROM o LEFT JOIN m USING (k) LEFT JOIN nation ON regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g') = regexp_replace(lower(o.k), '[^a-z0-9]+', ' ', 'g')")
def name_lookup(spark, d):
    """Ids of names as they are written elsewhere: overrides first, then the normalised name; what is found nowhere is marked."""
    asked = spark.createDataFrame([("nation 3", None), ("NATION_7", None), ("the seventh", 7), ("nowhere", None)], "k string, e int")
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")
    met = asked.join(table(spark, d, "nation").select(plain("n_name").alias("n"), "n_nationkey"), plain("k") == F.col("n"), "left")
    entity = F.coalesce("e", "n_nationkey")
    return met.select("k", entity.cast("int").alias("entity"), entity.isNull().alias("unmapped"))


# units, axes, entities ------------------------------------------------------------------------------------------------


@query("bar_units", on_profiles("SELECT entity, year, pos, round(100 * s, 6) + 0.0 AS percent, round(s * total, 4) + 0.0 AS persons, round(100 * s / nullif(sum(s) OVER (PARTITION BY entity, year, side), 0), 6) + 0.0 AS percent_of_side FROM p"))
def bar_units(spark, d):
    """A share as a part of all, as a number, and as a part of its own side."""
    side = F.sum("s").over(Window.partitionBy("entity", "year", "side"))
    return C.shares(C.cells(spark, d)).select("entity", "year", "pos", r6(100 * F.col("s")).alias("percent"), (F.round(F.col("s") * F.col("total"), 4) + F.lit(0.0)).alias("persons"), r6(F.try_divide(100 * F.col("s"), side)).alias("percent_of_side"))


@query("side_normalised", on_profiles("SELECT entity, year, pos, round(s / nullif(sum(s) OVER (PARTITION BY entity, year, side), 0), 9) + 0.0 AS s FROM p"))
def side_normalised(spark, d):
    side = F.sum("s").over(Window.partitionBy("entity", "year", "side"))
    return C.shares(C.cells(spark, d)).select("entity", "year", "pos", (F.round(F.try_divide(F.col("s"), side), 9) + F.lit(0.0)).alias("s"))


AXES = (10, 12, 14, 17)
AXIS = " top AS (SELECT entity, max(100 * s) AS top, sum(pop) FILTER (year = 2001) AS last_total FROM prof GROUP BY entity)"
FIT = "CASE WHEN top <= 10 THEN 10 WHEN top <= 12 THEN 12 WHEN top <= 14 THEN 14 ELSE 17 END::INT"


def tops(spark, d):
    """The largest share of each entity in percent, and its total in the last year."""
    return C.shares(C.cells(spark, d)).groupBy("entity").agg(F.max(100 * F.col("s")).alias("top"), F.sum(F.when(F.col("year") == 2001, F.col("pop"))).alias("last_total"))


def fitted(top):
    """The smallest axis that holds a share; the largest where none does."""
    out = F.lit(AXES[-1])
    for a in AXES[-2::-1]:
        out = F.when(top <= a, a).otherwise(out)
    return out.cast("int")


@query("largest_share", on_profiles("SELECT entity, round(top, 6) + 0.0 AS top, round(last_total, 4) + 0.0 AS last_total FROM top", AXIS))
def largest_share(spark, d):
    return tops(spark, d).select("entity", r6("top").alias("top"), (F.round("last_total", 4) + F.lit(0.0)).alias("last_total"))


@query("axis_fit", on_profiles(f"SELECT entity, {FIT} AS axis, top > 17 AS clipped FROM top", AXIS))
def axis_fit(spark, d):
    return tops(spark, d).select("entity", fitted(F.col("top")).alias("axis"), (F.col("top") > AXES[-1]).alias("clipped"))


@query("axis_distribution", on_profiles(f"SELECT {FIT} AS axis, count(*) AS n FROM top GROUP BY ALL", AXIS))
def axis_distribution(spark, d):
    return tops(spark, d).groupBy(fitted(F.col("top")).alias("axis")).agg(F.count(F.lit(1)).alias("n"))


@query("axis_modes", on_profiles(f"SELECT entity, mode, least(CASE mode WHEN 'fit' THEN {FIT} WHEN 'pin10' THEN 10 ELSE 17 END, 17)::INT AS axis, round(least(top / CASE mode WHEN 'fit' THEN {FIT} WHEN 'pin10' THEN 10 ELSE 17 END, 1), 6) + 0.0 AS bar FROM top, (VALUES ('fit'), ('pin10'), ('never')) m(mode)", AXIS))
def axis_modes(spark, d):
    """The axis in each mode, and the length of the largest bar on it, cut at its end."""
    m = tops(spark, d).withColumn("mode", F.explode(F.array(*map(F.lit, ("fit", "pin10", "never")))))
    axis = F.when(F.col("mode") == "fit", fitted(F.col("top"))).when(F.col("mode") == "pin10", 10).otherwise(AXES[-1])
    return m.select("entity", "mode", axis.cast("int").alias("axis"), r6(F.least(F.col("top") / axis, F.lit(1.0))).alias("bar"))


@query("middle_share", on_profiles("SELECT entity, year, round(sum(CASE WHEN bin BETWEEN 2 AND 6 THEN pop ELSE 0 END) / sum(pop), 6) + 0.0 AS share FROM cells GROUP BY ALL"))
def middle_share(spark, d):
    inside = F.sum(F.when(F.col("bin").between(2, 6), F.col("pop")).otherwise(0.0))
    return C.cells(spark, d).groupBy("entity", "year").agg(r6(inside / F.sum("pop")).alias("share"))


@query("open_ladder", on_profiles("SELECT entity, year, side, least(bin, 7)::INT AS bin, sum(pop) AS pop FROM cells GROUP BY ALL"))
def open_ladder(spark, d):
    """Longer ladders of bins summed in an open last one."""
    return Src.ladder_bins(C.cells(spark, d).select("entity", "year", "side", "bin", "pop"), ["entity", "year", "side"], "bin", 7)


@query("entity_series", on_profiles("SELECT entity, year, round(low, 6) + 0.0 AS low, round(mid, 6) + 0.0 AS mid, round(high, 6) + 0.0 AS high, round(median_value, 6) + 0.0 AS median_value FROM fe", FEATURES))
def entity_series(spark, d):
    return Fe.features(C.profiles(spark, d)).select("entity", "year", *[r6(c).alias(c) for c in ("low", "mid", "high", "median_value")])


@query("offset_years", on_profiles("SELECT entity, year, least(greatest(year + 2, lo), hi)::INT AS a, least(greatest(year + 2, lo), hi)::INT - 1 AS b FROM k, (SELECT min(year) + 1 AS lo, max(year) AS hi FROM k)"))
def offset_years(spark, d):
    """A pair of years one apart, both moved by two and kept inside the years there are."""
    k = C.profiles(spark, d).select("entity", "year")
    a = F.least(F.greatest(F.col("year") + 2, k.agg(F.min("year") + 1).scalar()), k.agg(F.max("year")).scalar()).cast("int")
    return k.select("entity", "year", a.alias("a"), (a - 1).alias("b"))


@query("row_lookup", on_profiles("SELECT a.entity, a.year, k.entity IS NOT NULL AS found FROM (VALUES (3, 1997), (3, 1900), (99, 1997)) a(entity, year) LEFT JOIN k USING (entity, year)"))
def row_lookup(spark, d):
    """Whether asked rows are there."""
    asked = spark.createDataFrame([(3, 1997), (3, 1900), (99, 1997)], "entity int, year int")
    return asked.join(C.profiles(spark, d).select("entity", "year", F.lit(True).alias("is")), ["entity", "year"], "left").select("entity", "year", F.col("is").isNotNull().alias("found"))


@query("feature_cross_section", on_profiles("SELECT year, feature, count(v) AS n, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) + 0.0 AS sd FROM (UNPIVOT (SELECT year, low, mid, high, mean_value FROM fe) ON low, mid, high, mean_value INTO NAME feature VALUE v) GROUP BY ALL", FEATURES))
def feature_cross_section(spark, d):
    f = Fe.features(C.profiles(spark, d)).select("year", "low", "mid", "high", "mean_value").unpivot(["year"], ["low", "mid", "high", "mean_value"], "feature", "v")
    return f.groupBy("year", "feature").agg(F.count("v").alias("n"), r6(F.avg("v")).alias("mean"), r6(F.stddev_pop("v")).alias("sd"))


CORR = ("low", "mid", "high", "mean_value", "median_value")


@query("correlation_matrix", on_profiles(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS r FROM fe" for i, a in enumerate(CORR) for b in CORR[i + 1 :]), FEATURES))
def correlation_matrix(spark, d):
    """All pairs of features by one pass."""
    pairs = [(a, b) for i, a in enumerate(CORR) for b in CORR[i + 1 :]]
    row = Fe.features(C.profiles(spark, d)).agg(*[F.corr(a, b).alias(f"{a}_{b}") for a, b in pairs])
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r6(f"{a}_{b}").alias("r")) for a, b in pairs])))


# pairs ----------------------------------------------------------------------------------------------------------------


def same_year_pairs(spark, d, fields=S.FIELDS):
    p = C.profiles(spark, d)
    return C.pairs(p, p, (F.col("b_year") == F.col("year")) & (F.col("b_entity") != F.col("entity")), fields)


PARTS = over_pairs(f"0.5 * {L2} / {M.SIGMA['l2']} AS l2_part, {W1}")


@query("blend_parts", on_profiles(f"SELECT entity, year, b_entity, round(l2_part, 6) + 0.0 AS l2_part, round(0.5 * d / {M.SIGMA['w1sex']}, 6) + 0.0 AS w1_part, round(d, 6) + 0.0 AS w1_years FROM dist", PARTS))
def blend_parts(spark, d):
    """The two terms of the blended distance, and the second in units of the bins."""
    return same_year_pairs(spark, d).select("entity", "year", "b_entity", r6(0.5 * M.l2() / M.SIGMA["l2"]).alias("l2_part"), r6(0.5 * M.w1sex() / M.SIGMA["w1sex"]).alias("w1_part"), r6(M.w1sex()).alias("w1_years"))


@query("transport_top_bins", on_profiles("SELECT entity, year, b_entity, pos, rank::INT AS rank, part + 0.0 AS part FROM (SELECT *, row_number() OVER (PARTITION BY entity, year, b_entity ORDER BY part DESC, pos) AS rank FROM (SELECT a.entity, a.year, b.entity AS b_entity, a.pos, round(5 * abs(a.c - b.c), 8) AS part FROM p a JOIN p b ON a.pos = b.pos AND a.year = b.year AND a.entity <> b.entity)) WHERE rank <= 3"))
def transport_top_bins(spark, d):
    """The three bins over which most is carried."""
    gaps = F.zip_with("c", "b_c", lambda x, y: F.round(5 * F.abs(x - y), 8))
    best = F.slice(F.array_sort(F.transform(gaps, lambda g, i: F.struct((-g).alias("neg"), i.alias("pos")))), 1, 3)
    met = same_year_pairs(spark, d).select("entity", "year", "b_entity", F.posexplode(best).alias("i", "x"))
    return met.select("entity", "year", "b_entity", F.col("x.pos").cast("int").alias("pos"), (F.col("i") + 1).alias("rank"), (-F.col("x.neg") + F.lit(0.0)).alias("part"))


@query("pair_components", on_profiles("SELECT a.entity, a.year, a.b_entity, round(a.l2, 6) + 0.0 AS l2, round(a.w1sex, 6) + 0.0 AS w1sex, round(b.w1, 6) + 0.0 AS w1, round(0.3 * a.l2 / 0.05 + 0.7 * a.w1sex, 6) + 0.0 AS reweighted FROM x a JOIN y b USING (entity, year, b_entity)", f" x AS (SELECT a.entity, a.year, b.entity AS b_entity, {L2} AS l2, {W1} AS w1sex FROM p a JOIN p b ON a.pos = b.pos AND a.year = b.year AND a.entity <> b.entity GROUP BY ALL), y AS (SELECT a.entity, a.year, b.entity AS b_entity, {W1} AS w1 FROM t a JOIN t b ON a.bin = b.bin AND a.year = b.year AND a.entity <> b.entity GROUP BY ALL)"))
def pair_components(spark, d):
    """Components of each pair's distance and a blend of other weights."""
    return same_year_pairs(spark, d).select("entity", "year", "b_entity", r6(M.l2()).alias("l2"), r6(M.w1sex()).alias("w1sex"), r6(M.w1()).alias("w1"), r6(0.3 * M.l2() / M.SIGMA["l2"] + 0.7 * M.w1sex()).alias("reweighted"))


@query("combined_scan", on_profiles("SELECT entity, year, arg_min(b_entity, (round(d, 9), b_entity)) AS nearest, round(min(d), 6) + 0.0 AS near, arg_min(b_entity, (-round(d, 9), b_entity)) AS farthest, round(max(d), 6) + 0.0 AS far, arg_min(b_entity, (round(d, 9), b_entity)) FILTER (b_entity % 2 = entity % 2) AS strict, count(*) AS n FROM dist GROUP BY entity, year", over_pairs(BLEND)))
def combined_scan(spark, d):
    """Twin, opposite and the twin under a stricter rule, all from one scan."""
    dd = same_year_pairs(spark, d).select("entity", "year", "b_entity", M.blend().alias("d")).withColumn("r", F.round("d", 9))
    own = F.when(F.col("b_entity") % 2 == F.col("entity") % 2, F.struct("r", "b_entity"))
    return dd.groupBy("entity", "year").agg(F.min_by("b_entity", F.struct("r", "b_entity")).alias("nearest"), r6(F.min("d")).alias("near"), F.min_by("b_entity", F.struct(-F.col("r"), "b_entity")).alias("farthest"), r6(F.max("d")).alias("far"), F.min(own)["b_entity"].alias("strict"), F.count(F.lit(1)).alias("n"))


@query("extreme_candidates", on_profiles("SELECT year, arg_min(entity * 1000 + b_entity, (round(d, 9), entity * 1000 + b_entity)) AS nearest, arg_min(entity * 1000 + b_entity, (-round(d, 9), entity * 1000 + b_entity)) AS farthest FROM dist GROUP BY year", over_pairs(BLEND)))
def extreme_candidates(spark, d):
    """The nearest and the farthest pair of each year, ties to the lowest row."""
    dd = same_year_pairs(spark, d).select("year", (F.col("entity") * 1000 + F.col("b_entity")).alias("row"), F.round(M.blend(), 9).alias("d"))
    return dd.groupBy("year").agg(F.min_by("row", F.struct("d", "row")).alias("nearest"), F.min_by("row", F.struct(-F.col("d"), "row")).alias("farthest"))


@query("distance_quantiles", on_profiles("SELECT year, round(quantile_cont(d, 0.01), 6) + 0.0 AS p1, round(quantile_cont(d, 0.5), 6) + 0.0 AS p50, round(quantile_cont(d, 0.99), 6) + 0.0 AS p99, round(avg((d < 1)::INT), 6) AS below FROM dist GROUP BY year", over_pairs(BLEND)))
def distance_quantiles(spark, d):
    q = lambda p: r6(F.percentile("d", p))
    return same_year_pairs(spark, d).select("year", M.blend().alias("d")).groupBy("year").agg(q(0.01).alias("p1"), q(0.5).alias("p50"), q(0.99).alias("p99"), F.round(F.avg((F.col("d") < 1).cast("int")), 6).alias("below"))


@query("w1_share_by_era", on_profiles(f"SELECT year <= 1998 AS observed, round(median(d / (l2_part * {2 * M.SIGMA['w1sex']} + d)), 6) + 0.0 AS share FROM dist GROUP BY ALL", PARTS))
def w1_share_by_era(spark, d):
    """The median part that the transport term has in the blended distance, for observed and later years."""
    w = 0.5 * M.w1sex() / M.SIGMA["w1sex"]
    return same_year_pairs(spark, d).select((F.col("year") <= 1998).alias("observed"), (w / M.blend()).alias("x")).groupBy("observed").agg(r6(F.percentile("x", 0.5)).alias("share"))


@query("trend_reason", on_profiles("SELECT a.entity, a.year, b.entity AS b_entity, round(a.low - ao.low, 6) + 0.0 AS own, round(b.low - bo.low, 6) + 0.0 AS other FROM fe a JOIN fe ao ON ao.entity = a.entity AND ao.year = a.year - 2 JOIN fe b ON b.year = a.year AND b.entity <> a.entity JOIN fe bo ON bo.entity = b.entity AND bo.year = b.year - 2", FEATURES))
def trend_reason(spark, d):
    """How a feature moved over two years, in both members of a pair."""
    f = Fe.features(C.profiles(spark, d)).select("entity", "year", "low")
    old = f.select("entity", (F.col("year") + 2).cast("int").alias("year"), F.col("low").alias("was"))
    moved = f.join(old, ["entity", "year"]).select("entity", "year", (F.col("low") - F.col("was")).alias("x"))
    other = moved.select(F.col("entity").alias("b_entity"), "year", F.col("x").alias("y"))
    return moved.join(other, "year").where("entity <> b_entity").select("entity", "year", "b_entity", r6("x").alias("own"), r6("y").alias("other"))


@query("snapshot_reason", on_profiles("SELECT a.entity, a.year, b.entity AS b_entity, 'Most of both lies around ' || a.modal_bin::INT || ' and ' || b.modal_bin::INT || CASE WHEN a.modal_bin = b.modal_bin THEN ', in the same bin.' ELSE '.' END AS said FROM fe a JOIN fe b ON a.year = b.year AND a.entity <> b.entity", FEATURES))
def snapshot_reason(spark, d):
    f = Fe.features(C.profiles(spark, d)).select("entity", "year", "modal_bin")
    other = f.select(F.col("entity").alias("b_entity"), "year", F.col("modal_bin").alias("b"))
    said = F.concat(F.lit("Most of both lies around "), F.col("modal_bin").cast("int").cast("string"), F.lit(" and "), F.col("b").cast("int").cast("string"), F.when(F.col("modal_bin") == F.col("b"), ", in the same bin.").otherwise("."))
    return f.join(other, "year").where("entity <> b_entity").select("entity", "year", "b_entity", said.alias("said"))


@query("best_year_of_pair", on_profiles("SELECT entity, b_entity, arg_min(year, (round(d, 9), year, b_year)) AS year, arg_min(b_year, (round(d, 9), year, b_year)) AS b_year, round(round(min(d), 9), 6) + 0.0 AS d FROM dist GROUP BY entity, b_entity", over_pairs(BLEND, where="a.entity <> b.entity")))
def best_year_of_pair(spark, d):
    """The two years in which two entities are most alike."""
    best = S.scanned(C.profiles(spark, d), S.Query("any")).groupBy("entity", "b_entity").agg(F.min(F.struct("d", "year", "b_year")).alias("m"))
    return best.select("entity", "b_entity", F.col("m.year").alias("year"), F.col("m.b_year").alias("b_year"), r6("m.d").alias("d"))


SAMPLED = 12
PICKS = f"kk AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY {UNI.format("concat_ws(':', 21, entity, year)")}, entity) AS r FROM k), picked AS (SELECT entity, year FROM kk WHERE r <= {SAMPLED})"


def sampled_profiles(spark, d):
    """SAMPLED profiles of each year by a seeded hash: the queries of the sampled tables."""
    p = C.profiles(spark, d)
    w = Window.partitionBy("year").orderBy(St.uniform_of(F.lit(21), F.col("entity"), F.col("year")), "entity")
    return p.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= SAMPLED).drop("_r")


@query("pair_sample", on_profiles("SELECT a.entity, a.year, b.entity AS b_entity FROM picked a JOIN picked b ON a.year = b.year AND a.entity <> b.entity", " " + PICKS))
def pair_sample(spark, d):
    """Pairs of the sampled profiles of a year."""
    p = sampled_profiles(spark, d).select("entity", "year")
    return p.join(p.select(F.col("entity").alias("b_entity"), "year"), "year").where("entity <> b_entity").select("entity", "year", "b_entity")


CROSS = f" {PICKS}, cd AS (SELECT CASE WHEN b.year <= 1999 THEN 'obs' ELSE 'all' END AS era, (a.year // 10 * 10)::INT AS decade, a.entity, a.year, b.entity AS b_entity, b.year AS b_year, {BLEND} AS d FROM p a JOIN picked i ON i.entity = a.entity AND i.year = a.year JOIN p b ON a.pos = b.pos AND a.entity <> b.entity AND a.year <> b.year JOIN picked j ON j.entity = b.entity AND j.year = b.year GROUP BY ALL), cq AS (SELECT era, decade, quantile_cont(d, {GRID_SQL}) AS q FROM cd GROUP BY ALL)"


@query("bands_cross_grid", on_profiles(f"SELECT era, decade, (i - 1)::INT AS i, round(q[i], 6) + 0.0 AS v FROM cq, range(1, {len(B.GRID) + 1}) r(i)", CROSS))
def bands_cross_grid(spark, d):
    """Bands of distances between different years, by the era of the candidate and the decade of the query, over the sampled profiles."""
    p = sampled_profiles(spark, d)
    met = C.pairs(p, p, (F.col("entity") != F.col("b_entity")) & (F.col("year") != F.col("b_year")), S.FIELDS)
    cells = met.select(F.when(F.col("b_year") <= 1999, "obs").otherwise("all").alias("era"), (F.floor(F.col("year") / 10) * 10).cast("int").alias("decade"), M.blend().alias("d"))
    return cells.groupBy("era", "decade").agg(F.percentile("d", F.array(*[F.lit(p / 100) for p in B.GRID])).alias("q")).select("era", "decade", F.posexplode("q").alias("i", "v")).select("era", "decade", "i", r6("v").alias("v"))


@query("class_family", on_profiles("SELECT entity, year, CASE WHEN low > high THEN 'low' WHEN high > low THEN 'high' ELSE 'even' END AS family FROM fe", FEATURES))
def class_family(spark, d):
    low, high = F.round("low", 12), F.round("high", 12)
    return Fe.features(C.profiles(spark, d)).select("entity", "year", F.when(low > high, "low").when(high > low, "high").otherwise("even").alias("family"))


@query("continuity_by_era", on_profiles("SELECT year <= 1998 AS observed, count(*) AS n, round(avg(d), 6) + 0.0 AS mean FROM (SELECT a.entity, a.year, " + BLEND + " AS d FROM p a JOIN p b ON a.entity = b.entity AND b.year = a.year + 1 AND a.pos = b.pos GROUP BY ALL) GROUP BY ALL"))
def continuity_by_era(spark, d):
    """Distance to the next year of the same entity, for observed and later years."""
    p = C.profiles(spark, d)
    met = C.pairs(p, p, (F.col("entity") == F.col("b_entity")) & (F.col("b_year") == F.col("year") + 1), S.FIELDS)
    return met.select((F.col("year") <= 1998).alias("observed"), M.blend().alias("d")).groupBy("observed").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("d")).alias("mean"))


@query("topk_overlap", on_profiles("SELECT a.entity, a.year, count(*) AS shared FROM ra a JOIN rb b USING (entity, year, b_entity) WHERE a.r <= 5 AND b.r <= 5 GROUP BY ALL", over_pairs(L2).replace("dist AS", "da AS") + "," + over_pairs(W1).replace("dist AS", "db AS") + ", ra AS (SELECT *, row_number() OVER (PARTITION BY entity, year ORDER BY round(d, 9), b_entity) AS r FROM da), rb AS (SELECT *, row_number() OVER (PARTITION BY entity, year ORDER BY round(d, 9), b_entity) AS r FROM db)"))
def topk_overlap(spark, d):
    """How many of the five nearest two distances have in common."""
    dd = same_year_pairs(spark, d).select("entity", "year", "b_entity", F.round(M.l2(), 9).alias("a"), F.round(M.w1sex(), 9).alias("b"))
    rank = lambda c: F.row_number().over(Window.partitionBy("entity", "year").orderBy(c, "b_entity"))
    both = dd.withColumn("ra", rank("a")).withColumn("rb", rank("b")).where("ra <= 5 AND rb <= 5")
    return both.groupBy("entity", "year").agg(F.count(F.lit(1)).alias("shared"))


@query("existed_at", f"WITH {LEVELS}, f AS (SELECT entity, min(year) AS first FROM lv GROUP BY entity) SELECT entity, y::INT AS year, first <= y AS existed FROM f, (VALUES (1994), (1995), (1999)) t(y)")
def existed_at(spark, d):
    f = levels(spark, d).groupBy("entity").agg(F.min("year").alias("first"))
    return f.select("entity", "first", F.explode(F.array(*map(F.lit, (1994, 1995, 1999)))).alias("year")).select("entity", "year", (F.col("first") <= F.col("year")).alias("existed"))
