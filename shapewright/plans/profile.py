"""Queries of the profile corpus: vectors, features, distances, search, bands."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vec
from ..operators import bands as B
from ..operators import corpus as C
from ..operators import features as X
from ..operators import metrics as M
from ..operators import search as S
from ..operators import stats as St
from ..session import table
from .registry import on_profiles, query, r6

ids = ("entity", "year")


@query("profile_long", on_profiles("SELECT entity, year, bin, side, pop::DOUBLE AS pop FROM base"))
def profile_long(spark, d):
    return C.long_counts(spark, d).select("entity", "year", "bin", "side", F.col("pop").cast("double").alias("pop"))


@query("profile_dense_spine", on_profiles("SELECT entity, year, bin, side, pos, pop FROM cells"))
def profile_dense_spine(spark, d):
    return C.cells(spark, d)


@query("profile_shares", on_profiles("SELECT entity, year, pos, total, round(s, 6) + 0.0 AS share FROM prof"))
def profile_shares(spark, d):
    return C.shares(C.cells(spark, d)).select("entity", "year", "pos", "total", r6("s").alias("share"))


@query("profile_vectors", on_profiles("SELECT entity, year, total, round(sum(s * (pos + 1)), 6) + 0.0 AS weighted, count(*) AS n FROM prof GROUP BY ALL"))
def profile_vectors(spark, d):
    p = C.profiles(spark, d)
    return p.select("entity", "year", "total", r6(vec.total(F.transform("s", lambda x, i: x * (i + 1)))).alias("weighted"), F.size("s").cast("long").alias("n"))


@query("profile_cdf", on_profiles("SELECT entity, year, pos, round(c, 6) + 0.0 AS c FROM p"))
def profile_cdf(spark, d):
    return C.profiles(spark, d).select("entity", "year", F.posexplode("c").alias("pos", "c")).select("entity", "year", "pos", r6("c").alias("c"))


@query("corpus_row_index", on_profiles("SELECT entity, year, (row_number() OVER (ORDER BY entity, year) - 1)::INT AS row FROM k"))
def corpus_row_index(spark, d):
    """Place in the corpus, from the years counted before each entity: no window over the whole table, no pairs of entities."""
    p = C.cells(spark, d).select(*ids).distinct()
    before = St.totals_before(p.groupBy("entity").agg(F.count(F.lit(1)).alias("n")), "entity", F.col("n")).select("entity", "before")
    inner = F.row_number().over(Window.partitionBy("entity").orderBy("year")) - 1
    return p.join(before, "entity").select("entity", "year", (F.col("before") + inner).cast("int").alias("row"))


MEMBERS = " m AS (SELECT n_regionkey AS agg, year, pos, sum(pop) AS pop FROM cells JOIN nation ON entity = n_nationkey GROUP BY ALL)"


def membership(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("member"), F.col("n_regionkey").alias("aggregate"))


@query("aggregate_members_sum", on_profiles("SELECT agg AS aggregate, year, pos, pop FROM m", MEMBERS))
def aggregate_members_sum(spark, d):
    out = C.members_sum(C.cells(spark, d), membership(spark, d))
    return out.select("aggregate", "year", (F.col("bin") + F.when(F.col("side") == "F", 10).otherwise(0)).alias("pos"), "pop")


@query("member_sum_check", on_profiles("SELECT year, round(max(abs(a.pop - b.pop) / (0.001 * 25)), 6) + 0.0 AS worst FROM (SELECT year, pos, sum(pop) AS pop FROM m GROUP BY ALL) a JOIN (SELECT year, pos, sum(pop) AS pop FROM cells GROUP BY ALL) b USING (year, pos) GROUP BY year", MEMBERS))
def member_sum_check(spark, d):
    """Largest gap between the sum of regions and that of all nations, in tolerances; a corpus passes below 1."""
    cells = C.cells(spark, d)
    parts = C.members_sum(cells, membership(spark, d)).groupBy("year", "bin", "side").agg(F.sum("pop").alias("a"))
    whole = cells.groupBy("year", "bin", "side").agg(F.sum("pop").alias("b"))
    return parts.join(whole, ["year", "bin", "side"]).groupBy("year").agg(r6(F.max(F.abs(F.col("a") - F.col("b")) / (0.001 * 25))).alias("worst"))


@query("patch_union", on_profiles("SELECT entity, year, pos, CASE WHEN entity = 3 THEN pop * 1.5 ELSE pop END AS pop, entity = 3 AS touched FROM cells"))
def patch_union(spark, d):
    cells = C.cells(spark, d)
    patch = cells.where("entity = 3").withColumn("pop", F.col("pop") * 1.5)
    return C.patched(cells, patch).select("entity", "year", "pos", "pop", (F.col("entity") == 3).alias("touched"))


@query("patch_identity", on_profiles("SELECT n_regionkey AS aggregate, year, round(sum(pop) * 0.5, 6) + 0.0 AS delta FROM cells JOIN nation ON n_nationkey = entity WHERE entity = 3 GROUP BY ALL"))
def patch_identity(spark, d):
    """What a patch changes in the aggregates that contain its entity; the others do not change and are absent."""
    cells = C.cells(spark, d)
    new = C.patched(cells, cells.where("entity = 3").withColumn("pop", F.col("pop") * 1.5))
    total = lambda x, n: C.members_sum(x, membership(spark, d)).groupBy("aggregate", "year").agg(F.sum("pop").alias(n))
    return total(new, "a").join(total(cells, "b"), ["aggregate", "year"]).select("aggregate", "year", r6(F.col("a") - F.col("b")).alias("delta")).where("delta <> 0")


QUANT = """ x AS (SELECT entity, year, pos, round(s / sum(s) OVER (PARTITION BY entity, year) * 65535, 6) AS x FROM prof),
q0 AS (SELECT *, floor(x)::INT AS low FROM x), q1 AS (SELECT *, 65535 - sum(low) OVER (PARTITION BY entity, year) AS short, row_number() OVER (PARTITION BY entity, year ORDER BY round(x - low, 6) DESC, pos) AS r FROM q0),
u AS (SELECT entity, year, pos, (low + (r <= short)::INT)::INT AS u FROM q1),
dl AS (SELECT *, ((u - coalesce(lag(u) OVER (PARTITION BY entity, pos ORDER BY year), 0)) & 65535)::INT AS d FROM u)"""


@query("quantise_largest_remainder", on_profiles("SELECT * FROM u", QUANT))
def quantise_largest_remainder(spark, d):
    return C.quantised(C.shares(C.cells(spark, d)))


@query("dequantise", on_profiles("SELECT entity, year, pos, round(u / 65535, 6) + 0.0 AS s FROM u", QUANT))
def dequantise(spark, d):
    return quantise_largest_remainder(spark, d).select("entity", "year", "pos", r6(F.col("u") / 65535).alias("s"))


@query("modular_deltas", on_profiles("SELECT entity, year, pos, d FROM dl", QUANT))
def modular_deltas(spark, d):
    return C.deltas(quantise_largest_remainder(spark, d)).select("entity", "year", "pos", "d")


@query("delta_decode_roundtrip", on_profiles("SELECT entity, year, pos, u, u AS decoded FROM u", QUANT))
def delta_decode_roundtrip(spark, d):
    coded = C.deltas(quantise_largest_remainder(spark, d))
    return C.undeltas(coded.select("entity", "year", "pos", "d")).withColumnRenamed("u", "decoded").drop("d").join(coded.select("entity", "year", "pos", "u"), ["entity", "year", "pos"])


@query("zigzag_layout", on_profiles("SELECT entity, sum(CASE WHEN d >= 32768 THEN 2 * (65536 - d) - 1 ELSE 2 * d END)::BIGINT AS zigzag, sum(d)::BIGINT AS plain FROM dl GROUP BY ALL", QUANT))
def zigzag_layout(spark, d):
    signed = F.when(F.col("d") >= 32768, F.col("d") - 65536).otherwise(F.col("d"))
    zz = F.when(signed < 0, -2 * signed - 1).otherwise(2 * signed)
    return modular_deltas(spark, d).groupBy("entity").agg(F.sum(zz).alias("zigzag"), F.sum("d").alias("plain"))


FEATURES = """ f0 AS (
  SELECT entity, year, any_value(total) AS total, sum(s) FILTER (bin < 2) AS low, sum(s) FILTER (bin BETWEEN 2 AND 6) AS mid, sum(s) FILTER (bin >= 7) AS high, sum(s) FILTER (bin >= 8) AS top,
         max(s) FILTER (bin = 0) AS a0, max(s) FILTER (bin = 2) AS a2, max(s) FILTER (bin = 4) AS a4, 5.0 * arg_max(bin, round(s, 12) - bin * 1e-15) AS modal,
         sum(m) FILTER (bin BETWEEN 3 AND 6) / nullif(sum(f) FILTER (bin BETWEEN 3 AND 6), 0) AS side_ratio, sum(s * (5.0 * bin + 2.5)) AS mean_value, least(count(*) FILTER (round(c, 12) < 0.5), 9) AS kk
  FROM t GROUP BY ALL
), fe AS (
  SELECT entity, year, f0.total, low, mid, high, top, low / nullif(mid, 0) AS low_dep, high / nullif(mid, 0) AS high_dep, (low + high) / nullif(mid, 0) AS total_dep, a0 / nullif(a4, 0) AS base_slope_far,
         a0 / nullif(a2, 0) AS base_slope_near, modal::DOUBLE AS modal_bin, side_ratio, mean_value,
         5.0 * kk + 5.0 * CASE WHEN t.s = 0 THEN 0 ELSE least(greatest((0.5 - (t.c - t.s)) / t.s, 0), 1) END AS median_value
  FROM f0 JOIN t USING (entity, year) WHERE t.bin = kk
)"""
NUM = X.NUMERIC


@query("features_all", on_profiles(f"SELECT entity, year, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in NUM)} FROM fe", FEATURES))
def features_all(spark, d):
    return X.features(C.profiles(spark, d)).select(*ids, *[r6(c).alias(c) for c in NUM])


@query("median_value_interp", on_profiles("SELECT entity, year, round(median_value, 6) + 0.0 AS median_value FROM fe", FEATURES))
def median_value_interp(spark, d):
    return C.profiles(spark, d).select(*ids, r6(X.median_value(F.col("s1"), F.col("c1"))).alias("median_value"))


Z = FEATURES + ", z AS (SELECT entity, year, " + ", ".join(f"({c} - avg({c}) OVER w) / CASE WHEN stddev_pop({c}) OVER w > 1e-12 THEN stddev_pop({c}) OVER w ELSE 1.0 END AS z_{c}, {c}" for c in NUM) + " FROM fe WINDOW w AS (PARTITION BY year))"


@query("feature_zscores", on_profiles(f"SELECT entity, year, {', '.join(f'round(z_{c}, 6) + 0.0 AS z_{c}' for c in NUM)} FROM z", Z))
def feature_zscores(spark, d):
    return X.zscores(X.features(C.profiles(spark, d))).select(*ids, *[r6(f"z_{c}").alias(f"z_{c}") for c in NUM])


@query("modal_bin_argmax", on_profiles("SELECT entity, year, modal_bin FROM fe", FEATURES))
def modal_bin_argmax(spark, d):
    return X.features(C.profiles(spark, d)).select(*ids, "modal_bin")


STAGE = "CASE WHEN median_value < 20 THEN 'expansive' WHEN median_value >= 27 THEN 'constrictive' ELSE 'stationary' END"


@query("stage_class", on_profiles(f"SELECT entity, year, {STAGE} AS stage FROM fe", FEATURES))
def stage_class(spark, d):
    return X.features(C.profiles(spark, d)).select(*ids, X.stage(F.col("median_value")).alias("stage"))


@query("stage_distribution", on_profiles(f"SELECT year, {STAGE} AS stage, count(*) AS n FROM fe GROUP BY ALL", FEATURES))
def stage_distribution(spark, d):
    return stage_class(spark, d).groupBy("year", "stage").agg(F.count(F.lit(1)).alias("n"))


@query("shape_class_rules", on_profiles(
    "SELECT entity, year, string_agg(CASE WHEN g > 0.05 THEN '+' WHEN g < -0.05 THEN '-' ELSE '0' END, '' ORDER BY b) AS steps FROM (SELECT entity, year, b, round((nxt - v) / greatest(v, nxt, 1e-12), 12) AS g FROM "
    "(SELECT *, lead(v) OVER (PARTITION BY entity, year ORDER BY b) AS nxt FROM (SELECT entity, year, bin // 2 AS b, sum(s) / 10 AS v FROM t GROUP BY ALL)) WHERE nxt IS NOT NULL) GROUP BY ALL"))  # fmt: skip
def shape_class_rules(spark, d):
    return C.profiles(spark, d).select(*ids, X.steps(F.col("s1")).alias("steps"))


# distances ---------------------------------------------------------------------------------------------------------

SMOOTHED = " sm AS (SELECT a.entity, a.year, a.pos, sum(b.s * CASE j WHEN 0 THEN .399 WHEN 1 THEN .242 WHEN -1 THEN .242 ELSE .054 END) AS v FROM p a, range(-2, 3) r(j) JOIN p b ON b.entity = a.entity AND b.year = a.year AND b.side = a.side AND b.bin = least(greatest(a.bin + j, 0), 9) GROUP BY ALL)"
CLR = " lg AS (SELECT entity, year, pos, ln(s + 1e-6) AS v FROM p), cl AS (SELECT entity, year, pos, v - avg(v) OVER (PARTITION BY entity, year) AS v FROM lg)"


def over_pairs(value: str, of: str = "p", where: str = "a.year = b.year AND a.entity <> b.entity") -> str:
    key = "bin" if of == "t" else "pos"
    return f" dist AS (SELECT a.entity, a.year, b.entity AS b_entity, b.year AS b_year, {value} AS d FROM {of} a JOIN {of} b ON a.{key} = b.{key} AND {where} GROUP BY ALL)"


L2 = "sqrt(sum((a.s - b.s) * (a.s - b.s)))"
W1 = "5 * sum(abs(a.c - b.c))"
BLEND = f"0.5 * {L2} / {M.SIGMA['l2']} + 0.5 * {W1} / {M.SIGMA['w1sex']}"
PAIR_SQL = {
    "l2": over_pairs(L2),
    "w1": over_pairs(W1, "t"),
    "w1sex": over_pairs(W1),
    "blend": over_pairs(BLEND),
    "l2s": SMOOTHED + "," + over_pairs("sqrt(sum((a.v - b.v) * (a.v - b.v)))", "sm"),
    "hel": over_pairs("sqrt(sum((sqrt(a.s) - sqrt(b.s)) * (sqrt(a.s) - sqrt(b.s)))) / sqrt(2)"),
    "clr": CLR + "," + over_pairs("sqrt(sum((a.v - b.v) * (a.v - b.v)))", "cl"),
    "w1bal": over_pairs(f"{W1} + 50 * sum(0.5 * (a.s + b.s) * abs(CASE WHEN a.s = 0 THEN 0.5 ELSE a.m / a.s END - CASE WHEN b.s = 0 THEN 0.5 ELSE b.m / b.s END))", "t"),
    "cosine": over_pairs("1 - sum(a.s * b.s) / (sqrt(sum(a.s * a.s)) * sqrt(sum(b.s * b.s)) + 1e-12)"),
}
PAIR_OUT = "SELECT entity, year, b_entity, round(d, 6) + 0.0 AS d FROM dist"


def others_of_year():
    return (F.col("year") == F.col("b_year")) & (F.col("entity") != F.col("b_entity"))


def same_year(spark, d, metric):
    p = M.prepared(C.profiles(spark, d))
    fields = [*S.FIELDS, "sm", "sq", "clr"]
    on = (F.col("year") == F.col("b_year")) & (F.col("entity") != F.col("b_entity"))
    return C.pairs(p, p, on, fields).select("entity", "year", "b_entity", M.distance(metric).alias("d"))


for _name, _sql in PAIR_SQL.items():
    query(f"dist_{_name}", on_profiles(PAIR_OUT, _sql))(lambda spark, d, m=_name: same_year(spark, d, m).select("entity", "year", "b_entity", r6("d").alias("d")))


@query("dist_feat", on_profiles(
    f"SELECT a.entity, a.year, b.entity AS b_entity, round(sqrt({' + '.join(f'power(coalesce(a.z_{c}, 0) - coalesce(b.z_{c}, 0), 2)' for c in NUM)}), 5) + 0.0 AS d FROM z a JOIN z b ON a.year = b.year AND a.entity <> b.entity", Z))
def dist_feat(spark, d):
    z = X.zscores(X.features(C.profiles(spark, d))).select(*ids, X.z_vector().alias("z"))
    met = C.pairs(z, z, (F.col("year") == F.col("b_year")) & (F.col("entity") != F.col("b_entity")), ["entity", "year", "z"])
    return met.select("entity", "year", "b_entity", (F.round(vec.l2(F.col("z"), F.col("b_z")), 5) + F.lit(0.0)).alias("d"))


LAG2 = " lg2 AS (SELECT a.entity, a.year, a.pos, a.s - b.s AS v FROM p a JOIN p b ON a.entity = b.entity AND a.pos = b.pos AND b.year = a.year - 2),"


@query("dist_trend", on_profiles(PAIR_OUT, LAG2 + over_pairs(f"sqrt(sum((a.v - b.v) * (a.v - b.v))) / {M.SIGMA['trend']}", "lg2")))
def dist_trend(spark, d):
    """Distance of the changes over two years."""
    p = C.lagged(C.profiles(spark, d), 2).select("entity", "year", vec.minus(F.col("s"), F.col("s_lag")).alias("v"))
    met = C.pairs(p, p, (F.col("year") == F.col("b_year")) & (F.col("entity") != F.col("b_entity")), ["entity", "year", "v"])
    return met.select("entity", "year", "b_entity", r6(vec.l2(F.col("v"), F.col("b_v")) / M.SIGMA["trend"]).alias("d"))


@query("dist_path", on_profiles("SELECT x.entity, x.year, x.b_entity, round(avg(y.d), 6) + 0.0 AS d FROM dist x JOIN dist y ON x.entity = y.entity AND x.b_entity = y.b_entity AND y.year IN (x.year, x.year - 1, x.year - 2) GROUP BY ALL HAVING count(*) = 3", over_pairs(BLEND)))
def dist_path(spark, d):
    """Mean blended distance of this and the two years before, where all are there: a window over each pair's years, no join."""
    w = Window.partitionBy("entity", "b_entity").orderBy("year").rangeBetween(-2, 0)
    out = same_year(spark, d, "blend").withColumn("n", F.count("d").over(w)).withColumn("m", F.avg("d").over(w))
    return out.where("n = 3").select("entity", "year", "b_entity", r6("m").alias("d"))


@query("sigma_all_pairs", on_profiles("SELECT 'l2' AS metric, round(median(d), 6) + 0.0 AS sigma FROM dist UNION ALL SELECT 'w1sex', round(median(d), 6) + 0.0 FROM dist2", over_pairs(L2) + "," + over_pairs(W1).replace("dist AS", "dist2 AS")))
def sigma_all_pairs(spark, d):
    met = C.pairs(C.profiles(spark, d), C.profiles(spark, d), (F.col("year") == F.col("b_year")) & (F.col("entity") != F.col("b_entity")), S.FIELDS)
    both = met.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), M.distance(m).alias("d")) for m in ("l2", "w1sex")])))
    return both.groupBy("metric").agg(r6(F.percentile("d", 0.5)).alias("sigma"))


@query("decompose_top_bins", on_profiles("SELECT entity, year, b_entity, pos, rank::INT AS rank, round(part, 6) + 0.0 AS part FROM (SELECT *, row_number() OVER (PARTITION BY entity, year, b_entity ORDER BY part DESC, pos) AS rank FROM (SELECT a.entity, a.year, b.entity AS b_entity, a.pos, round((a.s - b.s) * (a.s - b.s) / sum((a.s - b.s) * (a.s - b.s)) OVER (PARTITION BY a.entity, a.year, b.entity), 9) AS part FROM p a JOIN p b ON a.pos = b.pos AND a.year = b.year AND a.entity <> b.entity)) WHERE rank <= 3"))
def decompose_top_bins(spark, d):
    p = C.profiles(spark, d)
    met = C.pairs(p, p, others_of_year(), S.FIELDS)
    return met.select("entity", "year", "b_entity", F.posexplode(F.slice(M.decomposition(), 1, 3)).alias("i", "x")).select("entity", "year", "b_entity", F.col("x.pos").cast("int").alias("pos"), (F.col("i") + 1).alias("rank"), r6("x.part").alias("part"))


# search ------------------------------------------------------------------------------------------------------------


def search_sql(where: str, farthest: bool = False, k: int = 5) -> tuple[str, str]:
    order = "desc" if farthest else "asc"
    ctes = over_pairs(BLEND, where=where + " AND a.entity <> b.entity") + f""", dd AS (SELECT entity, year, b_entity, b_year, (b_year - year)::INT AS dy, round(d, 9) AS d FROM dist),
    one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, year, b_entity ORDER BY d {order}, abs(dy), b_year) AS n FROM dd) WHERE n = 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY entity, year ORDER BY d {order}, abs(dy), b_year, b_entity)::INT AS rank FROM one)"""
    return on_profiles(f"SELECT entity, year, b_entity, b_year, rank, d + 0.0 AS d FROM ranked WHERE rank <= {k}", ctes), ctes


def shown(df):
    return df.select("entity", "year", "b_entity", "b_year", F.col("rank").cast("int").alias("rank"), (F.col("d") + F.lit(0.0)).alias("d"))


SEARCHES = {
    "similar_same_year": ("a.year = b.year", S.Query(), False),
    "similar_near": ("abs(a.year - b.year) <= 1", S.Query("near", n=1), False),
    "similar_range": ("b.year BETWEEN 1996 AND 1998", S.Query("range", first=1998, last=1996), False),
    "similar_any_dedupe": ("TRUE", S.Query("any"), False),
    "similar_today": ("b.year = 2001", S.Query("today"), False),
    "similar_observed": ("(b.year <= 1999 OR a.year > 1999)", S.Query("any", era_cut=1999), False),
    "similar_observed_strict": ("b.year <= 1999", S.Query("any", era_cut=1999, era_resolved=True), False),
    "similar_floor": ("a.year = b.year AND b.total >= 9000", S.Query(floor=9000), False),
    "similar_trend_mask": ("a.year >= 1997 AND b.year >= 1997", S.Query("any", trend=2), False),
    "different_farthest": ("a.year = b.year", S.Query(), True),
}
for _name, (_where, _q, _far) in SEARCHES.items():
    query(_name, search_sql(_where, _far)[0])(lambda spark, d, q=_q, far=_far: shown((S.different if far else S.similar)(C.profiles(spark, d), q)))


def mmr_sql(k: int = 3, beta: float = 0.5) -> str:
    ctes = search_sql("a.year = b.year", True)[1] + f", pool AS (SELECT entity, year, b_entity, d, rank FROM ranked QUALIFY rank <= least(greatest(ceil(count(*) OVER (PARTITION BY entity, year) / 4.0), {k}), 2000)), c1 AS (SELECT *, 1 AS turn FROM pool WHERE rank = 1)"
    chosen = ["c1"]
    for t in range(2, k + 1):
        so_far = " UNION ALL ".join(f"SELECT * FROM {c}" for c in chosen)
        ctes += f""", s{t} AS (SELECT p.*, min(round(dist.d, 9)) AS near FROM pool p JOIN ({so_far}) c USING (entity, year) JOIN dist ON dist.entity = c.b_entity AND dist.year = c.year AND dist.b_entity = p.b_entity
        WHERE NOT EXISTS (SELECT 1 FROM ({so_far}) x WHERE x.entity = p.entity AND x.year = p.year AND x.b_entity = p.b_entity) GROUP BY ALL),
        c{t} AS (SELECT entity, year, b_entity, d, rank, {t} AS turn FROM (SELECT *, row_number() OVER (PARTITION BY entity, year ORDER BY round(d + {beta} * near, 9) DESC, rank) AS n FROM s{t}) WHERE n = 1)"""
        chosen.append(f"c{t}")
    return on_profiles("SELECT entity, year, b_entity, rank::INT AS rank_raw, turn::INT AS turn, d + 0.0 AS d FROM (" + " UNION ALL ".join(f"SELECT * FROM {c}" for c in chosen) + ")", ctes)


@query("different_mmr", mmr_sql())
def different_mmr(spark, d):
    out = S.diversified(C.profiles(spark, d), S.Query())
    return out.select("entity", "year", "b_entity", F.col("rank_raw").cast("int").alias("rank_raw"), F.col("turn").cast("int").alias("turn"), (F.col("d") + F.lit(0.0)).alias("d"))


BEST = search_sql("TRUE")[1] + ", ed AS (SELECT entity, year, b_entity, min(b_year) AS lo, max(b_year) AS hi FROM dd GROUP BY ALL)"


@query("best_year_boundary", on_profiles("SELECT entity, year, b_entity, b_year, d + 0.0 AS d, (b_year = lo OR b_year = hi) AS boundary_hit FROM one JOIN ed USING (entity, year, b_entity)", BEST))
def best_year_boundary(spark, d):
    out = S.best_years(C.profiles(spark, d), S.Query("any"))
    return out.select("entity", "year", "b_entity", "b_year", (F.col("d") + F.lit(0.0)).alias("d"), "boundary_hit")


ISO = search_sql("a.year = b.year")[1] + ", iso AS (SELECT entity, year, avg(d) AS v FROM ranked WHERE rank <= 5 GROUP BY ALL)"


@query("isolation", on_profiles("SELECT entity, year, round(v, 10) + 0.0 AS isolation FROM iso", ISO))
def isolation(spark, d):
    return S.isolation(C.profiles(spark, d)).select(*ids, (F.round("isolation", 10) + F.lit(0.0)).alias("isolation"))


@query("isolation_percentile", on_profiles("SELECT entity, year, round(percent_rank() OVER (PARTITION BY year ORDER BY round(v, 9)), 6) + 0.0 AS percentile FROM iso", ISO))
def isolation_percentile(spark, d):
    w = Window.partitionBy("year").orderBy(F.round("isolation", 9))
    return S.isolation(C.profiles(spark, d)).select(*ids, r6(F.percent_rank().over(w)).alias("percentile"))


@query("own_trajectory", on_profiles("SELECT entity, year, b_year, round(d, 9) + 0.0 AS d FROM (SELECT *, row_number() OVER (PARTITION BY entity, year ORDER BY round(d, 9), abs(b_year - year), b_year) AS n FROM dist) WHERE n = 1", over_pairs(BLEND, where="a.entity = b.entity AND abs(a.year - b.year) >= 2")))
def own_trajectory(spark, d):
    return S.own_trajectory(C.profiles(spark, d)).select(*ids, "b_year", (F.col("d") + F.lit(0.0)).alias("d"))


TABLED = ("median_value", "low", "mid", "high", "total_dep", "base_slope_far", "side_ratio", "modal_bin")
SHOWN = ("median_value", "high", "low", "base_slope_far", "side_ratio", "modal_bin")


@query("pair_feature_table", on_profiles(" UNION ALL ".join(f"SELECT a.entity, a.year, b.entity AS b_entity, '{c}' AS feature, round(a.{c}, 6) + 0.0 AS a, round(b.{c}, 6) + 0.0 AS b, round(b.z_{c} - a.z_{c}, 6) + 0.0 AS dz FROM z a JOIN z b ON a.year = b.year AND a.entity <> b.entity" for c in TABLED), Z))
def pair_feature_table(spark, d):
    z = X.zscores(X.features(C.profiles(spark, d)))
    met = C.pairs(z, z, others_of_year(), ["entity", "year", *TABLED, *[f"z_{c}" for c in TABLED]])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("a"), F.col(f"b_{c}").alias("b"), (F.col(f"b_z_{c}") - F.col(f"z_{c}")).alias("dz")) for c in TABLED])
    return met.select("entity", "year", "b_entity", F.inline(rows)).select("entity", "year", "b_entity", "feature", r6("a").alias("a"), r6("b").alias("b"), r6("dz").alias("dz"))


@query("explain_alike_differs", on_profiles(
    "SELECT entity, year, b_entity, string_agg(feature, ',' ORDER BY g, i) FILTER (up <= 2) AS alike, max(feature) FILTER (down = 1) AS differs FROM (SELECT *, row_number() OVER (PARTITION BY entity, year, b_entity ORDER BY g, i) AS up, row_number() OVER (PARTITION BY entity, year, b_entity ORDER BY g DESC, i DESC) AS down FROM ("
    + " UNION ALL ".join(f"SELECT a.entity, a.year, b.entity AS b_entity, {i} AS i, '{c}' AS feature, round(abs(b.z_{c} - a.z_{c}), 9) AS g FROM z a JOIN z b ON a.year = b.year AND a.entity <> b.entity" for i, c in enumerate(SHOWN)) + ") WHERE g IS NOT NULL) GROUP BY ALL", Z))
def explain_alike_differs(spark, d):
    """The two features of least and the one of most difference, undefined ones last."""
    z = X.zscores(X.features(C.profiles(spark, d)))
    met = C.pairs(z, z, others_of_year(), ["entity", "year", *[f"z_{c}" for c in SHOWN]])
    gaps = F.array(*[F.struct(F.round(F.abs(F.col(f"b_z_{c}") - F.col(f"z_{c}")), 9).alias("g"), F.lit(i).alias("i"), F.lit(c).alias("feature")) for i, c in enumerate(SHOWN)])
    known = met.select("entity", "year", "b_entity", F.array_sort(F.filter(gaps, lambda x: x["g"].isNotNull())).alias("g"))
    return known.select("entity", "year", "b_entity", F.array_join(F.transform(F.slice("g", 1, 2), lambda x: x["feature"]), ",").alias("alike"), F.element_at("g", -1)["feature"].alias("differs"))


# bands -------------------------------------------------------------------------------------------------------------

GRID_SQL = "[" + ", ".join(str(p / 100) for p in B.GRID) + "]"
BAND = over_pairs(BLEND) + f", bq AS (SELECT year, quantile_cont(d, {GRID_SQL}) AS q FROM dist GROUP BY year)"


@query("bands_same_grid", on_profiles(f"SELECT year, (i - 1)::INT AS i, round(q[i], 6) + 0.0 AS v FROM bq, range(1, {len(B.GRID) + 1}) r(i)", BAND))
def bands_same_grid(spark, d):
    return B.bands(same_year(spark, d, "blend"), "year").select("year", F.posexplode("q").alias("i", "v")).select("year", "i", r6("v").alias("v"))


@query("bands_best_grid", on_profiles(f"SELECT (i - 1)::INT AS i, round(q[i], 6) + 0.0 AS v FROM (SELECT quantile_cont(m, {GRID_SQL}) AS q FROM (SELECT min(d) AS m FROM dist GROUP BY entity, year, b_entity)), range(1, {len(B.GRID) + 1}) r(i)", over_pairs(BLEND, where="a.entity <> b.entity")))
def bands_best_grid(spark, d):
    """Bands of the best year of an entity: what a search with time shift is to be held against."""
    best = S.scanned(C.profiles(spark, d), S.Query("any")).groupBy("entity", "year", "b_entity").agg(F.min("d").alias("d"))
    return B.bands(best).select(F.posexplode("q").alias("i", "v")).select("i", r6("v").alias("v"))


def banded(spark, d):
    dist = same_year(spark, d, "blend").withColumn("d", F.round("d", 9))
    return dist.join(B.bands(dist, "year").select("year", "q"), "year")


RB = over_pairs(BLEND) + f", rd AS (SELECT entity, year, b_entity, round(d, 9) AS d FROM dist), bq AS (SELECT year, quantile_cont(d, {GRID_SQL}) AS q FROM rd GROUP BY year)"


@query("band_label", on_profiles(f"SELECT entity, year, b_entity, CASE WHEN d >= q[{B.P95 + 1}] THEN 'extreme' WHEN d >= q[{B.P75 + 1}] THEN 'far' WHEN d <= q[{B.P5 + 1}] THEN 'very_close' WHEN d <= q[{B.P25 + 1}] THEN 'close' ELSE 'typical' END AS label FROM rd JOIN bq USING (year)", RB))
def band_label(spark, d):
    return banded(spark, d).select("entity", "year", "b_entity", B.label(F.col("d"), F.col("q")).alias("label"))


@query("band_percentile", on_profiles(f"""SELECT entity, year, b_entity, round(CASE WHEN d <= q[1] THEN 0 WHEN d >= q[{len(B.GRID)}] THEN 100 ELSE g[i] + coalesce((d - q[i]) / nullif(q[i + 1] - q[i], 0), 0) * (g[i + 1] - g[i]) END, 4) + 0.0 AS percentile
FROM (SELECT *, len(list_filter(q, lambda x: x <= d)) AS i, {[float(p) for p in B.GRID]} AS g FROM rd JOIN bq USING (year))""", RB))  # fmt: skip
def band_percentile(spark, d):
    return banded(spark, d).select("entity", "year", "b_entity", (F.round(B.percentile_of(F.col("d"), F.col("q")), 4) + F.lit(0.0)).alias("percentile"))


@query("band_select", on_profiles("SELECT entity, year, b_entity, b_year, CASE WHEN b_year = year THEN 'same:' || year ELSE 'cross:' || CASE WHEN b_year <= 1999 THEN 'obs' ELSE 'all' END || ':' || (year // 10 * 10) END AS band FROM ranked WHERE rank <= 5", search_sql("TRUE")[1]))
def band_select(spark, d):
    top = S.similar(C.profiles(spark, d), S.Query("any"))
    decade = (F.floor(F.col("year") / 10) * 10).cast("int").cast("string")
    name = F.when(F.col("b_year") == F.col("year"), F.concat(F.lit("same:"), F.col("year").cast("string"))).otherwise(F.concat_ws(":", F.lit("cross"), F.when(F.col("b_year") <= 1999, "obs").otherwise("all"), decade))
    return top.select("entity", "year", "b_entity", "b_year", name.alias("band"))
