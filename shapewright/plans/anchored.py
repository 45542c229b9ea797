"""Queries that look for candidates at an origin year as far as that year could know: to an anchor, and to prototypes of windows that had ended."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import metrics as M
from ..operators import search as S
from ..operators import stats as St
from ..session import shared_folder
from .profile import BLEND
from .registry import on_profiles, query, r6
from .series import GROWTH, growths

ORIGINS, H, K = (1997, 1998, 1999), 2, 4
SHARE, MOST, GAP, TAU = 0.2, 3, 2, 0.25
ANCHOR = (7, 1996)


def candidates(spark, d):
    """entity, t, g of every origin: those whose window can be measured."""
    return growths(spark, d).where((F.col("h") == H) & F.col("year").isin(*ORIGINS)).select("entity", F.col("year").alias("t"), "g")


def prototypes(spark, d):
    """t, entity, year: for each origin, windows that had ended by then, of the highest growth among these, spaced within an entity."""
    ended = growths(spark, d).where(F.col("h") == H).drop("h").withColumn("t", F.explode(F.array(*map(F.lit, ORIGINS)))).where(F.col("year") + H <= F.col("t"))
    best = St.top_share(ended, "g", SHARE, ["t"]).withColumn("key", F.concat_ws(":", "t", "entity"))
    ranked = best.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc(F.round("g", 9)), "year")))
    return St.spaced(ranked, "key", "year", "r", MOST, GAP).select("t", "entity", "year")


CANDIDATES = GROWTH + f", cd AS (SELECT entity, year AS t, g FROM gr WHERE h = {H} AND year IN {ORIGINS})"
PROTOTYPES = CANDIDATES + f""", tw AS (SELECT t, entity, year, g FROM gr JOIN (VALUES {", ".join(f"({t})" for t in ORIGINS)}) o(t) ON year + {H} <= t WHERE h = {H}), tq AS (SELECT t, quantile_cont(g, {1 - SHARE}) AS q FROM tw GROUP BY t),
tr AS (SELECT tw.*, row_number() OVER (PARTITION BY t, entity ORDER BY round(g, 9) DESC, year) AS r FROM tw JOIN tq USING (t) WHERE round(g, 12) >= round(q, 12)), b1 AS (SELECT * FROM tr WHERE r = 1),
m2 AS (SELECT tr.* FROM tr JOIN b1 USING (t, entity) WHERE abs(tr.year - b1.year) >= {GAP}), b2 AS (SELECT * FROM m2 QUALIFY r = min(r) OVER (PARTITION BY t, entity)),
m3 AS (SELECT m2.* FROM m2 JOIN b2 USING (t, entity) WHERE abs(m2.year - b2.year) >= {GAP}), b3 AS (SELECT * FROM m3 QUALIFY r = min(r) OVER (PARTITION BY t, entity)),
tp AS (SELECT t, entity, year FROM b1 UNION ALL SELECT t, entity, year FROM b2 UNION ALL SELECT t, entity, year FROM b3)"""


@query("origin_prototypes", on_profiles("SELECT t, entity, year FROM tp", PROTOTYPES))
def origin_prototypes(spark, d):
    return prototypes(spark, d)


def picked(rows, order, name):
    """rank 1 to K of each origin, with what came of it: growth over the median of all candidates."""
    w = Window.partitionBy("t").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= K).select(F.lit(name).alias("query"), "t", "rank", "entity", r6("d").alias("d"), r6("excess").alias("excess"))


def with_excess(rows):
    median = rows.groupBy("t").agg(F.percentile("g", 0.5).alias("mid"))
    return rows.join(median, "t").withColumn("excess", F.col("g") - F.col("mid"))


MEDIAN = "md AS (SELECT t, median(g) AS m FROM cd GROUP BY t)"
RANKED = "SELECT '{0}' AS query, t, rank::INT AS rank, entity, round(d, 6) + 0.0 AS d, round(g - m, 6) + 0.0 AS excess FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY {1}) AS rank FROM {2}) JOIN md USING (t) WHERE rank <= " + str(K)
LAGS = f"an AS (SELECT pos, s, c FROM p WHERE entity = {ANCHOR[0]} AND year = {ANCHOR[1]}), aa AS (SELECT cd.entity, cd.t, cd.g, round({BLEND.replace('a.', 'an.')}, 9) AS d FROM cd JOIN p b ON b.entity = cd.entity AND b.year = cd.t JOIN an ON an.pos = b.pos WHERE cd.entity <> {ANCHOR[0]} GROUP BY ALL), al AS (SELECT pos, s FROM p WHERE entity = {ANCHOR[0]} AND year = {ANCHOR[1] - 1}), ac AS (SELECT cd.entity, cd.t, cd.g, round(sqrt(sum(((an.s - al.s) - (b.s - l.s)) ** 2)) / {M.SIGMA['trend']}, 9) AS d FROM cd JOIN p b ON b.entity = cd.entity AND b.year = cd.t JOIN p l ON l.entity = cd.entity AND l.year = cd.t - 1 AND l.pos = b.pos JOIN an ON an.pos = b.pos JOIN al ON al.pos = b.pos WHERE cd.entity <> {ANCHOR[0]} GROUP BY ALL)"


@query("anchor_picks", on_profiles(RANKED.format("A", "d, entity", "aa") + " UNION ALL " + RANKED.format("C", "d, entity", "ac"), f"{CANDIDATES}, {MEDIAN}, {LAGS}"))
def anchor_picks(spark, d):
    """The candidates of each origin nearest to one anchor, by shape (A) and by change of shape (C), and what came of them; the anchor's entity is none."""
    p = C.profiles(spark, d).select("entity", "year", "s", "c")
    at = lambda rows: rows.where((F.col("entity") == ANCHOR[0]) & (F.col("year") == ANCHOR[1]))
    pool = with_excess(candidates(spark, d)).where(F.col("entity") != ANCHOR[0]).withColumn("year", F.col("t"))
    anchor = at(p).select(F.col("s").alias("b_s"), F.col("c").alias("b_c"))  # one row
    shape = pool.join(p, ["entity", "year"]).join(F.broadcast(anchor)).withColumn("d", F.round(M.distance("blend"), 9))
    moved = C.lagged(p, 1).select("entity", "year", F.zip_with("s", "s_lag", lambda x, y: x - y).alias("m"))
    change = pool.join(moved, ["entity", "year"]).join(F.broadcast(at(moved).select(F.col("m").alias("b_m"))))
    gap = F.sqrt(F.aggregate(F.zip_with("m", "b_m", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x))
    return picked(shape, ["d", "entity"], "A").unionByName(picked(change.withColumn("d", F.round(gap / M.SIGMA["trend"], 9)), ["d", "entity"], "C"))


NEAR = f"""dd AS (SELECT cd.t, cd.entity, cd.g, tp.entity AS oe, tp.year AS oy, round({BLEND}, 9) AS d FROM cd JOIN tp ON tp.t = cd.t JOIN p a ON a.entity = cd.entity AND a.year = cd.t JOIN p b ON b.entity = tp.entity AND b.year = tp.year AND a.pos = b.pos GROUP BY ALL),
dl AS (SELECT t, entity, g, min(d) AS least, coalesce(list_sort(list(d))[2], min(d)) AS second FROM dd GROUP BY ALL), dt AS (SELECT t, {TAU} * median(least) AS tau FROM dl GROUP BY t),
ds AS (SELECT t, entity, any_value(dl.g) AS g, any_value(least) AS least, any_value(second) AS second, any_value(least) - any_value(tau) * ln(sum(exp(-(d - least) / tau))) AS soft FROM dd JOIN dl USING (t, entity) JOIN dt USING (t) GROUP BY t, entity)"""


@query("query_b_pick", on_profiles(RANKED.format("B", "least, second, entity", "(SELECT *, least AS d FROM ds)") + " UNION ALL " + RANKED.format("B soft", "round(soft, 9), second, entity", "(SELECT *, soft AS d FROM ds)"), f"{PROTOTYPES}, {MEDIAN}, {NEAR}"))
def query_b_pick(spark, d):
    """The candidates of each origin nearest to the prototypes that it could know, by the least and by the soft minimum of distances, and what came of them."""
    shared_folder(spark)
    p = C.profiles(spark, d).select("entity", "year", "s", "c")
    proto = prototypes(spark, d).join(p, ["entity", "year"]).checkpoint()  # read by two searches, as the candidates are
    pool = with_excess(candidates(spark, d)).withColumn("year", F.col("t")).checkpoint()
    asked = pool.join(p, ["entity", "year"]).select("entity", "year", "t", "s", "c").checkpoint()
    least = S.soft_minima(asked, proto, metric="blend", group="t")
    tau = least.groupBy("t").agg((TAU * F.percentile("least", 0.5)).alias("tau")).checkpoint()  # a row for each origin
    found = S.soft_minima(asked.join(tau, "t"), proto, metric="blend", group="t")
    rows = pool.join(found.withColumn("second", F.coalesce("second", "least")), ["entity", "year", "t"])
    hard = picked(rows.withColumn("d", F.col("least")), ["d", "second", "entity"], "B")
    soft = picked(rows.withColumn("d", F.col("soft")), [F.round("d", 9), "second", "entity"], "B soft")
    return hard.unionByName(soft)
