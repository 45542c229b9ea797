"""Queries of archived revisions.

Two revisions are derived from the lines: each lacks another seventh of the orders and all years after its own. The older one's ladder
ends at bin 8, the newer one's has a bin more than today's; one nation has another code in the older one, and some codes are nobody's.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import metrics as M
from ..operators import vintage as V
from ..session import table
from .profile import BLEND
from .registry import on_profiles, query, r6

REVISIONS, ORIGINS = (1997, 1999), (1997, 1998, 1999)
RENAMED, OLD_CODE, SPARE, STRAY = 24, 100, 101, 150
"""The nation that has OLD_CODE in the older revision; SPARE is an older code of nation 23, which has its own, STRAY is nobody's."""
ANCHOR, K, ENOUGH = (7, 1996), 5, 0.6

ARCHIVE = f"""ra AS (
  SELECT r AS revision, c_nationkey AS e, year(l_shipdate)::INT AS year, CASE WHEN r = 1999 AND l_quantity >= 49 THEN 10 WHEN r = 1997 THEN least(floor((l_quantity - 1) / 5), 8) ELSE floor((l_quantity - 1) / 5) END::INT AS bin, l_linestatus AS side, sum(l_quantity) AS pop
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey, (VALUES {", ".join(f"({r})" for r in REVISIONS)}) v(r) WHERE l_orderkey % 7 <> r % 7 AND year(l_shipdate) <= r GROUP BY ALL
), rc AS (
  SELECT revision, CASE WHEN revision = 1997 AND e = {RENAMED} THEN {OLD_CODE} ELSE e + 1 END AS code, year, bin, side, pop FROM ra
  UNION ALL SELECT revision, {SPARE}, year, bin, side, pop FROM ra WHERE e = 22 UNION ALL SELECT revision, {STRAY}, year, bin, side, pop FROM ra WHERE e = 21
), cs AS (SELECT DISTINCT revision, code FROM rc), ow AS (SELECT revision, code, code - 1 AS entity, 'own' AS via FROM cs WHERE code <= 25),
pr AS (SELECT revision, min(code) AS code, entity, 'predecessor' AS via FROM cs JOIN (VALUES ({OLD_CODE}, {RENAMED}), ({SPARE}, 23)) p(code, entity) USING (code) WHERE (revision, entity) NOT IN (SELECT (revision, entity) FROM ow) GROUP BY revision, entity),
mp AS (SELECT * FROM ow UNION ALL SELECT revision, code, entity, via FROM pr UNION ALL SELECT revision, code, NULL, NULL FROM cs WHERE (revision, code) NOT IN (SELECT (revision, code) FROM ow UNION ALL SELECT (revision, code) FROM pr))"""


def archive(spark, d):
    """revision, code, year, bin, side, pop of both revisions, in their own codes and ladders."""
    lines = table(spark, d, "lineitem").select("l_orderkey", F.year("l_shipdate").alias("year"), "l_quantity", F.col("l_linestatus").alias("side"))
    owners = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = lines.join(owners, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("revision", F.explode(F.array(*map(F.lit, REVISIONS)))).where((F.col("l_orderkey") % 7 != F.col("revision") % 7) & (F.col("year") <= F.col("revision")))
    today = F.floor((F.col("l_quantity") - 1) / 5)
    bin_ = F.when((F.col("revision") == 1999) & (F.col("l_quantity") >= 49), 10).when(F.col("revision") == 1997, F.least(today, F.lit(8))).otherwise(today).cast("int")
    counted = rows.groupBy("revision", F.col("c_nationkey").alias("e"), "year", bin_.alias("bin"), "side").agg(F.sum("l_quantity").alias("pop"))
    own = F.when((F.col("revision") == 1997) & (F.col("e") == RENAMED), OLD_CODE).otherwise(F.col("e") + 1)
    codes = F.when(F.col("e") == 22, F.array(own, F.lit(SPARE))).when(F.col("e") == 21, F.array(own, F.lit(STRAY))).otherwise(F.array(own))
    return counted.select("revision", F.explode(codes).alias("code"), "year", "bin", "side", "pop")


def mapping(spark, d, rows):
    entities = table(spark, d, "nation").select((F.col("n_nationkey") + 1).alias("code"), F.col("n_nationkey").alias("entity"))
    older = spark.createDataFrame([(OLD_CODE, RENAMED), (SPARE, 23)], "code int, entity int")
    return V.mapped(rows.select("revision", "code").distinct(), entities, older)


@query("vintage_mapping", f"WITH {ARCHIVE} SELECT revision, code, entity, via FROM mp")
def vintage_mapping(spark, d):
    """Which entity each archived code is, by its own code or as the predecessor of one that is absent."""
    return mapping(spark, d, archive(spark, d))


CROSS = f"""{ARCHIVE}, sl AS (SELECT DISTINCT revision, year FROM rc), kn AS (SELECT t, max((revision, year)) AS m FROM (VALUES {", ".join(f"({t})" for t in ORIGINS)}) o(t) JOIN sl ON revision <= t AND year <= t GROUP BY t),
ax AS (SELECT t, rc.revision, entity, via, rc.year, least(bin, 9) + CASE WHEN side = 'F' THEN 10 ELSE 0 END AS pos, sum(pop) AS pop FROM rc JOIN mp ON mp.revision = rc.revision AND mp.code = rc.code AND entity IS NOT NULL JOIN kn ON m[1] = rc.revision AND m[2] = rc.year GROUP BY ALL),
ad AS (SELECT t, revision, entity, via, year, pos, coalesce(pop, 0)::DOUBLE AS pop FROM (SELECT DISTINCT t, revision, entity, via, year FROM ax) CROSS JOIN range(20) r(pos) LEFT JOIN (SELECT t, entity, pos, pop FROM ax) USING (t, entity, pos)),
ash AS (SELECT *, pop / sum(pop) OVER (PARTITION BY t, entity) AS s, sum(pop) OVER (PARTITION BY t, entity) AS total FROM ad), av AS (SELECT *, sum(s) OVER (PARTITION BY t, entity, pos >= 10 ORDER BY pos ROWS UNBOUNDED PRECEDING) AS c FROM ash)"""


def cross_sections(spark, d):
    """t, revision, entity, via, year and the archived vector of each entity, as it was known at each origin."""
    rows = archive(spark, d)
    aligned = V.realigned(rows, "revision", 9)
    names = mapping(spark, d, rows).where("entity IS NOT NULL")
    origins = spark.createDataFrame([(t,) for t in ORIGINS], "t int")
    known = V.known_at(rows.select("revision", "year").distinct(), origins)
    met = aligned.join(names, ["revision", "code"]).join(known, ["revision", "year"])
    cells = met.select(F.struct("t", "revision", "entity", "via").alias("entity"), "year", "bin", "side", "pop")
    return C.vectors(C.dense(cells)).select("entity.*", "year", "total", "s", "c")


@query("vintage_revisions", on_profiles(f"SELECT t, revision, entity, via, year, round(l2, 6) + 0.0 AS l2, round(l2 / {M.SIGMA['l2']}, 6) + 0.0 AS l2_sigma, round(d, 6) + 0.0 AS d_blend, round(then_ / now_ - 1, 6) + 0.0 AS pop_rel FROM (SELECT a.t, a.revision, a.entity, a.via, a.year, sqrt(sum((a.s - b.s) * (a.s - b.s))) AS l2, {BLEND} AS d, any_value(a.total) AS then_, any_value(b.total) AS now_ FROM av a JOIN (SELECT entity, year, pos, s, c, total FROM p) b ON a.entity = b.entity AND a.year = b.year AND a.pos = b.pos GROUP BY a.t, a.revision, a.entity, a.via, a.year)", CROSS))
def vintage_revisions(spark, d):
    """How far each entity's archived vector and total were from today's of the same year."""
    now = C.profiles(spark, d).select("entity", "year", F.col("total").alias("now"), F.col("s").alias("b_s"), F.col("c").alias("b_c"))
    met = cross_sections(spark, d).join(now, ["entity", "year"])
    l2 = F.sqrt(F.aggregate(F.zip_with("s", "b_s", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x))
    return met.select("t", "revision", "entity", "via", "year", r6(l2).alias("l2"), r6(l2 / M.SIGMA["l2"]).alias("l2_sigma"), r6(M.distance("blend")).alias("d_blend"), r6(F.col("total") / F.col("now") - 1).alias("pop_rel"))


SELECTION = f"""{CROSS}, an AS (SELECT pos, s, c FROM p WHERE entity = {ANCHOR[0]} AND year = {ANCHOR[1]}), dn AS (SELECT b.entity, b.year, {BLEND.replace('a.', 'an.')} AS d FROM p b JOIN an USING (pos) GROUP BY b.entity, b.year),
da AS (SELECT b.t, b.revision, b.entity, b.year, {BLEND.replace('a.', 'an.')} AS d FROM av b JOIN an USING (pos) WHERE b.entity <> {ANCHOR[0]} GROUP BY b.t, b.revision, b.entity, b.year),
dr AS (SELECT t, revision, entity, round(dn.d, 9) AS now_, round(da.d, 9) AS then_ FROM da JOIN dn USING (entity, year)),
rk AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY now_, entity) AS a, row_number() OVER (PARTITION BY t ORDER BY then_, entity) AS b, rank() OVER (PARTITION BY t ORDER BY now_) + (count(*) OVER (PARTITION BY t, now_) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY t ORDER BY then_) + (count(*) OVER (PARTITION BY t, then_) - 1) / 2.0 AS rb FROM dr),
se AS (SELECT t, revision, count(*) AS n, round(count(*) FILTER (a <= {K} AND b <= {K}) / count(*) FILTER (a <= {K} OR b <= {K}), 6) + 0.0 AS jaccard, round(corr(ra, rb), 6) + 0.0 AS rho, median(b) FILTER (a <= {K}) AS median_rank, (max(b) FILTER (a <= {K}))::INT AS max_rank, count(*) FILTER (a <= {K} AND b <= {K}) AS within_k, count(*) FILTER (a <= {K} AND b <= {2 * K}) AS within_2k FROM rk GROUP BY t, revision)"""


def selection(spark, d):
    p = C.profiles(spark, d).select("entity", "year", "s", "c")
    anchor = p.where((F.col("entity") == ANCHOR[0]) & (F.col("year") == ANCHOR[1])).select(F.col("s").alias("b_s"), F.col("c").alias("b_c"))  # one row
    to = lambda rows, name: rows.join(F.broadcast(anchor)).withColumn(name, F.round(M.distance("blend"), 9)).drop("s", "c", "b_s", "b_c")
    then = to(cross_sections(spark, d).where(F.col("entity") != ANCHOR[0]).select("t", "revision", "entity", "year", "s", "c"), "then")
    found = V.continuity(then.join(to(p, "now"), ["entity", "year"]), ["t", "revision"], "entity", "now", "then", K)
    return found.select("t", "revision", "n", r6("jaccard").alias("jaccard"), r6("rho").alias("rho"), "median_rank", "max_rank", "within_k", "within_2k")


@query("vintage_selection", on_profiles(f"SELECT *, jaccard >= {ENOUGH} AS met FROM se", SELECTION))
def vintage_selection(spark, d):
    """The entities nearest to an anchor by today's vectors and by those known at each origin: what both choose, and how ranks moved."""
    return selection(spark, d).withColumn("met", F.col("jaccard") >= ENOUGH)


@query("vintage_summary", on_profiles(f"SELECT count(*) AS cells, count(*) FILTER (jaccard >= {ENOUGH}) AS cells_met, coalesce(string_agg(t::VARCHAR, ',' ORDER BY t) FILTER (jaccard < {ENOUGH}), '') AS not_met, bool_and(jaccard >= {ENOUGH}) AS all_met FROM se", SELECTION))
def vintage_summary(spark, d):
    """At how many origins enough of the choice stayed."""
    s = selection(spark, d).withColumn("met", F.col("jaccard") >= ENOUGH)
    missed = F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.when(~F.col("met"), F.col("t")))), lambda t: t.cast("string")))
    return s.agg(F.count(F.lit(1)).alias("cells"), F.count(F.when(F.col("met"), 1)).alias("cells_met"), missed.alias("not_met"), F.min("met").alias("all_met"))
