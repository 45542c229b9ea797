"""Queries of bands from random pairs: tables by year, by era and decade, and of the best year, for both sides apart and together."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bands as B
from ..operators import corpus as C
from ..operators import metrics as M
from ..operators import stats as St
from .profile import BLEND, GRID_SQL
from .registry import on_profiles, query, r6
from .series import UNI

DRAWS, SEED, LAST_OBSERVED = 1000, 31, 1999
FOLDED = f"0.5 * sqrt(sum((a.s - b.s) * (a.s - b.s))) / {M.SIGMA['l2']} + 0.5 * 5 * sum(abs(a.c - b.c)) / {M.SIGMA['w1']}"


def numbered(spark, d, *by):
    """Profiles with their place in a group, from 0."""
    w = Window.partitionBy(*by).orderBy("entity", "year")
    return C.profiles(spark, d).withColumn("place", (F.row_number().over(w) - 1).cast("long"))


def pairs_of(rows, by, seed):
    """draw, by, and two different rows of the group for each of DRAWS draws; columns of the second are named with b_."""
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DRAWS - 1).cast("long"))))
    two = sizes.select("draw", *by, St.distinct_places(F.col("n"), 2, F.lit(seed), F.col("draw"), *[F.col(b) for b in by]).alias("p"))
    first = two.select("draw", *by, F.get("p", F.lit(0)).alias("place"), F.get("p", F.lit(1)).alias("b_place")).join(rows, [*by, "place"])
    other = rows.select(*by, *[F.col(c).alias(f"b_{c}") for c in rows.columns if c not in by])
    return first.join(other, [*by, "b_place"])


def draw_sql(name: str, by: str, seed: int) -> str:
    """CTEs of pairs: draw, by, and the smaller and larger of two different places."""
    u = lambda i: UNI.format(f"concat_ws(':', {seed}, draw, {by}, {i})")
    return f"""{name}_n AS (SELECT {by}, count(*) AS n FROM {name} GROUP BY {by} HAVING count(*) > 1), {name}_a AS (SELECT draw, {by}, n, floor({u(0)} * n)::BIGINT AS x FROM {name}_n, range({DRAWS}) r(draw)),
{name}_p AS (SELECT draw, {by}, least(x, y) AS p1, greatest(x, y) AS p2 FROM (SELECT *, y0 + (y0 >= x)::INT AS y FROM (SELECT *, floor({u(1)} * (n - 1))::BIGINT AS y0 FROM {name}_a)))"""


SAME = "yk AS (SELECT entity, year, row_number() OVER (PARTITION BY year ORDER BY entity) - 1 AS place FROM k), " + draw_sql("yk", "year", SEED)
PAIRS = f"{SAME}, sp AS (SELECT draw, q.year, i.entity, j.entity AS b_entity FROM yk_p q JOIN yk i ON i.year = q.year AND i.place = p1 JOIN yk j ON j.year = q.year AND j.place = p2)"


@query("drawn_pairs", on_profiles("SELECT draw, year, entity, b_entity FROM sp", PAIRS))
def drawn_pairs(spark, d):
    """Random pairs of different profiles of a year, as many for each year."""
    return pairs_of(numbered(spark, d, "year").select("entity", "year", "place"), ["year"], SEED).select("draw", "year", "entity", "b_entity")


def both_sexes(rows, *keys):
    """Bands of the pairs' distances by keys: sex 2 with sides apart, sex 1 with sides together."""
    each = F.inline(F.array(*[F.struct(F.lit(sex).alias("sex"), F.round(value, 9).alias("d")) for sex, value in (("1", M.blend_folded()), ("2", M.blend()))]))
    return B.bands(rows.select(*keys, each), *keys, "sex").select(*keys, "sex", F.posexplode("q").alias("i", "v")).select(*keys, "sex", "i", r6("v").alias("v"))


def table_sql(pairs: str, keys: str) -> str:
    """Bands of the pairs (ids entity, year, b_entity, b_year) for both sexes."""
    one = lambda sex, of, place, value: f"SELECT draw, {keys}, '{sex}' AS sex, round({value}, 9) AS d FROM {pairs} q JOIN {of} a ON a.entity = q.entity AND a.year = q.year JOIN {of} b ON b.entity = q.b_entity AND b.year = q.b_year AND a.{place} = b.{place} GROUP BY draw, {keys}"
    return f"dq AS (SELECT {keys}, sex, quantile_cont(d, {GRID_SQL}) AS q FROM ({one('1', 't', 'bin', FOLDED)} UNION ALL {one('2', 'p', 'pos', BLEND)}) GROUP BY {keys}, sex)"


SHOW = "(i - 1)::INT AS i, round(q[i], 6) + 0.0 AS v FROM dq, range(1, " + str(len(B.GRID) + 1) + ") r(i)"


@query("bands_same_drawn", on_profiles(f"SELECT y AS year, sex, {SHOW}", f"{PAIRS}, sy AS (SELECT draw, year AS y, entity, year, b_entity, year AS b_year FROM sp), " + table_sql("sy", "y")))
def bands_same_drawn(spark, d):
    """Bands of a year's distances from random pairs: they cost as many rows for a year of a million profiles as for one of a hundred."""
    return both_sexes(pairs_of(numbered(spark, d, "year"), ["year"], SEED), "year")


ERA = f"CASE WHEN {{0}} <= {LAST_OBSERVED} THEN 'obs' ELSE 'all' END"
CROSS = "ek AS (SELECT entity, year, decade, row_number() OVER (PARTITION BY decade ORDER BY entity, year) - 1 AS place FROM (SELECT *, (year // 10 * 10)::INT AS decade FROM k)), ck AS (SELECT entity, year, " + ERA.format("year") + " AS era, row_number() OVER (PARTITION BY " + ERA.format("year") + " ORDER BY entity, year) - 1 AS place FROM k)"


def place_of(n, *key):
    """A place from 0 to n - 1 by md5."""
    return F.floor(St.uniform_of(*key) * n).cast("long")


CROSS_PAIRS = f"""{CROSS}, en AS (SELECT decade, count(*) AS n FROM ek GROUP BY decade), cn AS (SELECT era, count(*) AS n FROM ck GROUP BY era),
cr AS (SELECT draw, decade, era, floor({UNI.format(f"concat_ws(':', {SEED + 1}, draw, decade, era, 0)")} * en.n)::BIGINT AS p1, floor({UNI.format(f"concat_ws(':', {SEED + 1}, draw, decade, era, 1)")} * cn.n)::BIGINT AS p2 FROM en, cn, range({DRAWS}) r(draw)),
cp AS (SELECT draw, cr.decade, cr.era, e.entity, e.year, c.entity AS b_entity, c.year AS b_year FROM cr JOIN ek e ON e.decade = cr.decade AND e.place = p1 JOIN ck c ON c.era = cr.era AND c.place = p2 WHERE e.entity <> c.entity AND e.year <> c.year)"""


@query("bands_cross_drawn", on_profiles(f"SELECT era, decade, sex, {SHOW}", CROSS_PAIRS + ", " + table_sql("cp", "era, decade")))
def bands_cross_drawn(spark, d):
    """Bands of distances between years by the candidate's era and the query's decade, from random pairs; draws of one entity or one year are left out."""
    p = C.profiles(spark, d)
    w = lambda by: F.row_number().over(Window.partitionBy(by).orderBy("entity", "year")) - 1
    asked = p.withColumn("decade", (F.floor(F.col("year") / 10) * 10).cast("int")).withColumn("place", w("decade").cast("long"))
    other = p.withColumn("era", F.when(F.col("year") <= LAST_OBSERVED, "obs").otherwise("all")).withColumn("place", w("era").cast("long"))
    size = lambda rows, by, n: rows.groupBy(by).agg(F.count(F.lit(1)).alias(n))
    tables = size(asked, "decade", "n1").join(size(other, "era", "n2"))  # a row for each table
    key = [F.col("draw"), F.col("decade"), F.col("era")]
    draws = tables.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1)))).withColumns({"place": place_of(F.col("n1"), F.lit(SEED + 1), *key, F.lit(0)), "b_place": place_of(F.col("n2"), F.lit(SEED + 1), *key, F.lit(1))})
    second = other.select("era", *[F.col(c).alias(f"b_{c}") for c in other.columns if c != "era"])
    met = draws.join(asked, ["decade", "place"]).join(second, ["era", "b_place"]).where((F.col("entity") != F.col("b_entity")) & (F.col("year") != F.col("b_year")))
    return both_sexes(met, "era", "decade")


BEST_PAIRS = f"""ak AS (SELECT entity, year, row_number() OVER (ORDER BY entity, year) - 1 AS place FROM k), ne AS (SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS place FROM (SELECT DISTINCT entity FROM k)),
br AS (SELECT draw, floor({UNI.format(f"concat_ws(':', {SEED + 2}, draw, 0)")} * (SELECT count(*) FROM ak))::BIGINT AS p1, floor({UNI.format(f"concat_ws(':', {SEED + 2}, draw, 1)")} * (SELECT count(*) FROM ne))::BIGINT AS p2 FROM range({DRAWS}) r(draw)),
bp AS (SELECT draw, a.entity, a.year, k.entity AS b_entity, k.year AS b_year FROM br JOIN ak a ON a.place = p1 JOIN ne ON ne.place = p2 JOIN k ON k.entity = ne.entity WHERE a.entity <> ne.entity)"""


@query("bands_best_drawn", on_profiles(f"SELECT (i - 1)::INT AS i, round(q[i], 6) + 0.0 AS v FROM (SELECT quantile_cont(m, {GRID_SQL}) AS q FROM (SELECT draw, min(d) AS m FROM (SELECT draw, q.b_year, round({BLEND}, 9) AS d FROM bp q JOIN p a ON a.entity = q.entity AND a.year = q.year JOIN p b ON b.entity = q.b_entity AND b.year = q.b_year AND a.pos = b.pos GROUP BY draw, q.b_year) GROUP BY draw)), range(1, {len(B.GRID) + 1}) r(i)", BEST_PAIRS))
def bands_best_drawn(spark, d):
    """Bands of the best year of a random entity for a random profile: the least over all of the entity's years, for every draw."""
    p = C.profiles(spark, d)
    ranked = St.totals_before(p.select("entity", "year", F.struct("entity", "year").alias("key"), (F.col("entity").cast("long") * 100_000 + F.col("year")).alias("order")), "order", F.lit(1)).select("entity", "year", F.col("before").alias("place"))
    names = St.totals_before(p.select("entity").distinct(), "entity", F.lit(1)).select(F.col("entity").alias("b_entity"), F.col("before").alias("b_place"))
    n = [rows.agg(F.count(F.lit(1))).scalar() for rows in (ranked, names)]
    draws = spark.range(DRAWS).select(F.col("id").alias("draw"), *[place_of(n[i], F.lit(SEED + 2), F.col("id"), F.lit(i)).alias(c) for i, c in enumerate(("place", "b_place"))])
    met = draws.join(ranked, "place").join(names, "b_place").where("entity <> b_entity").select("draw", "entity", "year", "b_entity")
    rows = met.join(p, ["entity", "year"]).join(p.select(*[F.col(c).alias(f"b_{c}") for c in p.columns]), "b_entity")
    best = rows.select("draw", F.round(M.blend(), 9).alias("d")).groupBy("draw").agg(F.min("d").alias("d"))
    return B.bands(best).select(F.posexplode("q").alias("i", "v")).select("i", r6("v").alias("v"))
