"""Queries of triplets: which anchors and candidates are asked about, in which order, and what a synthetic rater answers."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import metrics as M
from ..operators import triplets as Tr
from .profile import BLEND, L2, W1
from .registry import on_profiles, query
from .series import UNI

YEAR, SEED, ROUNDS, REPEATS, GAP = 1999, 21, 3, 2, 6
NOISE, TIES = 0.1, 0.05
NUMERIC = list(combinations(("blend", "hel", "l2", "w1sex"), 2))
STRATA = {"visual": (False, [("blend", "cos")]), "numeric": (False, NUMERIC), "opposite": (True, NUMERIC)}
QUOTAS = {"visual": 4, "numeric": 8, "opposite": 8}

VALUES = {"l2": L2, "w1sex": W1, "blend": BLEND, "hel": "sqrt(sum((sqrt(a.s) - sqrt(b.s)) * (sqrt(a.s) - sqrt(b.s)))) / sqrt(2)", "cos": "1 - sum(a.s * b.s) / (sqrt(sum(a.s * a.s)) * sqrt(sum(b.s * b.s)) + 1e-12)"}


def uni(*key: str) -> str:
    return UNI.format("concat_ws(':', " + ", ".join((str(SEED), *key)) + ")")


def choice_sql() -> str:
    """CTEs that end in items: extremes, disagreements, and the rounds of every stratum one after another."""
    out = [
        f"tm AS (SELECT a.entity, b.entity AS oe, b.year AS oy, {', '.join(f'round({v}, 9) AS {n}' for n, v in VALUES.items())} FROM p a JOIN p b ON a.pos = b.pos AND a.year = {YEAR} AND a.entity <> b.entity GROUP BY a.entity, b.entity, b.year)",
        "tl AS (UNPIVOT tm ON " + ", ".join(VALUES) + " INTO NAME metric VALUE d)",
        "te AS (SELECT entity, metric, FALSE AS far, arg_min((oe, oy), (d, oe, oy)) AS x FROM tl GROUP BY ALL UNION ALL SELECT entity, metric, TRUE, arg_min((oe, oy), (-d, oe, oy)) FROM tl GROUP BY ALL)",
        "ts(stratum, far, m1, m2) AS (VALUES " + ", ".join(f"('{s}', {far}, '{a}', '{b}')" for s, (far, pairs) in STRATA.items() for a, b in pairs) + ")",
        f"td AS (SELECT stratum, a.entity, m1, m2, a.x[1] AS e1, a.x[2] AS y1, b.x[1] AS e2, b.x[2] AS y2, {uni('stratum', 'a.entity', 'm1', 'm2')} AS h FROM ts JOIN te a ON a.metric = m1 AND a.far = ts.far JOIN te b ON b.metric = m2 AND b.far = ts.far AND b.entity = a.entity WHERE a.x <> b.x)",
        "acc0 AS (SELECT * FROM td WHERE FALSE)",
    ]
    i = 0
    for s, quota in QUOTAS.items():
        for _ in range(ROUNDS):
            last, i = f"acc{i}", i + 1
            out += [
                f"nd{i} AS (SELECT {quota} - count(*) AS need FROM {last} WHERE stratum = '{s}')",
                f"of{i} AS (SELECT *, row_number() OVER (PARTITION BY m1, m2 ORDER BY h, entity) AS t FROM td WHERE stratum = '{s}' AND entity NOT IN (SELECT entity FROM {last}))",
                f"on{i} AS (SELECT o.*, t + coalesce(n, 0) AS turn FROM of{i} o LEFT JOIN (SELECT m1, m2, count(*) AS n FROM {last} WHERE stratum = '{s}' GROUP BY ALL) USING (m1, m2), nd{i} WHERE t <= ceil(need / {len(STRATA[s][1])}))",
                f"ok{i} AS (SELECT * FROM on{i} QUALIFY row_number() OVER (PARTITION BY entity ORDER BY turn, h, m1, m2) = 1)",
                f"acc{i} AS MATERIALIZED (SELECT * FROM {last} UNION ALL SELECT stratum, entity, m1, m2, e1, y1, e2, y2, h FROM (SELECT *, row_number() OVER (ORDER BY turn, h, m1, m2) AS k FROM ok{i}), nd{i} WHERE k <= need)",
            ]
    out += [
        f"pl AS (SELECT *, (row_number() OVER (ORDER BY {uni("'place'", 'stratum', 'entity')}, stratum, entity) - 1)::DOUBLE AS spot, CASE WHEN {uni("'side'", 'stratum', 'entity')} < 0.5 THEN 'A' ELSE 'B' END AS left_, count(*) OVER () AS n FROM acc{i})",
        f"ag AS (SELECT * EXCLUDE (n, h, spot, left_), spot + {GAP} + floor({uni("'later'", 'stratum', 'entity')} * (n - {GAP} - spot)) - 0.5 AS spot, CASE left_ WHEN 'A' THEN 'B' ELSE 'A' END AS left_, spot AS first FROM pl WHERE spot < n - {GAP} QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY {uni("'repeat'", 'stratum', 'entity')}, entity) <= {REPEATS})",
        "al AS (SELECT * EXCLUDE (n, h), NULL::DOUBLE AS first FROM pl UNION ALL BY NAME SELECT * FROM ag)",
        "nu AS (SELECT *, (row_number() OVER (ORDER BY spot, stratum, entity) - 1)::INT AS item FROM al)",
        'items AS (SELECT x.stratum, x.entity, x.m1, x.m2, x.e1, x.y1, x.e2, x.y2, x.left_ AS "left", x.item, o.item AS duplicate_of FROM nu x LEFT JOIN nu o ON o.first IS NULL AND o.spot = x.first)',
    ]
    return ", ".join(out)


def items(spark, d):
    p = C.profiles(spark, d)
    rows = Tr.disagreements(Tr.extremes(p.where(F.col("year") == YEAR), p), STRATA)
    picked = Tr.chosen(rows, QUOTAS, {s: len(pairs) for s, (_, pairs) in STRATA.items()}, ROUNDS, SEED)
    return Tr.sequence(picked.drop("h"), REPEATS, GAP, SEED)


@query("triplet_items", on_profiles("SELECT * FROM items", choice_sql()))
def triplet_items(spark, d):
    """Anchors of one year with two candidates each, on which a pair of metrics differs; every pair is used about as often, and some items come again."""
    return items(spark, d)


PREFERS = "CASE WHEN da = db THEN NULL WHEN (da < db) = (stratum <> 'opposite') THEN 'A' ELSE 'B' END"
FLIPPED = "CASE {0} WHEN 'A' THEN 'B' WHEN 'B' THEN 'A' ELSE {0} END"
ANSWER = f"""{choice_sql()}, tp AS (SELECT items.*, a.blend AS da, b.blend AS db FROM items JOIN tm a ON a.entity = items.entity AND a.oe = e1 AND a.oy = y1 JOIN tm b ON b.entity = items.entity AND b.oe = e2 AND b.oy = y2),
t1 AS (SELECT *, CASE WHEN w IS NULL OR {uni("'tie'", 'stratum', 'entity')} < {TIES} THEN 'tie' WHEN {uni("'flip'", 'stratum', 'entity')} < {NOISE} THEN {FLIPPED.format('w')} ELSE w END AS c FROM (SELECT *, {PREFERS} AS w FROM tp)),
answers AS (SELECT *, CASE WHEN duplicate_of IS NOT NULL AND {uni("'again'", 'stratum', 'entity')} < {NOISE} THEN {FLIPPED.format('c')} ELSE c END AS choice FROM t1)"""


def answers(spark, d):
    """Items with da and db, the blended distances of both candidates, and what the rater says."""
    p = C.profiles(spark, d).select("entity", "year", "s", "c")
    asked = items(spark, d).withColumn("year", F.lit(YEAR))
    for k, name in ((1, "da"), (2, "db")):
        other = p.select(F.col("entity").alias(f"e{k}"), F.col("year").alias(f"y{k}"), F.col("s").alias("b_s"), F.col("c").alias("b_c"))
        asked = asked.join(p, ["entity", "year"]).join(other, [f"e{k}", f"y{k}"]).withColumn(name, F.round(M.distance("blend"), 9)).drop("s", "c", "b_s", "b_c")
    near = F.when(F.col("da") < F.col("db"), F.lit("A")).when(F.col("da") > F.col("db"), F.lit("B"))
    prefers = F.when(F.col("stratum") != "opposite", near).otherwise(F.when(near == "A", "B").when(near == "B", "A"))
    return Tr.answered(asked, prefers, NOISE, TIES, SEED)


@query("triplet_answers", on_profiles("SELECT item, stratum, choice FROM answers", ANSWER))
def triplet_answers(spark, d):
    """What a synthetic rater who goes by the blended distance answers, with flips and ties by hash."""
    return answers(spark, d).select("item", "stratum", "choice")


@query("triplet_reliability", on_profiles("SELECT o.stratum, count(*) AS repeats, count(*) FILTER (o.choice = r.choice) AS same FROM answers o JOIN answers r ON r.duplicate_of = o.item GROUP BY o.stratum", ANSWER))
def triplet_reliability(spark, d):
    """How often a repeated item got the same answer, by stratum."""
    told = answers(spark, d).select("item", "stratum", "choice", "duplicate_of")
    again = told.where("duplicate_of IS NOT NULL").select(F.col("duplicate_of").alias("item"), F.col("choice").alias("second"))
    return told.join(again, "item").groupBy("stratum").agg(F.count(F.lit(1)).alias("repeats"), F.count(F.when(F.col("choice") == F.col("second"), 1)).alias("same"))
