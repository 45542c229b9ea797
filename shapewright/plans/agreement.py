"""Queries of what triplets say of metrics: agreement by stratum, pairs of metrics against each other, and weights fitted to the answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import metrics as M
from ..operators import triplets as Tr
from .registry import on_profiles, query
from .triplets import ANSWER, answers

WEIGHTS = (0.0, 0.25, 0.5, 0.75, 1.0)
SIGMA = M.SIGMA


def judged(spark, d):
    """item, stratum and choice of the answered items that came first and were no ties, with both candidates' distances a_ and b_ by every metric."""
    told = answers(spark, d).where("duplicate_of IS NULL AND choice <> 'tie'").select("item", "stratum", "choice", "entity", "year", "e1", "y1", "e2", "y2")
    p = C.profiles(spark, d).select("entity", "year", "s", "c").withColumn("sq", F.transform("s", lambda x: F.sqrt(x)))
    rows = told.join(p, ["entity", "year"])
    for k, side in ((1, "a"), (2, "b")):
        other = p.select(F.col("entity").alias(f"e{k}"), F.col("year").alias(f"y{k}"), *[F.col(c).alias(f"b_{c}") for c in ("s", "c", "sq")])
        rows = rows.join(other, [f"e{k}", f"y{k}"]).withColumns({f"{side}_{m}": F.round(M.distance("cosine" if m == "cos" else m), 9) for m in Tr.METRICS}).drop("b_s", "b_c", "b_sq")
    return rows.select("item", "stratum", "choice", *[f"{side}_{m}" for side in "ab" for m in Tr.METRICS])


def prefers(a, b):
    """What a metric answers: the nearer candidate, the farther one where opposites are asked for, null for a tie."""
    near = F.when(a < b, F.lit("A")).when(a > b, F.lit("B"))
    return F.when(F.col("stratum") != "opposite", near).otherwise(F.when(near == "A", "B").when(near == "B", "A"))


def prefers_sql(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN NULL WHEN ({a} < {b}) = (stratum <> 'opposite') THEN 'A' ELSE 'B' END"


JUDGED = f"{ANSWER}, ju AS (SELECT x.item, x.stratum, x.choice, {', '.join(f'{s}.{m} AS {s}_{m}' for s in 'ab' for m in Tr.METRICS)} FROM answers x JOIN tm a ON a.entity = x.entity AND a.oe = e1 AND a.oy = y1 JOIN tm b ON b.entity = x.entity AND b.oe = e2 AND b.oy = y2 WHERE x.duplicate_of IS NULL AND x.choice <> 'tie')"
LONG = f"{JUDGED}, lo AS ({' UNION ALL '.join(f"SELECT item, stratum, '{m}' AS metric, choice, {prefers_sql(f'a_{m}', f'b_{m}')} AS says FROM ju" for m in Tr.METRICS)})"


def by_metric(rows):
    says = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), prefers(F.col(f"a_{m}"), F.col(f"b_{m}")).alias("says")) for m in Tr.METRICS]))
    return rows.select("item", "stratum", "choice", says)


@query("triplet_agreement", on_profiles("SELECT metric, stratum, count(says) AS n, count(*) FILTER (says = choice) AS agree FROM lo GROUP BY metric, stratum", LONG))
def triplet_agreement(spark, d):
    """How often each metric says what the rater chose, by stratum; items that a metric cannot tell apart are left out for it."""
    return by_metric(judged(spark, d)).groupBy("metric", "stratum").agg(F.count("says").alias("n"), F.count(F.when(F.col("says") == F.col("choice"), 1)).alias("agree"))


@query("triplet_sign_tests", on_profiles("SELECT x.metric, y.metric AS other, count(*) FILTER (x.says = x.choice AND y.says <> y.choice) AS wins, count(*) FILTER (x.says <> x.choice AND y.says = y.choice) AS losses FROM lo x JOIN lo y ON x.item = y.item AND x.metric < y.metric GROUP BY ALL", LONG))
def triplet_sign_tests(spark, d):
    """Items on which one of two metrics agrees with the rater and the other does not."""
    rows = by_metric(judged(spark, d)).select("item", "metric", (F.col("says") == F.col("choice")).alias("ok"))
    met = rows.join(rows.select("item", F.col("metric").alias("other"), F.col("ok").alias("other_ok")), "item").where("metric < other")
    return met.groupBy("metric", "other").agg(F.count(F.when(F.col("ok") & ~F.col("other_ok"), 1)).alias("wins"), F.count(F.when(~F.col("ok") & F.col("other_ok"), 1)).alias("losses"))


def weighed(side: str, w: float):
    return F.round(w * F.col(f"{side}_l2") / SIGMA["l2"] + (1 - w) * F.col(f"{side}_w1sex") / SIGMA["w1sex"], 9)


GRID = f"{JUDGED}, gr_ AS ({' UNION ALL '.join('SELECT item, stratum, choice, {0} AS w, round({0} * a_l2 / {1} + (1 - {0}) * a_w1sex / {2}, 9) AS da, round({0} * b_l2 / {1} + (1 - {0}) * b_w1sex / {2}, 9) AS db FROM ju'.format(w, SIGMA['l2'], SIGMA['w1sex']) for w in WEIGHTS)}), gs AS (SELECT item, w, coalesce({prefers_sql('da', 'db')} = choice, FALSE)::INT AS ok FROM gr_), gt AS (SELECT w, sum(ok)::BIGINT AS agree, count(*) AS n FROM gs GROUP BY w)"


@query("triplet_fit", on_profiles("SELECT w::DOUBLE AS w, agree, n, row_number() OVER (ORDER BY agree DESC, abs(w - 0.5), w) = 1 AS best, (SELECT sum(ok)::BIGINT FROM (SELECT g.item, g.ok FROM gs g JOIN gt USING (w) QUALIFY row_number() OVER (PARTITION BY g.item ORDER BY agree - g.ok DESC, abs(w - 0.5), w) = 1)) AS left_out FROM gt", GRID))
def triplet_fit(spark, d):
    """Agreement of the blended distance by the weight of its first part, the best weight (nearest to a half of equal ones), and how many items the weight that is best without them gets right."""
    from pyspark.sql import Window

    says = F.inline(F.array(*[F.struct(F.lit(w).alias("w"), F.coalesce(prefers(weighed("a", w), weighed("b", w)) == F.col("choice"), F.lit(False)).cast("int").alias("ok")) for w in WEIGHTS]))
    each = judged(spark, d).select("item", says)
    total = each.groupBy("w").agg(F.sum("ok").alias("agree"), F.count(F.lit(1)).alias("n"))
    order = lambda agree: [F.desc(agree), F.abs(F.col("w") - 0.5), "w"]
    without = each.join(total, "w").withColumn("k", F.row_number().over(Window.partitionBy("item").orderBy(*order(F.col("agree") - F.col("ok"))))).where("k = 1")
    left = without.agg(F.sum("ok").alias("left_out"))  # one row
    best = F.row_number().over(Window.orderBy(*order(F.col("agree")))) == 1  # as many rows as weights
    return total.select("w", "agree", "n", best.alias("best")).join(F.broadcast(left))
