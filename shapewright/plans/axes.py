"""Queries of principal axes and of what changes a vector's neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import axes as A
from ..operators import relational as R
from ..session import table
from .evaluation import EMB, search_vectors
from .registry import query, r6

DIM, NEAREST = 64, 5
CENTRED = f"{EMB}, x AS (SELECT id, unnest(v) AS v, generate_subscripts(v, 1)::INT AS i FROM e), m AS (SELECT i, avg(v) AS m FROM x GROUP BY i), z AS (SELECT id, i, v - m AS v FROM x JOIN m USING (i))"


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


@query("principal_variance", f"WITH {CENTRED}, c AS (SELECT a.i, b.i AS j, sum(a.v * b.v) / ((SELECT count(*) FROM e) - 1) AS c FROM z a JOIN z b USING (id) GROUP BY a.i, b.i) SELECT (SELECT count(*) FROM e) AS n, round(sum(c) FILTER (i = j), 6) AS total, round(sum(c * c), 6) AS squares FROM c")
def principal_variance(spark, d):
    """What all axes explain: the sum of the variances along them and that of their squares, which the covariances give without any axis."""
    a = A.fitted(vectors(spark, d), "v", DIM, DIM)
    return spark.createDataFrame([(a.n, float(a.variances.sum()), float((a.variances**2).sum()))], "n long, total double, squares double").select("n", F.round("total", 6).alias("total"), F.round("squares", 6).alias("squares"))


@query("principal_projection", f"WITH {CENTRED} SELECT id, round(sum(v * v), 6) + 0.0 AS squares FROM z GROUP BY id")
def principal_projection(spark, d):
    """Vectors along all axes: their squared lengths from the mean, which a turn does not change."""
    v = vectors(spark, d)
    out = A.projected(v, "v", A.fitted(v, "v", DIM, DIM), "z")
    return out.select("id", r6(F.aggregate("z", F.lit(0.0), lambda t, x: t + x * x)).alias("squares"))


@query("principal_shares")
def principal_shares(spark, d):
    """Shares of variance that 1, 2, ... axes explain."""
    a = A.fitted(vectors(spark, d), "v", DIM, DIM)
    return spark.createDataFrame([(k + 1, float(v), float(s)) for k, (v, s) in enumerate(zip(a.variances, a.shares, strict=True))], "axis int, variance double, share double").select("axis", r6("variance").alias("variance"), r6("share").alias("share"))


VARIANTS = {"coarse": ("round(x, 1)", lambda x, i: F.round(x, 1)), "dimmed": ("CASE WHEN i > 16 THEN x / 4 ELSE x END", lambda x, i: F.when(i >= 16, x / 4).otherwise(x))}
COSINE = "round(1 - list_inner_product({0}.v, {1}.v) / (sqrt(list_inner_product({0}.v, {0}.v)) * sqrt(list_inner_product({1}.v, {1}.v)) + 1e-12), 9)"


def neighbour_sql() -> str:
    parts = [f"{EMB}", f"b AS (SELECT a.id, o.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY {COSINE.format('a', 'o')}, o.id) AS r FROM e a JOIN e o ON a.id <> o.id AND a.id % 10 = 0)"]
    for name, (sql, _) in VARIANTS.items():
        parts += [
            f"v_{name} AS (SELECT id, list({sql} ORDER BY i) AS v FROM (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY id)",
            f"r_{name} AS (SELECT a.id, count(*) FILTER (o.id <> a.id AND {COSINE.format('a', 'o')} < {COSINE.format('a', 'u')}) + 1 AS rank FROM v_{name} a JOIN e u ON u.id = a.id JOIN e o ON TRUE WHERE a.id % 10 = 0 GROUP BY a.id)",
            f"n_{name} AS (SELECT a.id, o.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY {COSINE.format('a', 'o')}, o.id) AS r FROM v_{name} a JOIN v_{name} o ON a.id <> o.id AND a.id % 10 = 0)",
            f"j_{name} AS (SELECT b.id, count(n.other) / ({2 * NEAREST}.0 - count(n.other)) AS j FROM b LEFT JOIN n_{name} n ON n.id = b.id AND n.other = b.other AND n.r <= {NEAREST} WHERE b.r <= {NEAREST} GROUP BY b.id)",
        ]
    each = [f"SELECT '{n}' AS variant, count(*) AS n, median(rank) AS median_rank, round(avg((rank = 1)::INT), 6) AS first, round(avg((rank <= {NEAREST})::INT), 6) AS among, round(avg(j), 6) + 0.0 AS jaccard FROM r_{n} JOIN j_{n} USING (id)" for n in VARIANTS]
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(each)}"


@query("variant_invariance", neighbour_sql())
def variant_invariance(spark, d):
    """Vectors with coarse or dimmed components against the originals: at which rank a tenth of them find themselves, and which of their nearest stay."""
    e = vectors(spark, d).where(F.size("v") == DIM)
    near = lambda of: search_vectors(of.where("id % 10 = 0"), of, NEAREST).groupBy("id").agg(F.collect_set("b_id").alias("near"))
    base, out = near(e), None
    for name, (_, change) in VARIANTS.items():
        changed = e.select("id", F.transform("v", change).alias("v"), "label")
        ranks = A.self_ranks(changed.where("id % 10 = 0").select("id", "v"), e.select("id", "v"))
        kept = base.join(near(changed).withColumnRenamed("near", "other"), "id").select("id", R.jaccard(F.col("near"), F.col("other")).alias("j"))
        share = lambda c: F.round(F.avg(c.cast("int")), 6)
        new = ranks.join(kept, "id").agg(F.count(F.lit(1)).alias("n"), F.percentile("rank", 0.5).alias("median_rank"), share(F.col("rank") == 1).alias("first"), share(F.col("rank") <= NEAREST).alias("among"), r6(F.avg("j")).alias("jaccard")).withColumn("variant", F.lit(name))
        out = new if out is None else out.unionByName(new)
    return out
