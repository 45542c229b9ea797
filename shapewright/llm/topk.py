"""Exact top-k search by inner product with a three-phase uniform threshold.

A vector's components are split into PARTS stretches, so that a score is the sum of a local score of each. Rows are compared in blocks.

1. For each part, a worker gives the K entries of its block with the best local scores, with their whole scores, as it holds all parts of a row.
   The K-th best whole score of all that were gathered for a query is a safe cutoff: the K-th best of all rows is no smaller.
2. The cutoffs go to all blocks with their queries. A score that reaches the cutoff has a part that reaches the uniform threshold, cutoff
   / PARTS. Workers give every such local score. What is missing of an entry is below the threshold, so an entry whose known part and
   thresholds for the rest stay below the K-th best of the scores that are known in full goes.
3. The missing parts of the entries left are computed from the vectors, and the best K are ranked.

Components are integers, sums are exact, and equal scores go to smaller ids. Equal vectors are searched once: of their ids the k + 1
smallest are all that a result may need, one of them being the query's own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapewright.operators.blocks import matrix, met

from .shared import cut, quoted

K = 10
PARTS = 2
SCALE = 1024
LARGEST = 1 << 24
"""Vectors with a scaled component beyond this are not searched; within it the inner product of 2**15 components fits 64 bits."""
SALTS = 16
ASKED, HELD = 512, 4096
"""Vectors of a block that asks, and of one that is searched: a worker holds a few matrices of the scores of such a pair."""
EXACT = 2.0**53
"""Up to here doubles hold all integers."""


def scaled(vector: Column) -> Column:
    """floor(SCALE * x) of each component; null for a null vector, or one with a null, non-finite or too large component."""
    fits = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= LARGEST / SCALE))
    return F.when(fits, F.transform(vector, lambda x: F.floor(SCALE * x.cast("double")).cast("int")))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices, as int64."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def stretches(dim: int, parts: int) -> list[tuple[int, int]]:
    ends = [dim * i // parts for i in range(parts + 1)]
    return list(zip(ends[:-1], ends[1:], strict=True))


def local_scores(asked: pa.RecordBatch, held: pa.RecordBatch, parts: int) -> list[np.ndarray]:
    q, x = matrix(asked.column("v"), np.int64), matrix(held.column("v"), np.int64)
    return [products(q[:, b:e], x[:, b:e]) for b, e in stretches(q.shape[1], parts)]


def entries(asked: pa.RecordBatch, held: pa.RecordBatch, row: np.ndarray, col: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    arrays = {"q": asked.column("num").take(pa.array(row)), "x": held.column("num").take(pa.array(col)), "first": held.column("first").take(pa.array(col))}
    return pa.RecordBatch.from_pydict(arrays | {n: pa.array(v) for n, v in more.items()})


def of_one_length(compare):
    """compare for each length of vectors that occurs on both sides."""

    def run(asked: pa.RecordBatch, held: pa.RecordBatch):
        sizes = [side.column("v").value_lengths().to_numpy() for side in (asked, held)]
        both = np.intersect1d(*sizes)
        found = [compare(*(side if (s == n).all() else side.filter(pa.array(s == n)) for side, s in zip((asked, held), sizes, strict=True))) for n in both]
        return pa.Table.from_batches(found).combine_chunks().to_batches()[0] if len(found) > 1 else found[0] if found else None

    return run


def best_lists(k: int, parts: int):
    """Phase 1: of each part the k best local scores of each query in a block, with whole scores."""

    def run(asked: pa.RecordBatch, held: pa.RecordBatch) -> pa.RecordBatch:
        local = local_scores(asked, held, parts)
        whole, keep = sum(local), min(k, held.num_rows)
        chosen = np.zeros(whole.shape, bool)
        for s in local:
            np.put_along_axis(chosen, np.argpartition(-s, keep - 1, axis=1)[:, :keep], True, axis=1)
        row, col = np.nonzero(chosen)
        return entries(asked, held, row, col, score=whole[row, col])

    return of_one_length(run)


def beyond(parts: int):
    """Phase 2: local scores that reach the uniform threshold: their sum, and a bit for each part that is known."""

    def run(asked: pa.RecordBatch, held: pa.RecordBatch) -> pa.RecordBatch:
        local = local_scores(asked, held, parts)
        cutoff = asked.column("cutoff").fill_null(0).to_numpy(zero_copy_only=False)[:, None]
        all_ = asked.column("cutoff").is_null().to_numpy(zero_copy_only=False)[:, None]
        reached = [(parts * s >= cutoff) | all_ for s in local]
        row, col = np.nonzero(np.logical_or.reduce(reached))
        known, mask = np.zeros(len(row), np.int64), np.zeros(len(row), np.int32)
        for i, (s, r) in enumerate(zip(local, reached, strict=True)):
            own = r[row, col]
            known += np.where(own, s[row, col], 0)
            mask += own.astype(np.int32) << i
        return entries(asked, held, row, col, known=known, mask=mask)

    return of_one_length(run)


def one_of_each(rows: DataFrame, k: int) -> DataFrame:
    """num, v, first and ids: each distinct vector of rows (id, v, d), with the k + 1 smallest of its ids.

    A vector of very many rows is cut down by its parts first, each task giving k + 1 rows of it at most.
    """
    least = lambda df, *by: df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("_n") <= k + 1).drop("_n")
    few = least(least(rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))), "d", "salt").drop("salt"), "d")
    own = few.groupBy("d").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids"))
    return own.select("d", "v", F.get("ids", F.lit(0)).alias("first"), "ids")


def missing(q: Column, x: Column, mask: Column, parts: int) -> Column:
    """The sum of the local scores of the parts whose bits are not set."""
    size = F.size(q)
    begin = lambda i: F.floor(size * i / parts).cast("int")
    product = lambda i: F.aggregate(F.zip_with(*[F.slice(v, begin(i) + 1, begin(i + 1) - begin(i)) for v in (q, x)], lambda a, b: a.cast("long") * b), F.lit(0).cast("long"), lambda t, y: t + y)
    return sum((F.when(mask.bitwiseAND(F.lit(1 << i)) == 0, product(i)).otherwise(F.lit(0).cast("long")) for i in range(parts)), F.lit(0).cast("long"))


def search(rows: DataFrame, asked: DataFrame, k: int = K, parts: int = PARTS) -> DataFrame:
    """query_id, rank, vec_id and score: for each row that asks, the k other rows with the largest inner products.

    rows, asked: id (long) and v (array<int>); each asked row must be among rows. Null ids or vectors take no part; vectors of different
    lengths are not compared; an id's repeated rows with equal vectors are one. Rows with the query's id are its own, whatever their
    vectors. Fewer than k rows are given where there are no more.
    """
    real = lambda df: df.where("id IS NOT NULL AND v IS NOT NULL").withColumn("d", F.sha2(F.array_join("v", ","), 256))
    numbered = one_of_each(real(rows).groupBy("id", "d").agg(F.first("v").alias("v")), k)
    held = cut(numbered.withColumn("num", F.monotonically_increasing_id()))
    queries = cut(real(asked).select("id", "d").distinct().join(held.select("d", "num"), "d").select(F.col("id").alias("query_id"), F.col("num").alias("q")))
    each = held.join(queries.select(F.col("q").alias("num")).distinct(), "num").select("num", "v")
    vectors = held.select("num", "first", "v")
    found, by = "q long, x long, first long", ["num"]
    order = Window.partitionBy("q").orderBy(F.desc("score"), "first", "x")
    ranked = lambda df: df.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)

    gathered = ranked(met(each, vectors, best_lists(k + 1, parts), f"{found}, score long", by, by, ASKED, HELD))
    cutoffs = gathered.where(F.col("n") == k + 1).select(F.col("q").alias("num"), F.col("score").alias("cutoff"))
    told = cut(each.join(cutoffs, "num", "left"))

    met_all = cut(met(told, vectors, beyond(parts), f"{found}, known long, mask int", by, by, ASKED, HELD))
    full = F.col("mask") == (1 << parts) - 1
    second = ranked(met_all.where(full).withColumn("score", F.col("known"))).where(F.col("n") == k + 1).select("q", F.col("score").alias("tight"))
    bounds = told.select(F.col("num").alias("q"), "cutoff").join(second, "q", "left").select("q", "cutoff", F.greatest("cutoff", "tight").alias("tight"))
    unknown = F.lit(parts) - F.bit_count("mask")
    may = F.col("tight").isNull() | F.when(full, F.col("known") >= F.col("tight")).otherwise(parts * F.col("known") + unknown * F.col("cutoff") > parts * F.col("tight"))
    left = met_all.join(bounds, "q").where(may).select("q", "x", "first", "known", "mask")

    side = lambda name, v: held.select(F.col("num").alias(name), F.col("v").alias(v))
    open_ = left.where(~full).join(side("x", "xv"), "x").join(side("q", "qv"), "q")
    resolved = open_.select("q", "x", "first", (F.col("known") + missing(F.col("qv"), F.col("xv"), F.col("mask"), parts)).alias("score"))
    best = ranked(resolved.unionAll(left.where(full).select("q", "x", "first", F.col("known").alias("score"))))

    # (k + 1) vectors of (k + 1) ids at most for each query vector
    lists = best.select("q", "x", "score").join(held.select(F.col("num").alias("x"), "ids"), "x")
    merged = lists.groupBy("q").agg(F.sort_array(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("s"), i.alias("id")))))).alias("all"))
    out = queries.join(merged, "q")
    others = F.slice(F.filter("all", lambda e: e["id"] != F.col("query_id")), 1, k)
    return out.select("query_id", F.posexplode(others).alias("p", "e")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("e.id").alias("vec_id"), (-F.col("e.s")).alias("score"))


def nearest_documents(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """op12: every vector whose id is divisible by 100 against all others."""
    rows = embeddings.select(quoted(key).cast("long").alias("id"), scaled(quoted(vector)).alias("v"))
    return search(rows, rows.where("id % 100 = 0"))


ORACLE_SQL = f"""
WITH rows AS MATERIALIZED (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), scored AS (
  SELECT q.vec_id AS query_id, x.vec_id AS vec_id, list_dot_product(q.v, x.v)::BIGINT AS score
  FROM rows q JOIN rows x ON q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id AND len(q.v) = len(x.v)
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {K}
"""
