"""Lloyd's clustering with two trees.

Vectors are kept in blocks, each with a cover tree that is built once: a node's children cover its points within half its radius and
their centres lie further apart than that. Each round builds a cover tree over the centroids and walks both trees together. A pair of
nodes is dropped where its least possible distance is beyond the largest possible one of another pair of the same vector node; where
one centroid is left, the whole vector node is assigned to it. Leaf pairs that are left are compared exactly, ties to the smaller number.

Components are integers, so distances, sums and the floors of means are exact. A round gives one sum for each task and centroid; the
driver holds k centroids. The blocks are kept in the shared folder, so that a lost executor costs its part of one round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, quoted

DIM, CLUSTERS, ROUNDS = 64, 8, 10
SCALE = 1024
BLOCK = 1024
"""Vectors of a block, which has a tree of its own."""
LEAF = 4
"""Vectors of a node that has no children, unless they are all equal."""
PAIRS = 1 << 15
"""Pairs of nodes or points whose distances are computed at once."""
LARGEST = 1 << 26
"""Vectors with a scaled component beyond this take no part; within it squared distances in 64 dimensions fit 64 bits."""
EXACT_IN_DOUBLE = 1 << 22
"""Components up to this have squared distances in 64 dimensions below 2**53."""


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of a to those of b, which may be one row."""
    gap = a - b
    return np.einsum("ij,ij->i", gap, gap)


def between(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact squared distances of pairs of rows."""
    parts = [squares(a[i[k : k + PAIRS]], b[j[k : k + PAIRS]]) for k in range(0, len(i), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


@dataclass
class Tree:
    """Nodes level by level over points in an order in which each node's points stand together, its centre first."""

    points: np.ndarray
    order: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first_child: np.ndarray
    last_child: np.ndarray
    radius: np.ndarray

    @classmethod
    def over(cls, points: np.ndarray, leaf: int) -> Tree:
        order, nodes = np.arange(len(points)), [[0, len(points), 0, 0, 0.0]]
        at = 0
        while at < len(nodes):
            begin, end = nodes[at][:2]
            own = order[begin:end].copy()
            away = np.sqrt(squares(points[own], points[own[:1]]).astype(float))
            nodes[at][4] = radius = float(away.max())
            if end - begin > leaf and radius > 0:
                nodes[at][2] = len(nodes)
                while len(own):  # each centre is further than half the radius from all before
                    inside = away <= radius / 2
                    n = int(inside.sum())
                    order[begin : begin + n] = own[inside]
                    nodes.append([begin, begin + n, 0, 0, 0.0])
                    begin, own = begin + n, own[~inside]
                    if len(own):
                        away = np.sqrt(squares(points[own], points[own[:1]]).astype(float))
                nodes[at][3] = len(nodes)
            at += 1
        table = np.array(nodes)
        whole = table[:, :4].astype(np.int64).T
        return cls(points[order], order, *whole, table[:, 4])


def repeated(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value once for each number from its begin to before its end, and these numbers."""
    n = ends - begins
    return np.repeat(values, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begins, n)


def starts_of(v: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.zeros(0, np.int64)


def nearest(tree: Tree, centres: Tree, number: np.ndarray) -> tuple[np.ndarray, int]:
    """The number of the nearest centroid for each point in the tree's order, and how many distances were computed.

    centres: a tree over distinct centroids with leaves of one; number: the number of each in the tree's order.
    """
    label = np.full(len(tree.points), -1)
    v, c, compared = np.zeros(1, np.int64), np.zeros(1, np.int64), 0
    while len(v):
        d = np.sqrt(between(tree.points, tree.begin[v], centres.points, centres.begin[c]).astype(float))
        compared += len(d)
        spread = tree.radius[v] + centres.radius[c]
        starts = starts_of(v)
        bound = np.minimum.reduceat(d + spread, starts)
        keep = d - spread <= np.repeat(bound * (1 + 1e-9) + 1e-9, np.diff(np.append(starts, len(v))))
        v, c = v[keep], c[keep]
        starts = starts_of(v)
        size = np.diff(np.append(starts, len(v)))
        inner = centres.last_child[c] > centres.first_child[c]
        open_ = np.logical_or.reduceat(inner, starts)
        alone = (size == 1) & ~open_
        _, at = repeated(starts[alone], tree.begin[v[starts[alone]]], tree.end[v[starts[alone]]])
        label[at] = np.repeat(number[centres.begin[c[starts[alone]]]], (tree.end - tree.begin)[v[starts[alone]]])
        leaf = ~alone & ~open_ & (tree.last_child[v[starts]] == tree.first_child[v[starts]])
        group = np.repeat(np.arange(len(starts)), size)
        if leaf.any():
            compared += exactly(tree, centres, number, v[leaf[group]], c[leaf[group]], label)
        # centroid nodes go down first, then vector nodes with all centroids that are left to them
        down = np.flatnonzero(open_[group])
        to = np.where(inner[down], centres.last_child[c[down]], c[down] + 1)
        dv, dc = repeated(v[down], np.where(inner[down], centres.first_child[c[down]], c[down]), to)
        split = np.flatnonzero(~alone & ~open_ & ~leaf)
        owner, kid = repeated(split, tree.first_child[v[starts[split]]], tree.last_child[v[starts[split]]])
        kids, place = repeated(kid, starts[owner], starts[owner] + size[owner])
        v, c = np.concatenate((dv, kids)), np.concatenate((dc, c[place]))
    return label, compared


def exactly(tree: Tree, centres: Tree, number: np.ndarray, v: np.ndarray, c: np.ndarray, label: np.ndarray) -> int:
    """Labels of the points of vector leaves v, each compared with the centroids c that are paired with it; how many distances that took."""
    pair, point = repeated(np.arange(len(v)), tree.begin[v], tree.end[v])
    d = between(tree.points, point, centres.points, centres.begin[c[pair]])
    name = number[centres.begin[c[pair]]]
    order = np.lexsort((name, d, point))
    first = order[starts_of(point[order])]
    label[point[first]] = name[first]
    return len(d)


def centroid_tree(centroids: np.ndarray) -> tuple[Tree, np.ndarray]:
    """A tree over the distinct centroids; of equal ones only the first can win a tie."""
    _, first = np.unique(centroids, axis=0, return_index=True)
    first = np.sort(first)
    tree = Tree.over(centroids[first], 1)
    return tree, first[tree.order]


def scaled(vector: Column, dim: int) -> Column:
    """floor(SCALE * x) of each component; null unless there are dim of them, none null, non-finite or too large."""
    fits = (F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= LARGEST / SCALE))
    return F.when(fits, F.transform(vector, lambda x: F.floor(SCALE * x.cast("double")).cast("int")))


NODES = ("begin", "end", "first_child", "last_child")


def planted(rows: DataFrame, key: str = "key", dim: int = DIM, block: int = BLOCK) -> DataFrame:
    """Blocks of rows (key, v): keys and points in the order of a cover tree over them, and its nodes. No row is moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, block):
                b = whole.slice(at, block)
                points = b.column("v").flatten().to_numpy().reshape(-1, dim).astype(np.int64)
                tree = Tree.over(points, LEAF)
                keys = b.column(key).take(pa.array(tree.order))
                lists = [pa.array([getattr(tree, n).tolist()], pa.list_(pa.int32())) for n in NODES]
                own = [pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([tree.points.astype("<i4").tobytes()], pa.binary()), *lists, pa.array([tree.radius.tolist()], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(own, names=["keys", "points", *NODES, "radius"])

    fields = [T.StructField("keys", T.ArrayType(rows.schema[key].dataType)), T.StructField("points", T.BinaryType()), *[T.StructField(n, T.ArrayType(T.IntegerType())) for n in NODES], T.StructField("radius", T.ArrayType(T.DoubleType()))]
    return rows.select(key, "v").mapInArrow(run, T.StructType(fields))


def trees(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, Tree]]:
    """Keys and tree of each block."""
    for b in batches:
        for i in range(b.num_rows):
            points = np.frombuffer(b.column("points")[i].as_py(), "<i4").reshape(-1, dim).astype(np.int64)
            lists = [b.column(n)[i].values.to_numpy(zero_copy_only=False).astype(np.int64) for n in NODES]
            yield b.column("keys")[i].values, Tree(points, np.arange(len(points)), *lists, b.column("radius")[i].values.to_numpy(zero_copy_only=False))


@dataclass
class Sums:
    """Of each centroid's vectors: how many, the sum of each component, and the sum of squared distances."""

    n: list[int]
    total: list[list[int]]
    inertia: list[int]


def assigned(blocks: DataFrame, centroids: list[list[int]]) -> Sums:
    """Sums by the nearest centroid; k * dim numbers come to the driver."""
    dim, k = len(centroids[0]), len(centroids)
    held = np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, number = centroid_tree(held)
        n, total, inertia = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), [0] * k
        for _, own in trees(batches, dim):
            label, _ = nearest(own, tree, number)
            d = squares(own.points, held[label])
            n += np.bincount(label, minlength=k)
            for j in np.unique(label):
                total[j] += own.points[label == j].sum(axis=0)
                inertia[j] += sum(d[label == j].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(n), pa.array(total.tolist(), pa.list_(pa.int64())), pa.array(map(str, inertia), pa.string())], names=["j", "n", "total", "inertia"])

    found = blocks.mapInArrow(run, "j int, n long, total array<long>, inertia string")
    wide = F.sum(F.col("inertia").cast("decimal(38,0)"))
    rows = {r[0]: r for r in found.groupBy("j").agg(F.sum("n"), wide).collect()}
    sums = found.select("j", F.posexplode("total").alias("p", "x")).groupBy("j", "p").agg(F.sum("x")).collect()
    total = [[0] * dim for _ in range(k)]
    for j, p, x in sums:
        total[j][p] = x
    return Sums([rows[j][1] if j in rows else 0 for j in range(k)], total, [int(rows[j][2]) if j in rows else 0 for j in range(k)])


def chosen(rows: DataFrame, k: int, salt: str = "3:") -> list[list[int]]:
    """The k vectors whose keys, after salt, have the smallest sha256 in lowercase hex; equal ones by their components."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    return [list(r[0]) for r in rows.orderBy(digest, "v").limit(k).select("v").collect()]


def cluster(df: DataFrame, key: str, vector: str, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM) -> DataFrame:
    """The key, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each vector of df that takes part.

    Vectors with another number of components than dim, with null, non-finite or very large ones take no part. Rows with equal or null keys
    are rows like others; a null key counts as an empty text where the first centroids are chosen. With fewer vectors than k there are
    fewer centroids; of equal centroids the first gets all vectors, and one that gets none stays. Other columns are not read. No
    vectors give an empty table.
    """
    rows = df.select(quoted(key).alias("key"), scaled(quoted(vector), dim).alias("v")).where("v IS NOT NULL")
    centroids = chosen(rows, k)
    schema = T.StructType([T.StructField(key, rows.schema["key"].dataType), *[T.StructField(n, kind) for n, kind in (("cluster", T.IntegerType()), ("distance", T.LongType()), ("cluster_inertia", T.LongType()), ("inertia", T.LongType()), ("centroid_sha256", T.StringType()))]])
    if not centroids:
        return df.sparkSession.createDataFrame([], schema)
    blocks = cut(planted(rows, "key", dim))
    for _ in range(rounds):
        sums = assigned(blocks, centroids)
        centroids = [[x // n for x in t] if n else c for c, n, t in zip(centroids, sums.n, sums.total, strict=True)]
    sums = assigned(blocks, centroids)
    held, every = np.array(centroids, np.int64), sum(sums.inertia)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, number = centroid_tree(held)
        for keys, own in trees(batches, dim):
            label, _ = nearest(own, tree, number)
            arrays = [keys, pa.array(label, pa.int32()), pa.array(squares(own.points, held[label])), pa.array([sums.inertia[j] for j in label], pa.int64()), pa.array([every] * len(label), pa.int64()), pa.array([digest[j] for j in label], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return blocks.mapInArrow(run, schema)


def clustered_embeddings(embeddings: DataFrame) -> DataFrame:
    """op11: clusters of all embeddings."""
    return cluster(embeddings, "vec_id", "embedding")


def _sql() -> str:
    """Rounds as chained tables; sums of products of doubles are exact, as all are integers below 2**53."""
    parts = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, v, list_dot_product(v, v) AS vv FROM (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings WHERE len(embedding) = {DIM} AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))))",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS k, v FROM (SELECT * FROM kept ORDER BY sha256('3:' || vec_id), v LIMIT {CLUSTERS}))",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT r, k, vv - 2 * list_dot_product(kept.v, c.v) + list_dot_product(c.v, c.v) AS d FROM kept, c{i} c) GROUP BY r)")
        if i < ROUNDS:
            parts.append(f"m{i} AS MATERIALIZED (SELECT k, list(m ORDER BY p) AS v FROM (SELECT k, p, floor(sum(x) / count(*)) AS m FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM kept JOIN a{i} USING (r)) GROUP BY k, p) GROUP BY k)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (k))")
    digest = "sha256(array_to_string(list_transform(c.v, lambda x: x::BIGINT), ','))"
    return f"WITH {', '.join(parts)} SELECT vec_id, k::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, {digest} AS centroid_sha256 FROM kept JOIN a{ROUNDS} USING (r) JOIN c{ROUNDS} c USING (k)"


ORACLE_SQL = _sql()
