"""Principal axes of vectors: moments by Spark, eigenvectors of one small matrix, projections where the rows lie."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import matrix

BATCH, STRIP = 1024, 128


@dataclass
class Axes:
    """mean [dim], variances from the largest on, and their axes [dim, k], each with its largest component positive; total: all variance."""

    mean: np.ndarray
    variances: np.ndarray
    axes: np.ndarray
    total: float
    n: int

    @property
    def shares(self) -> np.ndarray:
        """Shares of variance up to each axis."""
        return np.cumsum(self.variances) / self.total if self.total else np.ones(len(self.variances))


def moments(df: DataFrame, column: str, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """How many vectors, their sum and the sum of their products: a task gives one matrix, dim * dim numbers reach the driver.

    Vectors that are null, of another length, or hold a null or a value that is not finite take no part.
    """
    fits = (F.size(column) == dim) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, gram = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                x = matrix(b.column("v").slice(at, BATCH))
                n, total, gram = n + len(x), total + x.sum(axis=0), gram + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([np.concatenate((total, gram.ravel())).tolist()], pa.list_(pa.float64()))], names=["n", "sums"])

    parts = df.where(fits).select(F.col(column).cast("array<double>").alias("v")).mapInArrow(run, "n long, sums array<double>")
    rows = parts.select("n", F.posexplode("sums").alias("p", "x")).groupBy("p").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
    flat = np.zeros(dim + dim * dim)
    for r in rows:
        flat[r["p"]] = r["x"]
    return (rows[0]["n"] if rows else 0), flat[:dim], flat[dim:].reshape(dim, dim)


def fitted(df: DataFrame, column: str, dim: int, k: int) -> Axes:
    n, total, gram = moments(df, column, dim)
    if not n:
        raise ValueError("there are no vectors")
    mean = total / n
    values, vectors = np.linalg.eigh((gram - n * np.outer(mean, mean)) / max(n - 1, 1))
    order = np.argsort(-values, kind="stable")[:k]
    axes = vectors[:, order]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    return Axes(mean, np.maximum(values[order], 0), axes, float(np.maximum(values, 0).sum()), n)


def projected(df: DataFrame, column: str, axes: Axes, name: str) -> DataFrame:
    """df with name, the coordinates of a vector along the axes; null where it is null or of another length. No row is moved."""
    dim = len(axes.mean)
    shared = df.sparkSession.sparkContext.broadcast((axes.mean, axes.axes))  # dim * (k + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, vectors = shared.value
        for b in batches:
            good = [v is not None and len(v) == dim and None not in v for v in b.column(column).to_pylist()]
            x = matrix(b.column(column).filter(pa.array(good))) if any(good) else np.zeros((0, dim))
            found = iter(((x - mean) @ vectors).tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([next(found) if g else None for g in good], pa.list_(pa.float64()))], names=[*b.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))


def self_ranks(variants: DataFrame, gallery: DataFrame) -> DataFrame:
    """id and rank: how many of the gallery are at least as near to a variant (id, v) as its own original is, itself counted; both: id, v.

    Distances are cosine ones to nine places. A block gives the number of nearer ones, so no distance is kept.
    """
    from .blocks import met

    own = variants.join(gallery.select("id", F.col("v").alias("o")), "id")

    def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.round(1 - (a @ b.T) / (np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1))[None, :] + 1e-12), 9)

    def nearer(asked: pa.RecordBatch, held: pa.RecordBatch) -> pa.RecordBatch:
        v, o, g = matrix(asked.column("v")), matrix(asked.column("o")), matrix(held.column("v"))
        mine = np.array([cosine(v[i : i + 1], o[i : i + 1])[0, 0] for i in range(len(v))])
        ids, others = asked.column("id").to_numpy(), held.column("id").to_numpy()
        strips = [slice(at, at + STRIP) for at in range(0, len(v), STRIP)]
        n = np.concatenate([((cosine(v[s], g) < mine[s, None]) & (others[None, :] != ids[s, None])).sum(axis=1) for s in strips])
        return pa.RecordBatch.from_arrays([asked.column("id"), pa.array(n, pa.int64())], names=["id", "n"])

    return met(own, gallery.select("id", "v"), nearer, "id long, n long", ["id"], ["id"]).groupBy("id").agg((F.sum("n") + 1).alias("rank"))
