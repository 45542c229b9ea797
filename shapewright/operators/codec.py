"""Compressed blobs: one for each entity, of 16-bit values as modular deltas, their low bytes before their high ones, gzip over all.

A blob holds an entity's rows in order of time. The first row is as it is, each later one the difference to the one before, modulo
2**16; the bytes of a matrix of n rows and k columns are its n * k low bytes followed by its n * k high ones. There is no header but
gzip's own: rows, width and times stand beside the blob, and a blob of another length is refused. Decoding is a running sum modulo 2**16.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAGIC = b"\x1f\x8b"
"""The first two bytes of a gzip stream."""
LAYOUTS = ("raw", "delta", "zigzag", "transposed")
PACKED = "entity int, years array<int>, width int, blob binary"


def deltas(u: np.ndarray) -> np.ndarray:
    """Modular differences of a uint16 matrix along its rows; the first row as it is."""
    return np.concatenate((u[:1], u[1:] - u[:-1]))


def transposed(d: np.ndarray) -> bytes:
    """All low bytes, then all high ones."""
    return d.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def zigzag(d: np.ndarray) -> np.ndarray:
    """Differences as signed values, small ones of either sign as small unsigned ones."""
    s = d.astype(np.int16).astype(np.int32)
    return ((s << 1) ^ (s >> 31)).astype(np.uint16)


def compressed(data: bytes) -> bytes:
    """gzip without a time, so that equal values have equal bytes."""
    return gzip.compress(data, 9, mtime=0)


def inflated(blob: bytes) -> bytes:
    """A blob's bytes; those without gzip's first two bytes are taken as they are."""
    return gzip.decompress(blob) if blob[:2] == MAGIC else blob


def encode(u: np.ndarray) -> bytes:
    return compressed(transposed(deltas(u)))


def decode(blob: bytes, rows: int, width: int) -> np.ndarray:
    """The uint16 matrix of a blob; ValueError where its length is not that of so many rows and columns."""
    raw = np.frombuffer(inflated(blob), np.uint8)
    if len(raw) != 2 * rows * width:
        raise ValueError(f"a blob of {len(raw)} bytes does not hold {rows} rows of {width} values")
    low, high = raw.reshape(2, -1).astype(np.uint16)
    return np.cumsum((low | high << 8).reshape(rows, width), axis=0, dtype=np.uint16)


def layouts(u: np.ndarray) -> list[bytes]:
    """The bytes of each of LAYOUTS before compression."""
    d = deltas(u)
    return [u.astype("<u2").tobytes(), d.astype("<u2").tobytes(), zigzag(d).astype("<u2").tobytes(), transposed(d)]


def trajectories(rows: DataFrame) -> DataFrame:
    """entity and its rows in order of year, of rows (entity, year, u); an entity has one row a year."""
    return rows.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("year", "u"))).alias("rows"))


def matrix_of(row: list[dict]) -> tuple[list[int], np.ndarray]:
    """Years and values of a trajectory; ValueError for repeated years, rows of several widths, or values beyond 16 bits."""
    years, values = [r["year"] for r in row], [r["u"] for r in row]
    if len(set(years)) < len(years) or len({len(v) for v in values}) > 1:
        raise ValueError("a trajectory has a year twice or rows of several widths")
    whole = np.array(values, np.int64).reshape(len(years), -1)
    if whole.size and not 0 <= whole.min() <= whole.max() < 1 << 16:
        raise ValueError("a value does not fit 16 bits")
    return years, whole.astype(np.uint16)


def pack(rows: DataFrame) -> DataFrame:
    """entity, years, width and blob of rows (entity, year, u); a group is one entity's years."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                years, u = matrix_of(r["rows"])
                yield pa.RecordBatch.from_arrays([pa.array([r["entity"]], pa.int32()), pa.array([years], pa.list_(pa.int32())), pa.array([u.shape[1]], pa.int32()), pa.array([encode(u)], pa.binary())], names=["entity", "years", "width", "blob"])

    return trajectories(rows).mapInArrow(run, PACKED)


def unpack(packed: DataFrame) -> DataFrame:
    """entity, year, u: the exact rows that pack() was given. No row is moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                u = decode(r["blob"], len(r["years"]), r["width"])
                yield pa.RecordBatch.from_arrays([pa.array([r["entity"]] * len(u), pa.int32()), pa.array(r["years"], pa.int32()), pa.array(u.tolist(), pa.list_(pa.int32()))], names=["entity", "year", "u"])

    return packed.mapInArrow(run, "entity int, year int, u array<int>")


def layout_report(rows: DataFrame) -> DataFrame:
    """entity, layout, n_bytes, low_sum and high_sum (sums of the bytes at even and odd places, or of the first and second half if transposed), n_compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                out = []
                for name, data in zip(LAYOUTS, layouts(matrix_of(r["rows"])[1]), strict=True):
                    whole = np.frombuffer(inflated(compressed(data)), np.uint8).astype(np.int64)
                    low, high = whole.reshape(2, -1) if name == "transposed" else whole.reshape(-1, 2).T
                    out.append((r["entity"], name, len(whole), int(low.sum()), int(high.sum()), len(compressed(data))))
                kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["entity", "layout", "n_bytes", "low_sum", "high_sum", "n_compressed"])

    return trajectories(rows).mapInArrow(run, "entity int, layout string, n_bytes long, low_sum long, high_sum long, n_compressed long")


def write_packed(rows: DataFrame, path: str, parts: int = 8) -> None:
    """Blobs in Parquet files that are sorted by entity, so that a reader of one entity skips the others' row groups."""
    pack(rows).repartitionByRange(parts, "entity").sortWithinPartitions("entity").write.mode("overwrite").parquet(path)


def read_packed(spark: SparkSession, path: str, entities: list[int] | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """entity, year, u of all or some entities and years; only the blobs of the entities asked for are read."""
    packed = spark.read.parquet(path)
    if entities is not None:
        packed = packed.where(F.col("entity").isin(entities))
    if first is not None or last is not None:
        packed = packed.where((F.array_max("years") >= (first if first is not None else -9999)) & (F.array_min("years") <= (last if last is not None else 9999)))
    out = unpack(packed)
    return out.where(F.col("year").between(first if first is not None else -9999, last if last is not None else 9999))


def to_half(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with name, the column's doubles or floats as little-endian half floats, two bytes each; a null list stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [None if v is None else np.array(v, np.float64).astype("<f2").tobytes() for v in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.binary())], names=[*b.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.BinaryType())]))


def from_half(df: DataFrame, column: str, name: str, width: int) -> DataFrame:
    """df with name, the array of a column of half floats; ValueError where a value does not hold width of them."""

    def values(x: bytes | None) -> list[float] | None:
        if x is not None and len(x) != 2 * width:
            raise ValueError(f"{len(x)} bytes do not hold {width} half floats")
        return None if x is None else np.frombuffer(x, "<f2").astype(np.float64).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([values(x) for x in b.column(column).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, new], names=[*b.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))
