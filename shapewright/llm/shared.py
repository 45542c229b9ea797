"""Helpers that several operators use: passing Arrow batches through Python, and cutting lineage in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 2 << 20
"""Bytes of input that one step of a Python operator handles at once; a single longer row is a step of its own."""


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose values in column hold about limit bytes, at least one row each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    begin = held = 0
    for i, n in enumerate(sizes):
        if i > begin and held + n > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def place_of(df: DataFrame, column: str) -> int:
    """The place of a column, by its exact name or, where there is none, without regard to case."""
    names = df.columns
    same = [i for i, c in enumerate(names) if c == column] or [i for i, c in enumerate(names) if c.lower() == column.lower()]
    if not same:
        raise ValueError(f"there is no column {column}")
    return same[0]


def append_columns(df: DataFrame, column: str, make: Callable[[], Callable[[list], list[pa.Array]]], fields: list[T.StructField]) -> DataFrame:
    """df with new columns computed in Python from one string column, without a shuffle.

    make() is called once in each task and gives a function from a list of values (None for null) to one Arrow array for each
    field. Columns of df that are named like a new field are replaced. All other columns pass through as they are, whatever their
    names: inside, columns go by their places.
    """
    new = {f.name.lower() for f in fields}
    if column.lower() in new:
        raise ValueError(f"{column} is both an input and an output")
    kept = [i for i, c in enumerate(df.columns) if c.lower() not in new]
    names, own = [df.columns[i] for i in kept], f"c{place_of(df, column)}"
    inner = df.toDF(*[f"c{i}" for i in range(len(df.columns))]).select(*[f"c{i}" for i in kept])
    out = [f"o{i}" for i in range(len(fields))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for whole in batches:
            for part in slices(whole, own):
                yield pa.RecordBatch.from_arrays([*part.columns, *step(part.column(own).to_pylist())], names=[*part.schema.names, *out])

    schema = T.StructType([*inner.schema.fields, *[T.StructField(o, f.dataType) for o, f in zip(out, fields, strict=True)]])
    return inner.mapInArrow(run, schema).toDF(*names, *[f.name for f in fields])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def shared_checkpoints(spark: SparkSession) -> None:
    """Uses the folder that the cluster names in spark.checkpoint.dir; a folder of this machine's only in local mode where none is named."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(path)
        spark.conf.set("spark.checkpoint.dir", path)


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def released(df: DataFrame) -> None:
    """Deletes the files of a cut() that nothing reads any more."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        removed(df.sparkSession, file.get())


HEAVY = 10_000
"""A key is heavy if more than one in so many rows have it, so there are fewer than HEAVY heavy keys whatever the data."""


def joined_by_size(rows: DataFrame, small: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with small, which has one row for each key and in size how many rows have it; total is the number of rows.

    Rows of heavy keys meet them by a broadcast of fewer than HEAVY keys, so they are never dealt by their key; the rest is joined by
    the key, and a task's share of one key is at most one in HEAVY of the rows. how: inner, or left_anti for rows without a match.
    """
    heavy = F.col(size) * HEAVY > total
    large, light = F.broadcast(small.where(heavy).drop(size)), small.where(~heavy)
    rest = rows.join(F.broadcast(small.where(heavy).select(key)), key, "left_anti")
    if how == "left_anti":
        return rest.join(light.select(key), key, "left_anti")
    return rows.join(large, key).unionByName(rest.join(light.drop(size), key))


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))  # for workers of this machine
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as Parquet to a new folder in the shared one, and read again; also the folder."""
    spark = df.sparkSession
    shared_checkpoints(spark)
    path = f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
