"""All rows that ask against all rows that are held, block by block in the executors.

Both sides are dealt into blocks of a bounded number of rows by a hash, and the blocks of each side into groups. A pair of groups is one
key of a join, so what is held is sent as often as there are groups that ask, and what asks as often as there are groups that are held.
There are as many pairs of groups as keep the cores busy, however many rows there are, and groups are cut so that both sides send about
as many rows, but so that no group that asks has more than a bounded number of blocks. Inside a pair every block of one side meets every
block of the other: rows reach a worker one by one, those that ask first; it keeps these and reads what is held block by block. So its
memory does not grow with the tables. Nothing comes to the driver and nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASKED, HELD = 1024, 8192
"""Rows of a block that asks, and of one that is held."""
SPREAD = 2
"""Pairs of groups for each core, about."""
KEPT = 16
"""Blocks that ask of one group, about: a worker keeps them while it reads what is held."""
SIDES = ("asked", "held")

Compare = Callable[[pa.RecordBatch, pa.RecordBatch], pa.RecordBatch | None]


def grid(n_asked: Column, n_held: Column, asked_rows: int, held_rows: int, pairs: int) -> dict[str, Column]:
    """Numbers of groups and blocks of both sides, as columns.

    For g groups held and h that ask, g * n_asked + h * n_held rows are sent; with g * h pairs that is least where g / h is n_held / n_asked.
    """
    many = F.greatest(n_asked, n_held) > 0
    wide = F.ceil(F.sqrt(F.lit(float(pairs)) * n_held / F.greatest(n_asked, F.lit(1))))
    held = F.when(many, F.least(F.greatest(wide, F.lit(1)), F.greatest(n_held, F.lit(1)))).otherwise(1)
    asked = F.least(F.greatest(F.ceil(F.lit(float(pairs)) / held), F.lit(1)), F.greatest(n_asked, F.lit(1)))
    blocks = lambda n, size, groups: F.greatest(groups, F.ceil(n / F.lit(size)))
    out = {"held_groups": held, "asked_groups": asked, "held_blocks": blocks(n_held, held_rows, held), "asked_blocks": blocks(n_asked, asked_rows, asked)}
    return {k: v.cast("int") for k, v in out.items()}


def dealt(rows: DataFrame, by: list[str], sizes: DataFrame, name: str, other: str) -> DataFrame:
    """name, a row as a struct, at, its block, name_group, and other_group, one row for each group of the other side, with asked_groups."""
    at = F.pmod(F.xxhash64(*by), F.col(f"{name}_blocks")).cast("int")
    listed = rows.select(F.struct(*rows.columns).alias(name), *by).join(F.broadcast(sizes)).select(name, at.alias("at"), "asked_groups", f"{name}_groups", f"{other}_groups")
    return listed.select(name, "at", "asked_groups", F.pmod(F.col("at"), F.col(f"{name}_groups")).alias(f"{name}_group"), F.explode(F.sequence(F.lit(0), F.col(f"{other}_groups") - 1)).alias(f"{other}_group"))


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Pair of groups, side and rows of each block in turn; rows of a block follow each other, over batches too."""
    parts, last = [], None
    for b in batches:
        marks = np.stack([b.column(c).to_numpy() for c in ("pair", "side", "at")], axis=1)
        cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
        for start, end in pairwise([0, *cuts.tolist(), len(marks)] if len(marks) else []):
            mark = tuple(marks[start].tolist())
            if parts and mark != last:
                yield *last[:2], pa.RecordBatch.from_struct_array(pa.concat_arrays(parts))
                parts = []
            parts.append(b.column(SIDES[mark[1]]).slice(start, end - start))
            last = mark
    if parts:
        yield *last[:2], pa.RecordBatch.from_struct_array(pa.concat_arrays(parts))


def met(asked: DataFrame, held: DataFrame, compare: Compare, schema: T.StructType | str, asked_by: list[str], held_by: list[str], asked_rows: int = ASKED, held_rows: int = HELD) -> DataFrame:
    """What compare(block that asks, block that is held) gives for every pair of blocks.

    Rows are dealt by a hash of the columns named, which should tell rows apart: equal rows fall into one block.
    """
    pairs = SPREAD * asked.sparkSession.sparkContext.defaultParallelism
    count = lambda rows, name: rows.agg(F.count(F.lit(1)).alias(name))
    counts = count(asked, "n_asked").join(count(held, "n_held"))  # one row
    sizes = counts.select(*[c.alias(n) for n, c in grid(F.col("n_asked"), F.col("n_held"), asked_rows, held_rows, pairs).items()])
    sizes = sizes.withColumn("asked_groups", F.greatest("asked_groups", F.ceil(F.col("asked_blocks") / F.lit(KEPT)).cast("int")))
    sides = dealt(asked, asked_by, sizes, "asked", "held").withColumn("side", F.lit(0)), dealt(held, held_by, sizes, "held", "asked").withColumn("side", F.lit(1))
    pair = F.col("held_group").cast("long") * F.col("asked_groups") + F.col("asked_group")
    both = sides[0].unionByName(sides[1], allowMissingColumns=True).select(pair.alias("pair"), F.col("side").cast("long").alias("side"), F.col("at").cast("long").alias("at"), *SIDES)
    both = both.repartitionById(pairs, F.pmod(F.col("pair"), F.lit(pairs)).cast("int")).sortWithinPartitions("pair", "side", "at")
    own = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking, now = [], None
        for at, side, rows in blocks_of(batches):
            if at != now:
                asking, now = [], at
            if side == 0:
                asking.append(rows)
                continue
            for block in asking:
                out = compare(block, rows)
                if out is not None and out.num_rows:
                    yield out

    return both.mapInArrow(run, own)


def matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    """Rows of a column of lists that are equally long."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))
