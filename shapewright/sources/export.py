"""Files of a bounded size that describe themselves: a header in JSON, which holds the file's own size, followed by arrays of numbers.

A partition is one file. Its size is part of its header and so of itself: it is found as the fixed point of its own number of digits.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILES = "part string, name string, n_bytes long, blob binary"
KINDS = {"double": "<f8", "float": "<f4", "int": "<i4", "bigint": "<i8", "smallint": "<i2"}


def packed(header: dict, arrays: dict[str, np.ndarray]) -> bytes:
    """Length of the header as 4 bytes, the header, the arrays. The header gets arrays (name, kind, length of each) and size, the bytes of all."""
    data = b"".join(a.tobytes() for a in arrays.values())
    described = header | {"arrays": [[n, a.dtype.str, len(a)] for n, a in arrays.items()]}
    size = 0
    while True:  # the size grows by digits only, so this ends
        text = json.dumps(described | {"size": size}, separators=(",", ":")).encode()
        whole = 4 + len(text) + len(data)
        if whole == size:
            return len(text).to_bytes(4, "little") + text + data
        size = max(whole, size + 1) if whole < size else whole


def unpacked(blob: bytes) -> tuple[dict, dict[str, np.ndarray]]:
    """Header and arrays of a file; ValueError where it is not as long as it says."""
    n = int.from_bytes(blob[:4], "little")
    header = json.loads(blob[4 : 4 + n])
    if header["size"] != len(blob):
        raise ValueError(f"a file of {len(blob)} bytes says it has {header['size']}")
    at, out = 4 + n, {}
    for name, kind, length in header["arrays"]:
        out[name] = np.frombuffer(blob, kind, length, at)
        at += out[name].nbytes
    return header, out


def exported(rows: DataFrame, part: str, order: list[str], columns: list[str], title: str, forbidden: str | None = None) -> DataFrame:
    """part, name, n_bytes and blob: one file for each partition of rows, with the columns as arrays in the order given; null numbers become NaN or the least integer.

    A file's name holds the first eight digits of its sha256. forbidden: a pattern that no header may match; ValueError names the part.
    A partition is a file, so it must fit a worker; budgets() tells those that are larger than wanted.
    """
    kinds = dict(rows.dtypes)
    wanted = {c: KINDS[kinds[c]] for c in columns}
    never = re.compile(forbidden, re.I) if forbidden else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                own = pa.RecordBatch.from_struct_array(b.column("rows")[i].values)
                arrays = {}
                for c, kind in wanted.items():
                    column = own.column(c)
                    empty = float("nan") if kind in ("<f8", "<f4") else int(np.iinfo(kind).min)
                    arrays[c] = column.fill_null(pa.scalar(empty, column.type)).to_numpy(zero_copy_only=False).astype(kind)
                key = b.column("part")[i].as_py()
                blob = packed({"title": title, "part": key, "rows": own.num_rows}, arrays)
                if never and never.search(blob[4 : 4 + int.from_bytes(blob[:4], "little")].decode()):
                    raise ValueError(f"the header of part {key} has a text that must not be exported")
                name = f"{title}.{hashlib.sha256(blob).hexdigest()[:8]}"
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([name]), pa.array([len(blob)], pa.int64()), pa.array([blob], pa.binary())], names=["part", "name", "n_bytes", "blob"])

    listed = rows.groupBy(F.col(part).cast("string").alias("part")).agg(F.sort_array(F.collect_list(F.struct(*order, *[c for c in columns if c not in order]))).alias("rows"))
    return listed.mapInArrow(run, FILES)


def opened(files: DataFrame, columns: dict[str, str]) -> DataFrame:
    """part, place and the columns (name: kind) of files' blobs."""
    schema = "part string, place int, " + ", ".join(f"{c} {k}" for c, k in columns.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, blob in zip(b.column("part").to_pylist(), b.column("blob").to_pylist(), strict=True):
                header, arrays = unpacked(blob)
                yield pa.RecordBatch.from_arrays([pa.array([key] * header["rows"], pa.string()), pa.array(range(header["rows"]), pa.int32()), *[pa.array(arrays[c]) for c in columns]], names=["part", "place", *columns])

    return files.mapInArrow(run, schema)


def violations(files: DataFrame, limit: Column, total: int | None = None) -> DataFrame:
    """what, n_bytes and allowed of every file larger than its limit, and of all together (`total`) where they are more than total."""
    over = files.where(F.col("n_bytes") > limit).select(F.concat(F.lit("part "), "part").alias("what"), "n_bytes", limit.cast("long").alias("allowed"))
    if total is None:
        return over
    all_ = files.agg(F.sum("n_bytes").alias("n_bytes")).where(F.col("n_bytes") > total)
    return over.unionByName(all_.select(F.lit("total").alias("what"), "n_bytes", F.lit(total).cast("long").alias("allowed")))
