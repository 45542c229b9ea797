"""A store of derived tables that is refreshed by partition.

Tables lie in folders by partition; a manifest says which folders count, and for each the digest of its rows and that of what it was made
from. A refresh goes through the tables in the order of their needs, builds the partitions whose inputs changed into new folders, and
at the end writes the next manifest: readers see all of a refresh or none of it, and a refresh that fails leaves what was there. A
partition that was rebuilt to the same rows does not count as changed for what depends on it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest"
ENTRY = "name string, part string, folder string, digest string, inputs string, n long"


@dataclass(frozen=True)
class Derived:
    """A table by name: build gives its rows, with the column part, from tables by name that hold the partitions asked for only.

    needs: tables whose partition of the same name each partition is made from; whole: tables that every partition is made from.
    """

    name: str
    part: str
    build: Callable[[dict[str, DataFrame]], DataFrame]
    needs: tuple[str, ...] = ()
    whole: tuple[str, ...] = ()


def ordered(tables: list[Derived], sources: set[str]) -> list[Derived]:
    """Tables after those they need; ValueError where they need each other or something unknown."""
    out, known, left = [], set(sources), list(tables)
    while left:
        ready = [t for t in left if {*t.needs, *t.whole} <= known]
        if not ready:
            raise ValueError(f"tables need each other or unknown ones: {sorted(t.name for t in left)}")
        out += ready
        known |= {t.name for t in ready}
        left = [t for t in left if t not in ready]
    return out


def digests(rows: DataFrame, part: str) -> dict[str, tuple[str, int]]:
    """Digest and number of rows of each partition, whatever the rows' order: two sums of hashes of whole rows, one for each partition reaches the driver."""
    columns = sorted(rows.columns)
    hashed = lambda seed: F.sum(F.xxhash64(F.lit(seed), *[F.col(c) for c in columns]).cast("decimal(38,0)"))
    found = rows.groupBy(F.col(part).cast("string").alias("part")).agg(F.count(F.lit(1)).alias("n"), hashed(1).alias("a"), hashed(2).alias("b")).collect()
    return {r["part"]: (f"{r['n']}:{r['a']}:{r['b']}", r["n"]) for r in found}


def manifest_path(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """The number and folder of the newest whole manifest; 0 and None where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}")
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(at):
        return 0, None
    numbers = [int(s.getPath().getName()) for s in system.listStatus(at) if system.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return (max(numbers), f"{path}/{MANIFEST}/{max(numbers)}") if numbers else (0, None)


def entries(spark: SparkSession, path: str) -> dict[tuple[str, str], dict]:
    """The manifest: an entry for each table and partition."""
    _, folder = manifest_path(spark, path)
    return {(r["name"], r["part"]): r.asDict() for r in spark.read.schema(ENTRY).parquet(folder).collect()} if folder else {}


def read(spark: SparkSession, path: str, name: str, parts: list[str] | None = None) -> DataFrame:
    """The rows of a table, or of some of its partitions, as the newest manifest has them."""
    return of_entries(spark, path, [e for (n, p), e in entries(spark, path).items() if n == name and (parts is None or p in parts)], name)


def of_entries(spark: SparkSession, path: str, held: list[dict], name: str) -> DataFrame:
    if not held:
        raise ValueError(f"the store has no rows of {name}")
    return spark.read.parquet(*[f"{path}/{e['folder']}" for e in held])


def refresh(spark: SparkSession, path: str, sources: dict[str, tuple[DataFrame, str]], tables: list[Derived]) -> list[tuple[str, str, str]]:
    """Brings the store at path up to date with sources (name: rows and partition column): (table, partition, state), state one of written, kept, removed."""
    number, _ = manifest_path(spark, path)
    old = entries(spark, path)
    new: dict[tuple[str, str], dict] = {}
    report: list[tuple[str, str, str]] = []
    known = {name: digests(rows, part) for name, (rows, part) in sources.items()}
    for t in ordered(tables, set(sources)):
        parts = sorted(set().union(*[known[n].keys() for n in t.needs])) if t.needs else ["all"]
        shared = "|".join(f"{n}={sorted(known[n].items())}" for n in t.whole)
        inputs = {p: str(hash_of("|".join(f"{n}={known[n].get(p, ('', 0))[0]}" for n in t.needs) + "|" + shared)) for p in parts}
        stale = [p for p in parts if old.get((t.name, p), {}).get("inputs") != inputs[p]]
        for p in parts:
            if p not in stale:
                new[t.name, p] = old[t.name, p]
        if stale:
            def rows_of(n: str, narrow: bool) -> DataFrame:
                if n in sources:
                    rows, part = sources[n]
                    return rows.where(F.col(part).cast("string").isin(stale)) if narrow else rows
                return of_entries(spark, path, [e for (m, p), e in new.items() if m == n and (not narrow or p in stale)], n)

            built = t.build({n: rows_of(n, True) for n in t.needs} | {n: rows_of(n, False) for n in t.whole})
            folder = f"{t.name}/{uuid.uuid4().hex}"
            built.withColumn("_part", F.col(t.part).cast("string") if t.needs else F.lit("all")).repartition("_part").write.partitionBy("_part").parquet(f"{path}/{folder}")
            made = digests(spark.read.option("basePath", f"{path}/{folder}").schema(f"{built._jdf.schema().toDDL()}, _part string").parquet(f"{path}/{folder}"), "_part")
            for p in stale:
                digest, n = made.get(p, ("0", 0))
                if n:
                    new[t.name, p] = {"name": t.name, "part": p, "folder": f"{folder}/_part={p}", "digest": digest, "inputs": inputs[p], "n": n}
        report += [(t.name, p, "written" if p in stale else "kept") for p in parts]
        report += [(t.name, p, "removed") for (n, p) in old if n == t.name and p not in parts]
        known[t.name] = {p: (e["digest"], e["n"]) for (n, p), e in new.items() if n == t.name}
    if new != old:
        rows = [tuple(e[c.split()[0]] for c in ENTRY.split(", ")) for e in new.values()]
        spark.createDataFrame(rows, ENTRY).coalesce(1).write.parquet(f"{path}/{MANIFEST}/{number + 1}")
    return report


def hash_of(text: str) -> str:
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


def swept(spark: SparkSession, path: str) -> int:
    """Deletes the folders of all tables that the newest manifest does not name, and older manifests; how many."""
    number, _ = manifest_path(spark, path)
    held = {e["folder"] for e in entries(spark, path).values()}
    fs = spark._jvm.org.apache.hadoop.fs.Path
    system, gone = fs(path).getFileSystem(spark._jsc.hadoopConfiguration()), 0
    for table in system.listStatus(fs(path)):
        for made in system.listStatus(table.getPath()):
            name = f"{table.getPath().getName()}/{made.getPath().getName()}"
            if table.getPath().getName() == MANIFEST:
                if made.getPath().getName() != str(number):
                    gone += system.delete(made.getPath(), True)
                continue
            for part in system.listStatus(made.getPath()):
                if f"{name}/{part.getPath().getName()}" not in held and not part.getPath().getName().startswith("_SUCCESS"):
                    gone += system.delete(part.getPath(), True)
    return gone
