"""Choice of triplets for a comparison of metrics: an anchor and two candidates on which two metrics differ.

Every choice is by hash, so that it is the same however rows are dealt out. Items are chosen in rounds: each pair of metrics proposes as
many anchors as it may still need, an anchor goes to one of the pairs that propose it, and pairs that were used least go first. A round is
a few windows over the disagreements left, and leaves the pairs evenly used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import matrix, met
from .corpus import WIDTH
from .metrics import SIGMA
from .stats import uniform_of

METRICS = ("l2", "w1sex", "blend", "hel", "cos")
EXTREMES = "entity int, metric string, far boolean, b_entity int, b_year int, d double"


def distances(asked: pa.RecordBatch, held: pa.RecordBatch) -> dict[str, np.ndarray]:
    """All METRICS between the rows of two blocks, to nine places."""
    s, bs = matrix(asked.column("s")), matrix(held.column("s"))
    c, bc = matrix(asked.column("c")), matrix(held.column("c"))
    shape = (len(s), len(bs))
    squares, moved, roots = np.zeros(shape), np.zeros(shape), np.zeros(shape)
    for j in range(s.shape[1]):
        squares += (s[:, j, None] - bs[None, :, j]) ** 2
        moved += np.abs(c[:, j, None] - bc[None, :, j])
        roots += (np.sqrt(s[:, j, None]) - np.sqrt(bs[None, :, j])) ** 2
    l2, w1 = np.sqrt(squares), WIDTH * moved
    cos = 1 - (s @ bs.T) / (np.sqrt((s * s).sum(axis=1))[:, None] * np.sqrt((bs * bs).sum(axis=1))[None, :] + 1e-12)
    found = {"l2": l2, "w1sex": w1, "blend": 0.5 * l2 / SIGMA["l2"] + 0.5 * w1 / SIGMA["w1sex"], "hel": np.sqrt(roots) / np.sqrt(2), "cos": cos}
    return {n: np.round(d, 9) for n, d in found.items()}


def extremes(anchors: DataFrame, profiles: DataFrame) -> DataFrame:
    """For each anchor (one row an entity) and metric the nearest and the farthest profile of another entity, ties to the smaller entity and year."""

    def best(asked: pa.RecordBatch, held: pa.RecordBatch) -> pa.RecordBatch:
        held = held.take(pa.array(np.lexsort((held.column("year").to_numpy(), held.column("entity").to_numpy()))))
        entity, b_entity, b_year = asked.column("entity").to_numpy(), held.column("entity").to_numpy(), held.column("year").to_numpy()
        out: dict[str, list] = {n: [] for n in ("entity", "metric", "far", "b_entity", "b_year", "d")}
        for name, d in distances(asked, held).items():
            for far in (False, True):
                cost = np.where(b_entity[None, :] == entity[:, None], np.inf, -d if far else d)
                at = cost.argmin(axis=1)
                for i in np.flatnonzero(np.isfinite(cost.min(axis=1))):
                    for n, v in zip(out, (entity[i], name, far, b_entity[at[i]], b_year[at[i]], d[i, at[i]]), strict=True):
                        out[n].append(v)
        kinds = (pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    columns = ["entity", "year", "s", "c"]
    parts = met(anchors.select(columns), profiles.select(columns), best, EXTREMES, ["entity"], ["entity", "year"], 256, 2048)
    order = F.struct(F.when(F.col("far"), -F.col("d")).otherwise(F.col("d")).alias("x"), "b_entity", "b_year")
    return parts.groupBy("entity", "metric", "far").agg(F.min_by(F.struct("b_entity", "b_year", "d"), order).alias("m")).select("entity", "metric", "far", "m.*")


def disagreements(found: DataFrame, strata: dict[str, tuple[bool, list[tuple[str, str]]]]) -> DataFrame:
    """stratum, entity, m1, m2 and both candidates, where two metrics' extremes differ. strata: whether farthest, and pairs of metrics."""
    wanted = F.array(*[F.struct(F.lit(s).alias("stratum"), F.lit(far).alias("far"), F.lit(a).alias("m1"), F.lit(b).alias("m2")) for s, (far, pairs) in strata.items() for a, b in pairs])
    asked = found.select("entity").distinct().select("entity", F.inline(wanted))
    side = lambda k: found.select("entity", F.col("metric").alias(f"m{k}"), "far", F.col("b_entity").alias(f"e{k}"), F.col("b_year").alias(f"y{k}"))
    both = asked.join(side(1), ["entity", "m1", "far"]).join(side(2), ["entity", "m2", "far"])
    return both.where((F.col("e1") != F.col("e2")) | (F.col("y1") != F.col("y2"))).select("stratum", "entity", "m1", "m2", "e1", "y1", "e2", "y2")


def round_of(rows: DataFrame, uses: DataFrame, need: int, pairs: int) -> DataFrame:
    """Up to need of rows (entity, m1, m2, h, ...), one for each entity, pairs used least (uses: m1, m2, n) first."""
    w = Window.partitionBy("m1", "m2").orderBy("h", "entity")
    offers = rows.join(uses, ["m1", "m2"], "left").withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= -(-need // pairs)).withColumn("turn", F.col("turn") + F.coalesce("n", F.lit(0))).drop("n")
    one = offers.withColumn("k", F.row_number().over(Window.partitionBy("entity").orderBy("turn", "h", "m1", "m2"))).where("k = 1").drop("k")
    return one.orderBy("turn", "h", "m1", "m2").limit(need).drop("turn")


def chosen(rows: DataFrame, quotas: dict[str, int], pairs: dict[str, int], rounds: int, seed: int) -> DataFrame:
    """Items of all strata, in their order: no entity twice, quotas filled as far as so many rounds find disagreements.

    What is chosen in a round is kept: quotas are small and do not grow with the corpus.
    """
    spark, out = rows.sparkSession, None
    hashed = rows.withColumn("h", uniform_of(F.lit(seed), F.col("stratum"), F.col("entity"), F.col("m1"), F.col("m2"))).persist()
    taken: set[int] = set()
    for stratum, quota in quotas.items():
        uses: dict[tuple[str, str], int] = {}
        for _ in range(rounds):
            need = quota - sum(uses.values())
            if need <= 0:
                break
            used = spark.createDataFrame([(*p, n) for p, n in uses.items()], "m1 string, m2 string, n int")
            left = hashed.where(F.col("stratum") == stratum).join(spark.createDataFrame([(e,) for e in sorted(taken)], "entity int"), "entity", "left_anti")
            new = round_of(left, used, need, pairs[stratum]).select(hashed.columns).collect()  # need rows at most
            for r in new:
                uses[r["m1"], r["m2"]] = uses.get((r["m1"], r["m2"]), 0) + 1
                taken.add(r["entity"])
            got = spark.createDataFrame(new, hashed.schema)
            out = got if out is None else out.unionAll(got)
    hashed.unpersist()
    return rows.withColumn("h", F.lit(0.0)).limit(0) if out is None else out


def sequence(items: DataFrame, repeats: int, gap: int, seed: int) -> DataFrame:
    """items with item (their place), duplicate_of and left (which candidate stands left): repeats of each stratum come again, swapped, gap places later at least.

    Only items with gap items behind them are repeated.
    """
    draw = lambda name: uniform_of(F.lit(seed), F.lit(name), F.col("stratum"), F.col("entity"))
    n = items.agg(F.count(F.lit(1))).scalar()
    placed = items.withColumn("at", (F.row_number().over(Window.orderBy(draw("place"), "stratum", "entity")) - 1).cast("double")).withColumn("left", F.when(draw("side") < 0.5, "A").otherwise("B"))  # as many rows as there are items
    w = Window.partitionBy("stratum").orderBy(draw("repeat"), "entity")
    again = placed.where(F.col("at") < n - gap).withColumn("k", F.row_number().over(w)).where(F.col("k") <= repeats).drop("k")
    again = again.withColumns({"first": F.col("at"), "at": F.col("at") + gap + F.floor(draw("later") * (n - gap - F.col("at"))) - 0.5, "left": F.when(F.col("left") == "A", "B").otherwise("A")})
    all_ = placed.withColumn("first", F.lit(None).cast("double")).unionByName(again)
    numbered = all_.withColumn("item", (F.row_number().over(Window.orderBy("at", "stratum", "entity")) - 1).cast("int"))
    origin = numbered.where("first IS NULL").select(F.col("at").alias("first"), F.col("item").alias("duplicate_of"))
    return numbered.join(origin, "first", "left").drop("first", "at")


def answered(items: DataFrame, prefers: Column, noise: float, ties: float, seed: int) -> DataFrame:
    """items with choice: what a synthetic rater says who prefers a candidate (A, B or null), flips and ties at the rates given, and flips what it says of repeats."""
    draw = lambda name: uniform_of(F.lit(seed), F.lit(name), F.col("stratum"), F.col("entity"))
    flip = lambda c: F.when(c == "A", "B").when(c == "B", "A").otherwise(c)
    first = F.when(prefers.isNull() | (draw("tie") < ties), "tie").otherwise(F.when(draw("flip") < noise, flip(prefers)).otherwise(prefers))
    return items.withColumn("choice", F.when(F.col("duplicate_of").isNotNull() & (draw("again") < noise), flip(first)).otherwise(first))
