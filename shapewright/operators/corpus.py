"""Profile corpora: long counts to dense spines, shares, vectors, aggregates, quantised forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vec
from ..session import table

BINS = 10
WIDTH = 5.0
SIDES = ("O", "F")
FULL = 65535
_cells: dict[tuple[str, str], tuple[tuple[tuple[int, int], ...], DataFrame]] = {}


def long_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, year, bin, side, pop: quantities by customer nation, ship year, quantity band and line status.

    Only the columns used are read; lines are summed by order and cell before they meet the customers' nations, so what crosses the
    second join is smaller than the lines.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.year("l_shipdate").alias("year"), F.floor((F.col("l_quantity") - 1) / 5).cast("int").alias("bin"), F.col("l_linestatus").alias("side"), "l_quantity")
    owners = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return lines.join(owners, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("c_nationkey").alias("entity"), "year", "bin", "side").agg(F.sum("l_quantity").alias("pop"))


def dense(counts: DataFrame, bins: int = BINS) -> DataFrame:
    """Every bin and side of every (entity, year) that occurs, absent ones with 0, and pos, the place in the vector.

    One grouping by (entity, year) collects the cells that exist; the absent ones come from an exploded literal, without a join.
    """
    place = F.col("bin") + F.when(F.col("side") == SIDES[1], bins).otherwise(0)
    held = counts.groupBy("entity", "year").agg(F.map_from_entries(F.collect_list(F.struct(place.cast("int").alias("k"), F.col("pop").cast("double").alias("v")))).alias("m"))
    out = held.select("entity", "year", "m", F.explode(F.sequence(F.lit(0), F.lit(2 * bins - 1))).alias("pos"))
    side = F.when(F.col("pos") < bins, SIDES[0]).otherwise(SIDES[1])
    return out.select("entity", "year", (F.col("pos") % bins).cast("int").alias("bin"), side.alias("side"), "pos", F.coalesce(F.try_element_at("m", "pos"), F.lit(0.0)).alias("pop"))


def stamp(spark: SparkSession, sf_dir: str) -> tuple[tuple[int, int], ...]:
    """When the tables of the corpus were changed, and their sizes."""
    out = []
    for name in ("lineitem", "orders", "customer"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        out.append((status.getModificationTime(), status.getLen()))
    return tuple(out)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense cells of a folder's tables, kept in memory or on disk until the tables change or forget() is called."""
    key, now = (spark.sparkContext.applicationId, sf_dir), stamp(spark, sf_dir)
    if key not in _cells or _cells[key][0] != now:
        forget(spark, sf_dir)
        _cells[key] = now, dense(long_counts(spark, sf_dir)).persist()
    return _cells[key][1]


def forget(spark: SparkSession, sf_dir: str) -> None:
    """Gives back what cells() keeps of a folder."""
    held = _cells.pop((spark.sparkContext.applicationId, sf_dir), None)
    if held:
        held[1].unpersist()


def shares(cells_: DataFrame) -> DataFrame:
    whole = F.sum("pop").over(Window.partitionBy("entity", "year"))
    return cells_.withColumn("total", whole).withColumn("s", F.col("pop") / F.col("total"))


def vectors(cells_: DataFrame, bins: int = BINS) -> DataFrame:
    """entity, year, total, s (2 * bins shares, first side first), c (running sums by side), s1 (both sides added), c1."""
    listed = cells_.groupBy("entity", "year").agg(F.sum("pop").alias("total"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "pop"))), lambda x: x["pop"]).alias("pops"))
    s = listed.select("entity", "year", "total", vec.scaled(F.col("pops"), 1 / F.col("total")).alias("s"))
    s = s.withColumn("s1", vec.folded(F.col("s"), bins))
    return s.withColumn("c", vec.cumulative_halves(F.col("s"), bins)).withColumn("c1", vec.cumulative(F.col("s1")))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(cells(spark, sf_dir))


def members_sum(cells_: DataFrame, membership: DataFrame) -> DataFrame:
    """Cells of aggregates: sums over their members. membership: member, aggregate."""
    return cells_.join(membership, cells_["entity"] == membership["member"]).groupBy("aggregate", "year", "bin", "side").agg(F.sum("pop").alias("pop"))


def patched(cells_: DataFrame, patch: DataFrame) -> DataFrame:
    """cells_ with the cells of (entity, year) that patch has replaced by patch's."""
    touched = patch.select("entity", "year").distinct()
    return cells_.join(touched, ["entity", "year"], "left_anti").unionByName(patch.select(cells_.columns))


def quantised(shares_: DataFrame) -> DataFrame:
    """u, integers that sum to FULL in each (entity, year): floors, the shortfall to the largest fractions, ties to the lower place."""
    w = Window.partitionBy("entity", "year")
    x = F.col("s") / F.sum("s").over(w) * FULL
    out = shares_.withColumn("x", F.round(x, 6)).withColumn("low", F.floor("x").cast("int"))
    out = out.withColumn("short", FULL - F.sum("low").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc(F.round(F.col("x") - F.col("low"), 6)), "pos")))
    return out.select("entity", "year", "pos", (F.col("low") + (F.col("rank") <= F.col("short")).cast("int")).cast("int").alias("u"))


def deltas(u: DataFrame) -> DataFrame:
    """d: the first year raw, later ones the difference to the year before, modulo 65536."""
    w = Window.partitionBy("entity", "pos").orderBy("year")
    return u.withColumn("d", (F.col("u") - F.coalesce(F.lag("u").over(w), F.lit(0))).bitwiseAND(65535).cast("int"))


def undeltas(d: DataFrame) -> DataFrame:
    w = Window.partitionBy("entity", "pos").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("u", F.sum("d").over(w).bitwiseAND(65535).cast("int"))


def lagged(profiles_: DataFrame, span: int, columns: tuple[str, ...] = ("s",)) -> DataFrame:
    """profiles_ with columns_lag of the same entity span years before; years without one are left out."""
    old = profiles_.select("entity", (F.col("year") + span).cast("int").alias("year"), *[F.col(c).alias(f"{c}_lag") for c in columns])
    return profiles_.join(old, ["entity", "year"])


def pairs(a: DataFrame, b: DataFrame, on: Column, columns: list[str]) -> DataFrame:
    """Rows of a and b that meet on, b's columns named with b_ before them."""
    other = b.select(*[F.col(c).alias(f"b_{c}") for c in columns])
    return a.select(*columns).join(other, on)
