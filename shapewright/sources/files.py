"""Sources and sinks: governed scans of CSV, JSON and Parquet, manifests, shards and CSV results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POPULATION = T.StructType([
    T.StructField("LocID", T.IntegerType()), T.StructField("Location", T.StringType()), T.StructField("ISO3_code", T.StringType()), T.StructField("LocTypeName", T.StringType()),
    T.StructField("Time", T.IntegerType()), T.StructField("AgeGrpStart", T.IntegerType()), T.StructField("PopMale", T.DoubleType()), T.StructField("PopFemale", T.DoubleType()),
])


def population(spark: SparkSession, path: str) -> DataFrame:
    """Long population counts of a CSV file or folder; rows without a type of location are left out. The text NA is a code, not a null."""
    raw = spark.read.schema(POPULATION).option("header", True).option("nullValue", "").csv(path)
    named = {"locid": "LocID", "name": "Location", "iso3": "ISO3_code", "loctype": "LocTypeName", "year": "Time", "age_start": "AgeGrpStart", "pop_male": "PopMale", "pop_female": "PopFemale"}
    return raw.select(*[F.col(v).alias(k) for k, v in named.items()]).where(F.trim("loctype") != "")


def indicators(spark: SparkSession, path: str, columns: dict[str, str], last_observed: int = 2023, years: tuple[int, int] = (1950, 2100)) -> DataFrame:
    """Long indicators (locid, year, indicator, value, is_forecast) of a wide CSV; columns: its name of each indicator's."""
    raw = spark.read.option("header", True).csv(path).select(F.col("LocID").cast("int").alias("locid"), F.col("Time").cast("int").alias("year"), *[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(k) for k, c in columns.items()])
    kept = raw.where(F.col("year").between(*years))
    return kept.unpivot(["locid", "year"], list(columns), "indicator", "value").where("value IS NOT NULL").withColumn("is_forecast", F.col("year") > last_observed)


def long_form(wide: DataFrame, ids: list[str], name: str = "series") -> DataFrame:
    """Every other column as rows of (ids, name, value), nulls left out."""
    rest = [c for c in wide.columns if c not in ids]
    return wide.select(*ids, *[F.col(c).cast("double").alias(c) for c in rest]).unpivot(ids, rest, name, "value").where("value IS NOT NULL")


PAGE = "struct<page:int,pages:int>"
POINT = "struct<countryiso3code:string,date:string,value:double,indicator:struct<id:string>>"


def json_pages(spark: SparkSession, path: str, aggregates: DataFrame | None = None) -> DataFrame:
    """iso3, year, indicator, value of JSON files whose lines are [header, points]; codes in aggregates (column code) are left out."""
    lines = spark.read.text(path).select(F.from_json(F.get_json_object("value", "$[1]"), f"array<{POINT}>").alias("points"))
    rows = lines.select(F.inline("points")).select(F.col("countryiso3code").alias("iso3"), F.col("date").cast("int").alias("year"), F.col("indicator.id").alias("indicator"), "value").where("value IS NOT NULL")
    return rows if aggregates is None else rows.join(aggregates, F.col("iso3") == F.col("code"), "left_anti")


def ladder_bins(rows: DataFrame, keys: list[str], age: str = "age_start", last: int = 100) -> DataFrame:
    """Sums of longer ladders of ages in their last open bin."""
    values = [c for c in rows.columns if c not in (*keys, age)]
    return rows.groupBy(*keys, F.least(F.col(age), F.lit(last)).alias(age)).agg(*[F.sum(v).alias(v) for v in values])


def fiscal_year(header: Column) -> Column:
    """FY89 to 1989, FY05 to 2005; the pivot is 50."""
    yy = F.regexp_extract(header, r"FY(\d{2})", 1).cast("int")
    return F.when(yy < 50, 2000 + yy).otherwise(1900 + yy)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes, sha256 of each file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def changed(now: DataFrame, recorded: DataFrame) -> DataFrame:
    """Files whose hash is not the recorded one: name, sha256, recorded (null where a file is new or gone)."""
    met = now.select("name", "sha256").join(recorded.select("name", F.col("sha256").alias("recorded")), "name", "full_outer")
    return met.where(~F.col("sha256").eqNullSafe(F.col("recorded")))


def combined_hash(files: DataFrame, by: str) -> DataFrame:
    """One hash of each source's files, whatever their order."""
    return files.groupBy(by).agg(F.sha2(F.concat_ws("", F.sort_array(F.collect_list("sha256"))).cast("binary"), 256).alias("sha256"))


def write_shards(rows: DataFrame, path: str, by: str) -> None:
    """Parquet by partition; rows of a shard meet in as few files as AQE thinks fit, so a large shard is split."""
    rows.hint("rebalance", by).write.mode("overwrite").partitionBy(by).parquet(path)


def read_shard(spark: SparkSession, path: str, by: str, value: object) -> DataFrame:
    """Rows of one shard; only its folder is listed and read."""
    return spark.read.parquet(path).where(F.col(by) == value)


def write_results(rows: DataFrame, path: str) -> None:
    """CSV with a header; doubles at six decimals."""
    kinds = dict(rows.dtypes)
    rows.select(*[F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in rows.columns]).write.mode("overwrite").option("header", True).csv(path)
