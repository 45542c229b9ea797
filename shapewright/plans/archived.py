"""Queries that write the given tables into workbooks and ZIP files and read them back."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from ..session import table
from ..sources import archives, files
from .registry import query
from .stored import place

YEARS = tuple(range(1995, 2002))
TOTALS = "SELECT c_nationkey AS entity, year(o_orderdate)::INT AS year, round(sum(o_totalprice), 2) AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"


def totals(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("entity")), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy("entity", F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("y"))


def of_regions(spark, d):
    """region, and its nations' totals: code, name and one value a year, null where there is none."""
    wide = totals(spark, d).groupBy("entity").pivot("year", list(YEARS)).agg(F.first("y"))
    rows = wide.join(table(spark, d, "nation"), F.col("entity") == F.col("n_nationkey"))
    values = F.array(*[F.col(str(y)) for y in YEARS])
    return rows.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("entity", "n_name", values.alias("values")))).alias("rows"))


def written(spark, regions, name, make):
    """One file for each region, as rows (path, content) in the shared folder."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([f"region {r['n_regionkey']}"]), pa.array([make(r)], pa.binary())], names=["path", "content"])

    path = place(spark, name)
    regions.mapInArrow(run, "path string, content binary").write.parquet(path)
    return spark.read.parquet(path)


@query("workbook_readback", f"SELECT n_regionkey AS region, entity, n_name AS name, year, y FROM ({TOTALS}) JOIN nation ON n_nationkey = entity")
def workbook_readback(spark, d):
    """Totals by nation and year as one workbook for each region, a column for each year, read back as long rows."""
    head = ["Code", "Name & title", *[str(y) for y in YEARS]]
    books = written(spark, of_regions(spark, d), "books", lambda r: archives.workbook([head, *[[x["entity"], x["n_name"], *x["values"]] for x in r["rows"]]], "Data"))
    wide = archives.tabled(archives.workbook_rows(books, "Data"))
    long = files.long_form(wide.withColumn("Code", F.col("Code").cast("int")), ["path", "Code", "Name & title"], "year")
    return long.select(F.regexp_extract("path", r"(\d+)", 1).cast("int").alias("region"), F.col("Code").alias("entity"), F.col("Name & title").alias("name"), F.col("year").cast("int").alias("year"), F.col("value").alias("y"))


def zipped(r) -> bytes:
    """A ZIP file with a table of each nation and a note that is no table."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as held:
        held.writestr("README.txt", "no table")
        for x in r["rows"]:
            lines = ["variant,year,value", *[f"{v},{y},{value!r}" for y, value in zip(YEARS, x["values"], strict=True) if value is not None for v in ("Medium", "High")]]
            held.writestr(f"data/nation_{x['entity']}.csv", "\n".join(lines))
    return out.getvalue()


@query("zip_member_readback", f"SELECT entity, year, y FROM ({TOTALS})")
def zip_member_readback(spark, d):
    """Totals as tables in ZIP files: the members that are tables, and of their lines those of one variant."""
    members = archives.zip_members(written(spark, of_regions(spark, d), "zips", zipped), r"data/nation_\d+\.csv")
    lines = members.select(F.regexp_extract("member", r"_(\d+)", 1).cast("int").alias("entity"), F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line"))
    rows = lines.where("line NOT LIKE 'variant,%'").select("entity", F.from_csv("line", "variant string, year int, value double").alias("r")).select("entity", "r.*")
    return rows.where("variant = 'Medium'").select("entity", "year", F.col("value").alias("y"))


@query("aggregate_codes", "SELECT n_nationkey AS entity, n_name AS name FROM nation WHERE n_regionkey <> 2")
def aggregate_codes(spark, d):
    """Codes that a list in JSON says are aggregates, and the nations that are none."""
    region = F.when(F.col("n_regionkey") == 2, "Aggregates").otherwise(F.concat(F.lit("R"), F.col("n_regionkey")))
    entry = F.struct(F.concat(F.lit("N"), F.col("n_nationkey")).alias("id"), F.struct(region.alias("value")).alias("region"))
    nations = table(spark, d, "nation")
    path = place(spark, "codes")
    nations.groupBy("n_regionkey").agg(F.to_json(F.collect_list(entry)).alias("value")).select("value").write.text(path)
    codes = spark.read.text(path).select(F.inline(F.from_json("value", "array<struct<id:string,region:struct<value:string>>>"))).where("region.value = 'Aggregates'").select(F.col("id").alias("code"))
    return nations.join(codes, F.concat(F.lit("N"), F.col("n_nationkey")) == F.col("code"), "left_anti").select(F.col("n_nationkey").alias("entity"), F.col("n_name").alias("name"))
