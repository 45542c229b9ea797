"""Queries that write the given tables in a format of their own into the shared folder and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import codec as K
from ..operators import corpus as C
from ..session import shared_folder, table
from ..sources import export, files, store
from .profile import QUANT, quantise_largest_remainder
from .registry import on_profiles, query, r6


def place(spark, name):
    """A new folder in the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def lists(spark, d):
    """entity, year, u: each profile's 16-bit values in order."""
    u = quantise_largest_remainder(spark, d)
    return u.groupBy("entity", "year").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "u"))), lambda x: x["u"]).alias("u"))


def exploded(rows):
    return rows.select("entity", "year", F.posexplode("u").alias("pos", "u"))


@query("blob_roundtrip", on_profiles("SELECT entity, year, pos, u FROM u", QUANT))
def blob_roundtrip(spark, d):
    """Quantised profiles as one compressed blob for each entity, decoded."""
    return exploded(K.unpack(K.pack(lists(spark, d))))


BYTES = """ dz AS (SELECT entity, u, d, CASE WHEN d >= 32768 THEN 2 * (65536 - d) - 1 ELSE 2 * d END AS z FROM dl)"""


@query("blob_layouts", on_profiles("SELECT entity, layout, (2 * count(*))::BIGINT AS n_bytes, sum(v & 255)::BIGINT AS low_sum, sum(v >> 8)::BIGINT AS high_sum FROM (SELECT entity, 'raw' AS layout, u AS v FROM dz UNION ALL SELECT entity, 'delta', d FROM dz UNION ALL SELECT entity, 'zigzag', z FROM dz UNION ALL SELECT entity, 'transposed', d FROM dz) GROUP BY ALL", QUANT + "," + BYTES))
def blob_layouts(spark, d):
    """Bytes of the four layouts of each entity's blob after they were compressed and inflated: how many, and the sums of low and high bytes."""
    return K.layout_report(lists(spark, d)).drop("n_compressed")


@query("blob_sizes")
def blob_sizes(spark, d):
    """Compressed bytes of the four layouts over all entities, least first."""
    sums = K.layout_report(lists(spark, d)).groupBy("layout").agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_compressed").alias("n_compressed"))
    return sums.orderBy("n_compressed")


@query("packed_entity_readback", on_profiles("SELECT entity, year, pos, u FROM u WHERE entity IN (3, 7, 11) AND year BETWEEN 1996 AND 1999", QUANT))
def packed_entity_readback(spark, d):
    """Blobs written as Parquet; some entities' and years' rows read from it."""
    path = place(spark, "packed")
    K.write_packed(lists(spark, d), path)
    return exploded(K.read_packed(spark, path, [3, 7, 11], 1996, 1999))


HALF = "CASE WHEN x = 0 THEN 0.0 ELSE round_even(x / power(2, greatest(floor(log2(abs(x))), -14) - 10), 0) * power(2, greatest(floor(log2(abs(x))), -14) - 10) END"


@query("half_floats", f"SELECT vec_id, round(sum(h), 9) + 0.0 AS total, max(abs(h - x)) <= 0.0005 AS close, count(*) AS n FROM (SELECT vec_id, x, {HALF} AS h FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings)) GROUP BY vec_id")
def half_floats(spark, d):
    """Embeddings as half floats, decoded."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(F.size("v") == 64)
    back = K.from_half(K.to_half(e, "v", "h"), "h", "b", 64)
    far = F.array_max(F.zip_with("b", "v", lambda x, y: F.abs(x - y)))
    return back.select("vec_id", (F.round(F.aggregate("b", F.lit(0.0), lambda t, x: t + x), 9) + F.lit(0.0)).alias("total"), (far <= 0.0005).alias("close"), F.size("b").cast("long").alias("n"))


CODE = "CASE WHEN o_totalprice IS NULL OR o_totalprice <= 0 THEN -32768 ELSE least(greatest(floor(ln(o_totalprice) * 1024 + 0.5), -32767), 32767)::INT END"


@query("typed_decode", f"SELECT o_orderkey, CASE WHEN {CODE} <> -32768 THEN round(exp({CODE} / 1024.0), 4) END AS value FROM orders")
def typed_decode(spark, d):
    """What typed_codec's codes stand for: the exponential of the scaled code, null for the sentinel."""
    from .evaluation import typed_codec

    return typed_codec(spark, d).select("o_orderkey", F.when(F.col("code") != -32768, F.round(F.exp(F.col("code") / 1024.0), 4)).alias("value"))


@query("shard_readback", on_profiles("SELECT entity, year, pos, pop FROM cells WHERE year = 1997"))
def shard_readback(spark, d):
    """Cells written by year; one year's shard read back."""
    path = place(spark, "shards")
    files.write_shards(C.cells(spark, d).select("entity", "year", "pos", "pop"), path, "year")
    return files.read_shard(spark, path, "year", 1997).select("entity", F.col("year").cast("int").alias("year"), "pos", "pop")


@query("results_readback", "SELECT o_orderkey, o_orderpriority, round(o_totalprice / 7, 6) + 0.0 AS part FROM orders")
def results_readback(spark, d):
    """A result as CSV with a header and six decimals, read back."""
    path = place(spark, "results")
    files.write_results(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_totalprice") / 7).alias("part")), path)
    back = spark.read.option("header", True).schema("o_orderkey long, o_orderpriority string, part double").csv(path)
    return back.select("o_orderkey", "o_orderpriority", r6("part").alias("part"))


@query("population_readback", on_profiles("SELECT entity AS locid, n_name AS name, year, (5 * bin)::INT AS age_start, m AS pop_male, f AS pop_female FROM (SELECT entity, year, bin, sum(pop) FILTER (side = 'O') AS m, sum(pop) FILTER (side = 'F') AS f FROM cells GROUP BY ALL) JOIN nation ON entity = n_nationkey WHERE n_regionkey <> 0"))
def population_readback(spark, d):
    """Cells in the columns of a population file, compressed CSV with a header, and its scan; rows without a type of location are left out."""
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("pop")))
    wide = C.cells(spark, d).groupBy("entity", "year", "bin").agg(side("O").alias("PopMale"), side("F").alias("PopFemale")).join(table(spark, d, "nation"), F.col("entity") == F.col("n_nationkey"))
    kind = F.when(F.col("n_regionkey") == 0, " ").otherwise("Country/Area")
    path = place(spark, "population")
    wide.select(F.col("entity").alias("LocID"), F.col("n_name").alias("Location"), F.lit("NA").alias("ISO3_code"), kind.alias("LocTypeName"), F.col("year").alias("Time"), (5 * F.col("bin")).alias("AgeGrpStart"), "PopMale", "PopFemale").write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("compression", "gzip").csv(path)
    return files.population(spark, path).where("iso3 = 'NA'").select("locid", "name", "year", "age_start", "pop_male", "pop_female")


@query("indicators_readback", "WITH w AS (SELECT c_nationkey AS locid, year(o_orderdate)::INT AS year, avg(o_totalprice) AS mean, max(o_totalprice) AS most FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) BETWEEN 1996 AND 2000 GROUP BY ALL) SELECT locid, year, 'mean' AS indicator, round(mean, 4) AS value, year > 1999 AS is_forecast FROM w UNION ALL SELECT locid, year, 'most', round(most, 4), year > 1999 FROM w WHERE locid % 4 <> 0")
def indicators_readback(spark, d):
    """A wide CSV of two indicators by nation and year, some cells no numbers, scanned to long rows within a range of years."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    wide = o.groupBy(F.col("c_nationkey").alias("LocID"), F.year("o_orderdate").alias("Time")).agg(F.avg("o_totalprice").alias("Mean"), F.max("o_totalprice").cast("string").alias("Most"))
    path = place(spark, "indicators")
    wide.withColumn("Most", F.when(F.col("LocID") % 4 == 0, "...").otherwise(F.col("Most"))).write.option("header", True).csv(path)
    found = files.indicators(spark, path, {"mean": "Mean", "most": "Most"}, 1999, (1996, 2000))
    return found.select("locid", "year", "indicator", F.round("value", 4).alias("value"), "is_forecast")


@query("json_pages_readback", "SELECT 'N' || c_nationkey AS iso3, year(o_orderdate)::INT AS year, 'ORDERS' AS indicator, count(*)::DOUBLE AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 2 GROUP BY ALL")
def json_pages_readback(spark, d):
    """Pages of [header, points] by nation as lines of text, scanned; codes that stand for aggregates, here one region's nations, are left out."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    code = F.concat(F.lit("N"), F.col("c_nationkey"))
    counted = o.groupBy(code.alias("code"), F.year("o_orderdate").cast("string").alias("date")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    point = F.struct(F.col("code").alias("countryiso3code"), "date", "value", F.struct(F.lit("ORDERS").alias("id")).alias("indicator"))
    pages = counted.groupBy("code").agg(F.to_json(F.collect_list(point)).alias("points"), F.count(F.lit(1)).alias("n"))
    path = place(spark, "pages")
    pages.select(F.concat(F.lit('[{"page":1,"pages":1,"total":'), F.col("n"), F.lit("},"), F.col("points"), F.lit("]")).alias("value")).write.text(path)
    aggregates = table(spark, d, "nation").where("n_regionkey = 2").select(F.concat(F.lit("N"), F.col("n_nationkey")).alias("code"))
    return files.json_pages(spark, path, aggregates)


@query("manifest_changes", "SELECT n_regionkey AS shard, 'changed' AS state FROM nation WHERE n_regionkey = 3 GROUP BY ALL UNION ALL SELECT n_regionkey, 'same' FROM nation WHERE n_regionkey <> 3 GROUP BY ALL")
def manifest_changes(spark, d):
    """Nations in a file for each region, written twice with one region's names changed; regions by whether the hashes of their files are the same."""
    nations, found = table(spark, d, "nation").repartition(1), []
    for changed in (False, True):
        path = place(spark, "manifest")
        name = F.when((F.col("n_regionkey") == 3) & F.lit(changed), F.upper(F.concat("n_name", F.lit("!")))).otherwise(F.col("n_name"))
        nations.sortWithinPartitions("n_nationkey").select("n_nationkey", name.alias("n_name"), "n_regionkey").write.partitionBy("n_regionkey").csv(path)
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        found.append(listed.select(F.regexp_extract("path", r"n_regionkey=(\d+)", 1).alias("name"), F.sha2("content", 256).alias("sha256")))
    differing = files.changed(found[1], found[0]).select("name", F.lit(True).alias("differs"))
    met = found[1].select("name").join(differing, "name", "left")
    return met.select(F.col("name").cast("int").alias("shard"), F.when(F.col("differs"), "changed").otherwise("same").alias("state"))


# refreshed and exported tables ---------------------------------------------------------------------------------------------

PATCHED = (1997, 3)
"""Year and entity whose cells are changed before the third refresh."""


def derived_tables():
    shares = lambda t: C.shares(t["cells"]).select("entity", "year", "pos", "total", "s")
    largest = lambda t: t["shares"].groupBy("year", "entity").agg(F.max("s").alias("largest"))
    counts = lambda t: t["shares"].groupBy("year").agg(F.countDistinct("entity").alias("entities"))
    span = lambda t: t["counts"].agg(F.min("year").alias("first"), F.max("year").alias("last"), F.sum("entities").alias("profiles"))
    return [store.Derived("span", "first", span, whole=("counts",)), store.Derived("largest", "year", largest, ("shares",)), store.Derived("counts", "year", counts, ("shares",)), store.Derived("shares", "year", shares, ("cells",))]


def refreshed(spark, d):
    """The store's folder and the report of three refreshes: of nothing, of the same cells, and of cells of which one profile changed."""
    path = place(spark, "store")
    cells = C.cells(spark, d).select("entity", "year", "pos", "pop")
    changed = cells.withColumn("pop", F.when((F.col("year") == PATCHED[0]) & (F.col("entity") == PATCHED[1]), F.col("pop") + F.col("pos") + 1).otherwise(F.col("pop")))
    report = [(run, *r) for run, rows in enumerate((cells, cells, changed), 1) for r in store.refresh(spark, path, {"cells": (rows, "year")}, derived_tables())]
    return path, report


@query("refresh_report", on_profiles(f"SELECT run, name, part, CASE WHEN run = 1 OR (run = 3 AND part = '{PATCHED[0]}' AND name IN ('shares', 'largest', 'counts')) THEN 'written' ELSE 'kept' END AS state FROM range(1, 4) r(run), (SELECT DISTINCT n AS name, year::VARCHAR AS part FROM k, (VALUES ('shares'), ('largest'), ('counts')) v(n) UNION ALL SELECT 'span', 'all')"))
def refresh_report(spark, d):
    """What three refreshes of four tables wrote: all, nothing, and the dependants of the year that changed; a table whose input was rebuilt to the same rows stays."""
    return spark.createDataFrame(refreshed(spark, d)[1], "run long, name string, part string, state string")


@query("refresh_result", on_profiles("SELECT entity, year, pos, round(pop / sum(pop) OVER (PARTITION BY entity, year), 6) + 0.0 AS share FROM c2", f" c2 AS (SELECT entity, year, pos, pop + CASE WHEN year = {PATCHED[0]} AND entity = {PATCHED[1]} THEN pos + 1 ELSE 0 END AS pop FROM cells)"))
def refresh_result(spark, d):
    """Shares in the store after the third refresh."""
    return store.read(spark, refreshed(spark, d)[0], "shares").select("entity", "year", "pos", r6("s").alias("share"))


def sized(prefix: int) -> str:
    """The size of a file whose other bytes are counted in b: the number whose digits make up the rest."""
    return f"(SELECT min(b + k) FROM range(1, {prefix}) r(k) WHERE length((b + k)::VARCHAR) = k)"


HEADER = """4 + length('{"title":"shares","part":"' || entity || '","rows":' || n || ',"arrays":[["year","<i4",' || n || '],["pos","<i4",' || n || '],["s","<f8",' || n || ']],"size":}') + 16 * n"""
EXPORT = f" ex AS (SELECT entity, n, total, {sized(12)} AS n_bytes FROM (SELECT entity, n, total, {HEADER} AS b FROM (SELECT entity, count(*) AS n, round(sum(s * pos), 6) + 0.0 AS total FROM prof GROUP BY entity)))"
BUDGET, WHOLE = 2350, 30_000


def files_of(spark, d):
    rows = C.shares(C.cells(spark, d)).select("entity", "year", "pos", "s")
    made = export.exported(rows, "entity", ["year", "pos"], ["year", "pos", "s"], "shares", "not for redistribution|licen[cs]e")
    path = place(spark, "export")
    made.write.parquet(path)
    return spark.read.parquet(path)


@query("export_files", on_profiles("SELECT entity::VARCHAR AS part, n_bytes, n AS n_rows, total FROM ex", EXPORT))
def export_files(spark, d):
    """Shares as one self-describing file for each entity, written and read back; each holds its own size."""
    files_ = files_of(spark, d)
    back = export.opened(files_, {"year": "int", "pos": "int", "s": "double"}).groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"), r6(F.sum(F.col("s") * F.col("pos"))).alias("total"))
    return files_.select("part", "n_bytes").join(back, "part")


@query("export_violations", on_profiles(f"SELECT 'part ' || entity AS what, n_bytes, {BUDGET}::BIGINT AS allowed FROM ex WHERE n_bytes > {BUDGET} UNION ALL SELECT 'total', sum(n_bytes)::BIGINT, {WHOLE} FROM ex HAVING sum(n_bytes) > {WHOLE}", EXPORT))
def export_violations(spark, d):
    """Files over their budget, and all together over theirs."""
    return export.violations(files_of(spark, d), F.lit(BUDGET), WHOLE)
