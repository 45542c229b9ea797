"""Mixing sources to target weights by Poisson replication.

A source's rate is its target share of the output over its share of the input. Each document draws its number of copies by
inverting the Poisson distribution of that rate at a uniform value hashed from the seed and the document's id, is exploded into
so many copies, and the copies are shuffled over the whole corpus by a second hash. The counts have the target weights as their
means, and any worker can draw any document's number alone.

Only the counts of sources are aggregated (partial sums first, so a hot source is no hot task). The sources are counted before
they meet the documents: up to FEW_SOURCES are broadcast, so that texts move once only, in the global shuffle; more are joined
with a salt from the document's key, so that a hot source is dealt over SALTS tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, place_of, quoted

SEED = 42
CHUNK = 64.0
"""Largest rate that is inverted at once; a larger one is drawn as a sum of equal smaller ones, which has the same distribution."""
FEW_SOURCES = 10_000
"""Up to so many sources, of under 2 kB each, are broadcast."""
SALTS = 32


def uniform(key: Column) -> Column:
    """A value in [0, 1) from the first 52 bits of a key's md5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, source: str = "source", weights: dict[str | None, float] | None = None, total: float | None = None) -> DataFrame:
    """Columns source and rate. weights: relative target weights, 0 for sources that it lacks; without it all sources weigh alike.

    total: documents wanted in all; as many as there are by default. Documents without a source are a source of their own.
    """
    counts = docs.groupBy(quoted(source).cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = counts.withColumn("w", F.lit(1.0))
    else:
        named = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, w double")
        weighed = counts.join(named, F.col("source").eqNullSafe(F.col("name")), "left").select("source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    wanted = weighed.agg(F.sum("n").cast("double")).scalar() if total is None else F.lit(float(total))
    return weighed.select("source", (wanted * F.col("w") / weighed.agg(F.sum("w")).scalar() / F.col("n")).alias("rate"))


def with_steps(rated: DataFrame) -> DataFrame:
    """Adds the number of draws and the distribution function of one draw, up to 12 deviations and 20 beyond its mean."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / CHUNK)).cast("int")
    r = F.col("part_rate")
    far = F.ceil(r + 12 * F.sqrt(r) + 20).cast("int")
    grown = F.aggregate(
        F.sequence(F.lit(1), far),
        F.struct(F.exp(-r).alias("p"), F.array(F.exp(-r)).alias("cdf")),
        lambda a, k: F.struct((a["p"] * r / k).alias("p"), F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + a["p"] * r / k)).alias("cdf")),
    )
    return rated.withColumn("parts", parts).withColumn("part_rate", F.col("rate") / F.col("parts")).withColumn("cdf", grown["cdf"]).select("source", "rate", "parts", "cdf")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", weights: dict[str | None, float] | None = None, total: float | None = None, seed: int = SEED) -> DataFrame:
    """The columns of docs and copy_no (1, 2, ... of each document), mix_key (32 hex digits); rows in shuffled order.

    Rows are dealt over the partitions by mix_key and sorted by it inside each, which is a random order of the whole output. Rows with
    equal ids get equal counts and keys; they are dealt by a salt too, so that an id of many rows is no hot task. A row without an id
    draws by a hash of its columns. A null source is a source. An empty table gives an empty one. Columns named copy_no or mix_key are
    replaced; other columns may have any name.
    """
    names = [c for c in docs.columns if c.lower() not in ("copy_no", "mix_key")]
    own, of = f"c{place_of(docs, key)}", f"c{place_of(docs, source)}"
    every = [f"c{i}" for i in range(len(docs.columns))]
    kept = [f"c{i}" for i, c in enumerate(docs.columns) if c in names]
    plain = docs.toDF(*every).select(*kept)
    steps = cut(with_steps(rates(docs, source, weights, total)).withColumnsRenamed({"source": "mix_source", "rate": "mix_rate"}))
    nameless = F.concat(F.lit("null:"), F.md5(F.to_json(F.struct(*kept)).cast("binary")))
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(own).cast("string"), nameless))
    rows = plain.withColumn("name", name).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    same = F.col(of).cast("string").eqNullSafe(F.col("mix_source"))
    if steps.count() <= FEW_SOURCES:
        joined = rows.join(F.broadcast(steps), same)
    else:
        joined = rows.join(steps.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), same & (F.col("salt") == F.col("mix_salt")))
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col("parts")),
        F.lit(0),
        lambda n, j: n + F.size(F.filter("cdf", lambda c: c <= uniform(F.concat_ws(":", "name", j.cast("string"))))),
    )
    copies = joined.withColumn("n", drawn).where("n > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n"))))
    keyed = copies.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit("order"), "name", F.col("copy_no").cast("string")).cast("binary")))
    dealt = keyed.select(*kept, "copy_no", "mix_key", "salt").repartition("mix_key", "salt").sortWithinPartitions("mix_key", own)
    return dealt.drop("salt").toDF(*names, "copy_no", "mix_key")


def mix_documents(docs: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """docs mixed so that every source weighs alike, with just the columns of docs, whatever their names."""
    names = docs.columns
    out = mix(docs.toDF(*[f"c{i}" for i in range(len(names))]), f"c{place_of(docs, key)}", f"c{place_of(docs, source)}")
    return out.drop("copy_no", "mix_key").toDF(*names)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """op4: all documents mixed so that every source weighs alike."""
    return mix(docs)


ORACLE_SQL = f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, (SELECT sum(n) FROM counts)::DOUBLE / (SELECT count(*) FROM counts)::DOUBLE / n AS rate FROM counts),
parts AS (SELECT source, greatest(1, ceil(rate / {CHUNK}))::INT AS parts, rate / greatest(1, ceil(rate / {CHUNK})) AS r FROM rates),
steps AS (
  SELECT source, 0 AS k, r, exp(-r) AS p, exp(-r) AS cdf FROM parts
  UNION ALL
  SELECT source, k + 1, r, p * r / (k + 1), cdf + p * r / (k + 1) FROM steps WHERE k < ceil(r + 12 * sqrt(r) + 20)
),
draws AS (SELECT doc_id, d.source, '{SEED}:' || coalesce(doc_id::VARCHAR, 'null') AS name, unnest(range(1, parts + 1)) AS j FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source),
drawn AS (
  SELECT name, count(*) AS n FROM (SELECT DISTINCT * FROM draws) d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source
  WHERE s.cdf <= ('0x' || substr(md5(name || ':' || j), 1, 13))::BIGINT::DOUBLE / {float(1 << 52)!r} GROUP BY name
),
copies AS (SELECT name, unnest(range(1, n + 1))::INT AS copy_no FROM drawn)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c.copy_no, md5('order:' || name || ':' || copy_no) AS mix_key
FROM documents d JOIN copies c ON '{SEED}:' || coalesce(d.doc_id::VARCHAR, 'null') = c.name
"""
