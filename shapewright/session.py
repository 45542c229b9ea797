"""Sessions and table access."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(name: str = "shapewright", **conf: str) -> SparkSession:
    """A session with ANSI mode, UTC and adaptive execution; conf overrides, dots written as double underscores."""
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    builder = SparkSession.builder.appName(name)
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of this machine's only in local mode where none is named."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(path)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views of all tables in a folder, for spark.sql."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def console(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Read-only SQL over the tables; anything but one SELECT or WITH is refused."""
    if text.lstrip().split(None, 1)[0].lower() not in ("select", "with", "from", "values") or ";" in text.rstrip().rstrip(";"):
        raise ValueError("only one SELECT is allowed")
    register_views(spark, sf_dir)
    return spark.sql(text.rstrip().rstrip(";"))


def register_distances(spark: SparkSession) -> None:
    """l1, l2, w1s and blend_d of arrays as functions of SQL in this session."""
    from .operators.corpus import WIDTH
    from .operators.metrics import SIGMA

    def add(name: str, arguments: str, body: str) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS DOUBLE RETURN {body}")

    two = "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>"
    add("l1", two, "aggregate(zip_with(a, b, (x, y) -> abs(x - y)), 0D, (t, x) -> t + x)")
    add("l2", two, "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (t, x) -> t + x))")
    add("w1s", two, f"{WIDTH} * aggregate(zip_with(a, b, (x, y) -> abs(x - y)), 0D, (t, x) -> t + x)")
    add("blend_d", "s ARRAY<DOUBLE>, bs ARRAY<DOUBLE>, c ARRAY<DOUBLE>, bc ARRAY<DOUBLE>", f"0.5 * l2(s, bs) / {SIGMA['l2']} + 0.5 * w1s(c, bc) / {SIGMA['w1sex']}")
