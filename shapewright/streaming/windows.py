"""Streaming extensions: windowed profiles and deduplicated events with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", files: int = 1) -> DataFrame:
    """A stream of the Parquet files of a table, which is a folder or a single file, its schema taken from what is there now."""
    path = f"{folder}/{name}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    single = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files)
    return reader.option("pathGlobFilter", name).parquet(folder) if single else reader.parquet(path)


def tumbling_counts(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """n and total of each event type in tumbling windows. In append and update modes state older than the watermark is dropped; complete mode keeps all windows."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def first_events(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Each event id once; ids are remembered as long as the watermark says."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else timed.dropDuplicates(["event_id"])


def replayed(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """What a stream has given when all its files are read, kept as Parquet in a folder beside its checkpoint.

    folder: one that the driver and all executors share. In complete mode each batch replaces what was given before, else it is added.
    """
    rows, how = f"{folder}/rows", "overwrite" if mode == "complete" else "append"
    write = lambda batch, _: batch.write.mode(how).parquet(rows)
    running = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(rows)
