"""Streaming queries, replayed to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_folder
from ..streaming import windows as W
from .registry import query, r6


@query("stream_tumbling_profile", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY ALL")
def stream_tumbling_profile(spark, d):
    """Daily counts of a replayed stream of events; equal to those of a batch."""
    out = W.replayed(W.tumbling_counts(W.event_stream(spark, d)), f"{shared_folder(spark)}/tumbling_{uuid.uuid4().hex}")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", (F.round("total", 4) + F.lit(0.0)).alias("total"))


@query("window_batch_profile", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 6) + 0.0 AS total FROM events GROUP BY ALL")
def window_batch_profile(spark, d):
    out = W.tumbling_counts(spark.read.parquet(f"{d}/events.parquet"), "1 hour")
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", r6("total").alias("total"))
