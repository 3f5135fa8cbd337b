"""Streaming twins: each runs over all input with the available-now trigger and gives the batch query's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import streams as S
from .base import query, table


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) SELECT user_id, event_type, event_id, value FROM r WHERE k = 1")
def stream_cursor_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-batches upserted by key, last id wins."""
    return S.run_upsert(spark, f"{sf_dir}/events.parquet", ["user_id", "event_type"], "event_id", ["value"])


@query("SELECT DISTINCT user_id, event_type, CAST(floor(value) AS BIGINT) AS whole FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sight of each key in a stream."""
    return S.run_distinct(spark, f"{sf_dir}/events.parquet", ["user_id", "event_type", "cast(floor(value) as bigint) as whole"])


@query("SELECT CAST(CAST(ts + INTERVAL 9 HOUR AS DATE) AS VARCHAR) AS usage_day, event_type, count(*) AS calls FROM events GROUP BY 1, 2")
def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling days in Seoul time, counted by a stream."""
    return S.run_daily(spark, f"{sf_dir}/events.parquet").withColumn("usage_day", F.col("usage_day").cast("string"))


@query("SELECT event_id, user_id, ts FROM events")
def stream_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events fetched in three windows that overlap, with late rows in the last one: each event once, late ones not at all."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    third = (high - low) / 3
    edge = lambda k: F.lit(low + third * k)
    overlap = F.expr("interval 2 hours")
    first = events.where(F.col("ts") <= edge(1))
    second = events.where((F.col("ts") > edge(1) - overlap) & (F.col("ts") <= edge(2)))
    # what is older than the reach comes again, and under ids that were never seen
    late = events.where(F.col("ts") < edge(1) - F.expr("interval 16 hours"))
    last = events.where(F.col("ts") > edge(2) - overlap).unionByName(late).unionByName(late.withColumn("event_id", F.col("event_id") + 10**12))
    return S.run_fresh(spark, iter([first, second, last]), ["event_id"], "ts").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
