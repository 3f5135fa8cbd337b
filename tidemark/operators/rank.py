"""Top-k, retention and representative rows per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; the rank filter reaches the window, so groups are cut before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_k(df, key, order, 1, "first_rank").drop("first_rank")


def retained(events: DataFrame, now: Column, *, group: str, key: str, time: str, bucket: str, limits: dict[str, tuple[int, int]]) -> DataFrame:
    """Retention: newest row per key, buckets with (days, cap) limits; future times pass, null times are too old."""
    newest = first_per_key(events, [group, key], [F.col(time).desc_nulls_last(), F.col(key)])
    age = F.floor((F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col(time).cast("timestamp"))) / 86_400)
    days, cap = F.lit(None).cast("int"), F.lit(None).cast("int")
    for name, (most_days, most) in limits.items():
        days = F.when(F.col(bucket) == name, most_days).otherwise(days)
        cap = F.when(F.col(bucket) == name, most).otherwise(cap)
    young = newest.where(F.coalesce(age, F.lit(10_000)) <= days).withColumn("bucket_cap", cap)
    ranked = young.withColumn("bucket_rank", F.row_number().over(Window.partitionBy(group, bucket).orderBy(F.col(time).desc_nulls_last(), F.col(key))))
    return ranked.where("bucket_rank <= bucket_cap").drop("bucket_cap")


def representative(df: DataFrame, group: Sequence[str], rank: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """The least row of each group by ``rank`` as a partial aggregate (no sort)."""
    best = df.groupBy(*group).agg(F.min(F.struct(*[r.alias(f"r{k}") for k, r in enumerate(rank)], *columns)).alias("best"))
    return best.select(*group, *[F.col(f"best.{c}").alias(c) for c in columns])
