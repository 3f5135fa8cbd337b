"""Keyed merges: upserts, partition replacement, reconciliation, change detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import first_per_key


def union_by_priority(sources: Sequence[DataFrame], key: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """Union of the sources with one row a key; the earliest source wins, then ``order``."""
    marked = [s.withColumn("source_priority", F.lit(k)) for k, s in enumerate(sources)]
    both = marked[0]
    for other in marked[1:]:
        both = both.unionByName(other)
    return first_per_key(both, key, [F.col("source_priority"), *order])


def upserted(existing: DataFrame, incoming: DataFrame, key: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """Incoming rows replace existing ones of the same key."""
    return union_by_priority([incoming, existing], key, order).drop("source_priority")


def partition_replaced(existing: DataFrame, fresh: DataFrame, partition: str) -> DataFrame:
    """Whole partitions of ``fresh`` replace those of ``existing``."""
    return existing.join(fresh.select(partition).distinct(), partition, "left_anti").unionByName(fresh)


def reconciled(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """One row a key of either side with its state: both, missing or unexpected."""
    left = expected.select(key).distinct().withColumn("expected", F.lit(True))
    right = actual.select(key).distinct().withColumn("actual", F.lit(True))
    state = F.when(F.col("expected").isNull(), "unexpected").when(F.col("actual").isNull(), "missing").otherwise("both")
    return left.join(right, key, "full").select(key, state.alias("state"))


def row_hash(columns: Sequence[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def changed(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Keys that were added, removed or changed, by a hash of their columns; unchanged rows are left out."""
    old = before.select(key, F.xxhash64(*columns).alias("old_hash"))
    new = after.select(key, F.xxhash64(*columns).alias("new_hash"))
    kind = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").otherwise("changed")
    return old.join(new, key, "full").where(~F.col("old_hash").eqNullSafe(F.col("new_hash"))).select(key, kind.alias("change"))
