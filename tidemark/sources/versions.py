"""Tables with versions: a folder for each version, read at one of them or at a time, compared and restored.

A version is a partition (``version``, ``committed_at``) of one Parquet table, so reading one prunes the others, and a version
that is written again replaces itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_version(df: DataFrame, path: str, version: int, committed_at: str) -> None:
    """``df`` as a version of the table; the versions before stay."""
    marked = df.withColumn("version", F.lit(version)).withColumn("committed_at", F.lit(committed_at))
    marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", "committed_at").parquet(path)


def all_versions(spark: SparkSession, path: str) -> DataFrame:
    """Every version's rows, with version (int) and committed_at (timestamp without zone)."""
    return spark.read.parquet(path).withColumn("version", F.col("version").cast("int")).withColumn("committed_at", F.col("committed_at").cast("timestamp_ntz"))


def at_version(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The table as version ``version`` has it; no rows where there is no such version."""
    return all_versions(spark, path).where(F.col("version") == version).drop("version", "committed_at")


def at_time(spark: SparkSession, path: str, moment: str) -> DataFrame:
    """The table as the last version committed by ``moment`` has it."""
    rows = all_versions(spark, path)
    until = rows.where(F.col("committed_at") <= F.lit(moment).cast("timestamp_ntz"))
    last = until.agg(F.max("version").alias("last"))  # one row
    return until.join(F.broadcast(last), F.col("version") == F.col("last")).drop("version", "committed_at", "last")


def change_set(before: DataFrame, after: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(key, change, column, old_value, new_value): a row for each added and removed key, and for each changed column of the others."""
    text = lambda side: F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{side}_{c}").cast("string").alias("v")) for c in columns])
    old = before.select(*key, *[F.col(c).alias(f"old_{c}") for c in columns], F.lit(True).alias("was"))
    new = after.select(*key, *[F.col(c).alias(f"new_{c}") for c in columns], F.lit(True).alias("now"))
    met = old.join(new, list(key), "full")
    pairs = F.filter(F.zip_with(text("old"), text("new"), lambda o, n: F.struct(o["column"].alias("column"), o["v"].alias("old_value"), n["v"].alias("new_value"))), lambda p: ~p["old_value"].eqNullSafe(p["new_value"]))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("old_value"), F.lit(None).cast("string").alias("new_value")))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    return met.select(*key, change.alias("change"), F.when(change == "changed", pairs).otherwise(whole).alias("p")).select(*key, "change", F.inline("p"))


def as_of(facts: DataFrame, versions: DataFrame, key: str, time: str, since: str, columns: Sequence[str]) -> DataFrame:
    """Facts with the columns of their key's last version at or before their time, null where there is none.

    Facts and versions of a key are put in one order, versions first at equal times, and each fact takes the last version
    before it: one shuffle and one sort, no pairs.
    """
    held = F.struct(*columns)
    empty = F.lit(None).cast(versions.select(held.alias("h")).schema["h"].dataType)
    left = facts.select(F.col(key).alias("k_"), F.col(time).alias("at_"), F.lit(1).alias("kind_"), F.struct("*").alias("fact_"), empty.alias("held_"))
    right = versions.select(F.col(key).alias("k_"), F.col(since).alias("at_"), F.lit(0).alias("kind_"), F.lit(None).cast(left.schema["fact_"].dataType).alias("fact_"), held.alias("held_"))
    before = Window.partitionBy("k_").orderBy("at_", "kind_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = left.unionByName(right).withColumn("held_", F.last("held_", ignorenulls=True).over(before)).where("kind_ = 1 and k_ is not null")
    return met.select("fact_.*", *[F.col(f"held_.{c}").alias(c) for c in columns])


def restored(current: DataFrame, baseline: DataFrame, key: str, damaged: Column) -> DataFrame:
    """Current rows, those of damaged keys as the baseline has them."""
    return current.where(~damaged).unionByName(baseline.where(damaged).select(current.columns))


def without_assignments(held: DataFrame, removals: DataFrame, key: str, item: str) -> tuple[DataFrame, DataFrame]:
    """(kept, removed_by_key): held rows but those that (key, item) of the removals name, and how many went from each key that they name."""
    named = removals.select(key, item).distinct()
    kept = held.join(named, [key, item], "left_anti").select(held.columns)
    gone = held.join(named, [key, item], "left_semi").groupBy(key).agg(F.count("*").alias("removed"))
    return kept, named.select(key).distinct().join(gone, key, "left").na.fill({"removed": 0})
