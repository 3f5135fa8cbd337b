"""Quarter series: value shifts over gaps, continuity, versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shifted(series: DataFrame, key: str, index: str, value: str, steps: dict[str, int]) -> DataFrame:
    """Adds the value ``steps`` quarters before, null over gaps: a range frame on the ordinal, one window for all."""
    out = series
    for name, step in steps.items():
        frame = Window.partitionBy(key).orderBy(index).rangeBetween(-step, -step)
        out = out.withColumn(name, F.first(value).over(frame))
    return out


def continuity(series: DataFrame, key: str, index: str, length: int = 8) -> DataFrame:
    """One row a key: latest quarter, quarters held, duplicates, missing ones of the last ``length``, status."""
    held = series.groupBy(key).agg(F.collect_set(index).alias("held"), F.max(index).alias("latest"), F.count("*").alias("n_rows"))
    window = F.sequence(F.col("latest") - (length - 1), F.col("latest"))
    missing = F.array_sort(F.array_except(window, F.col("held")))
    inside = F.size(F.array_intersect(window, F.col("held")))
    status = (
        F.when(F.col("n_rows") > F.size("held"), "duplicate_quarter").when(F.size(missing) == 0, "complete").when(inside >= 5, "with_gap").otherwise("needs_review")
    )
    return held.select(key, "latest", F.size("held").alias("n_quarters"), missing.alias("missing"), status.alias("status"))


def latest_non_null(df: DataFrame, key: str, order: Column, values: Sequence[str]) -> DataFrame:
    """Each value's latest non-null entry per key, by ``order``."""
    return df.groupBy(key).agg(*[F.max_by(F.col(v), F.when(F.col(v).isNotNull(), order)).alias(v) for v in values])


def final_wins(versions: DataFrame, key: Sequence[str], provisional: str, order: Sequence[Column]) -> DataFrame:
    """One version a key: the newest that is certainly not provisional, else the newest; adds its status."""
    first = F.coalesce(F.col(provisional) == F.lit(False), F.lit(False))
    ranked = versions.withColumn("version_rank", F.row_number().over(Window.partitionBy(*key).orderBy(first.desc(), *order)))
    status = F.when(F.col(provisional).isNull(), "latest_unverified").when(F.col(provisional), "provisional").otherwise("final")
    return ranked.where("version_rank = 1").drop("version_rank").withColumn("status", status)


def corrected_latest(versions: DataFrame, key: Sequence[str], corrected: str, time: str, values: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One version a key: of corrected ones if any, at the latest time if all have one; conflict if their values differ."""
    w = Window.partitionBy(*key)
    eligible = versions.withColumn("any_corrected", F.max(F.col(corrected).cast("int")).over(w)).where((F.col("any_corrected") == 0) | F.col(corrected))
    timed = eligible.withColumn("all_timed", F.min(F.col(time).isNotNull().cast("int")).over(w)).withColumn("last_time", F.max(time).over(w))
    newest = timed.where((F.col("all_timed") == 0) | (F.col(time) == F.col("last_time")))
    low, high = F.min(F.struct(*values)).over(w), F.max(F.struct(*values)).over(w)
    conflict = F.when(low.eqNullSafe(high), F.lit(None).cast("string")).when(F.col("all_timed") == 1, "same_time_values_differ").otherwise("unknown_time_values_differ")
    ranked = newest.withColumn("conflict", conflict).withColumn("version_rank", F.row_number().over(w.orderBy(*order)))
    return ranked.where("version_rank = 1").drop("any_corrected", "all_timed", "last_time", "version_rank")


def version_history(versions: DataFrame, key: Sequence[str], fields: Sequence[str], source: str) -> DataFrame:
    """Distinct versions of each key with the ids that carry them, as a sorted array of structs."""
    distinct = versions.groupBy(*key, *fields).agg(F.array_sort(F.collect_set(source)).alias("sources"))
    return distinct.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*fields, "sources"))).alias("history"), F.count("*").alias("n_versions"))
