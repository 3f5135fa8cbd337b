"""Audits: accounting mixes, status of the latest quarter, samples, quality and quarantine merges, refresh status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rank import first_per_key

# Statuses of sources, basis names that count as mixed, history reasons.
STATUSES = ["final", "provisional", "corrected"]
BASES = ["consolidated", "separate"]


def latest_status(status: Column) -> Column:
    return F.when(status == "historical_reference", "historical").when(status.isin(STATUSES), status).otherwise("unknown")


def accounting_audit(selected: DataFrame, candidates: DataFrame, messages: DataFrame, company: str = "stock_code") -> DataFrame:
    """One row a company: mixes among the selected quarters and their candidates.

    selected: company, basis, metric_basis, corrected, quarter_index; candidates: company, fiscal_quarter, status, is_current;
    messages: company, cumulative.
    """
    chosen = selected.groupBy(company).agg(
        (F.count_distinct(F.when(F.col("basis").isin(BASES), F.col("basis"))) > 1).alias("basis_mixed"), (F.count_distinct("metric_basis") > 1).alias("metric_mixed"),
        F.bool_or(F.col("quarter_index") < 0).alias("annual_as_quarter"), F.count_if("corrected").alias("corrected"),
    )
    current = candidates.where("is_current").groupBy(company, "fiscal_quarter").agg((F.count_distinct(F.coalesce("status", F.lit(""))) > 1).alias("mixed")).groupBy(company).agg(F.count_if("mixed").alias("mixed_status"))
    summed = messages.groupBy(company).agg(F.bool_or("cumulative").alias("cumulative"))
    return chosen.join(current, company, "left").join(summed, company, "left").na.fill({"mixed_status": 0, "cumulative": False})


def sampled_quarters(quarters: DataFrame, company: str, index: str) -> DataFrame:
    """Of each company with eight quarters or more the last, the fifth from the end and the first, else all; adds ``at`` (from the end)."""
    back = F.row_number().over(Window.partitionBy(company).orderBy(F.col(index).desc()))
    rows = quarters.withColumn("at", back).join(quarters.groupBy(company).agg(F.count("*").alias("held")), company)
    return rows.where((F.col("held") < 8) | F.col("at").isin(1, 5) | (F.col("at") == F.col("held"))).drop("held")


def continuity(quarters: DataFrame, company: str, index: str, position: str) -> DataFrame:
    """One row a company: status, missing (of the eight up to the latest row's), duplicates and whether rows are out of order.

    Rows stand in the order of ``position``; the latest is the last one, as the rows come.
    """
    before = F.lag(index).over(Window.partitionBy(company).orderBy(position))
    steps = quarters.withColumn("back", F.coalesce(F.col(index) < before, F.lit(False)))
    held = steps.groupBy(company).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(index)).alias("found"), F.bool_or("back").alias("unordered"), F.max_by(index, position).alias("latest"))
    eight = F.sequence(F.col("latest") - 7, F.col("latest"))
    rows = held.withColumn("missing", F.array_except(eight, "found")).withColumn("duplicates", F.col("n") - F.size("found"))
    status = (
        F.when(F.col("duplicates") > 0, "duplicate_quarter").when(F.col("unordered"), "quarter_order_issue").when((F.col("n") == 8) & (F.size("missing") == 0), "complete_8q_continuous")
        .when(F.col("n") == 8, "complete_8q_with_gap").otherwise("needs_review")
    )
    return rows.select(company, status.alias("status"), "latest", "missing", "duplicates", "unordered")


def merged_removals(previous: DataFrame, found: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Removed ids of earlier audits and the new ones of this; what both have stays as it was."""
    fresh = found.join(previous.select(key), key, "left_anti").dropDuplicates([key])
    return previous.withColumn("is_new", F.lit(False)).unionByName(fresh.withColumn("is_new", F.lit(True)))


def merged_quarantine(parts: list[DataFrame], order: str = "part") -> DataFrame:
    """Quarantine records of several sources, the last one of each message and target."""
    out = None
    for k, part in enumerate(parts):
        rows = part.withColumn(order, F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    return first_per_key(out, ["message_id", "target"], [F.col(order).desc(), F.col("reason").desc()]).drop(order)


def refreshed(status: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """Status rows after runs (key, completed_at, changed, and three times of older content): a success always counts, the
    content time moves with a change and is filled from the newest of the three where it was never set."""
    joined = runs.join(status, key, "left")
    older = F.greatest("earnings_at", "disclosures_at", "news_at")
    content = F.when(F.col("changed"), F.col("completed_at")).otherwise(F.coalesce("last_content", older))
    return joined.select(key, F.col("completed_at").alias("last_success"), content.alias("last_content"))


def review_news(news: DataFrame, company: str, tier: Column, level: str, order: list[Column]) -> DataFrame:
    """News of a review: the newest three of core companies, the newest of watched ones, else the critical and important ones; adds ``place``."""
    placed = news.withColumn("tier_", tier).withColumn("place", F.row_number().over(Window.partitionBy(company).orderBy(*order)))
    keep = F.when(F.col("tier_") == "core", F.col("place") <= 3).when(F.col("tier_") == "watch", F.col("place") <= 1).otherwise(F.col(level).isin("critical", "important"))
    return placed.where(keep).drop("tier_")


def amount_sanity(quarters: DataFrame, company: str, order: list[Column], metrics: list[str]) -> DataFrame:
    """(company, kind, n): of each company's first three amounts those without a raw text, and companies with fewer than three."""
    cells = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(m).alias("value"), F.col(f"{m}_raw").alias("raw")) for k, m in enumerate(metrics)])
    rows = quarters.select(company, F.row_number().over(Window.partitionBy(company).orderBy(*order)).alias("q"), F.inline(cells)).where("value is not null")
    first = rows.withColumn("at", F.row_number().over(Window.partitionBy(company).orderBy("q", "metric"))).where("at <= 3")
    counts = quarters.select(company).distinct().join(first.groupBy(company).agg(F.count("*").alias("checked"), F.count_if(F.coalesce("raw", F.lit("")) == "").alias("bare")), company, "left").na.fill(0)
    kinds = F.filter(F.array(F.struct(F.lit("missing_raw_amount").alias("kind"), F.col("bare").alias("n")), F.struct(F.lit("insufficient_amount_samples").alias("kind"), F.when(F.col("checked") < 3, F.col("checked")).alias("n"))), lambda s: s["n"].isNotNull() & ((s["kind"] != "missing_raw_amount") | (s["n"] > 0)))
    return counts.select(company, F.inline(kinds))
