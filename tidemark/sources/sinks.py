"""Sinks: partitioned tables per company, changed partitions only, staged publication, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import exists

# Fields that must not reach a public table.
FORBIDDEN_FIELDS = ["body", "content", "html", "summary", "description", "image", "thumbnail"]


def assert_public(df: DataFrame, forbidden: Sequence[str] = FORBIDDEN_FIELDS, codes: Sequence[str] = ("stock_code",)) -> DataFrame:
    """Walks the schema: no forbidden or underscored field, codes are strings; returns the table as it is."""

    def walk(kind, path: str) -> list[str]:
        if kind.typeName() == "struct":
            return [p for f in kind.fields for p in ([f"{path}{f.name}"] if f.name in forbidden or f.name.startswith("_") or (f.name in codes and f.dataType.typeName() != "string") else walk(f.dataType, f"{path}{f.name}."))]
        return walk(kind.elementType, path) if kind.typeName() == "array" else []

    found = walk(df.schema, "")
    if found:
        raise ValueError(f"Fields that must not be published: {sorted(found)}")
    return df


def write_partitions(df: DataFrame, path: str, partition: str = "stock_code") -> None:
    """Replaces only the partitions that ``df`` has rows of; a company without rows keeps its files."""
    assert_public(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def changed_partitions(df: DataFrame, path: str, partition: str = "stock_code") -> DataFrame:
    """Rows of ``df`` in partitions whose content differs from what ``path`` holds, by an order-free hash."""
    spark = df.sparkSession
    columns = [c for c in df.columns if c != partition]
    digest = lambda d: d.groupBy(partition).agg(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("h"), F.count("*").alias("n"))
    if not exists(spark, path):
        return df
    held = digest(spark.read.schema(df.schema).parquet(path)).select(F.col(partition), F.col("h").alias("old_h"), F.col("n").alias("old_n"))
    differs = digest(df).join(held, partition, "left").where("old_h is null or old_h <> h or old_n <> n")
    return df.join(differs.select(partition), partition, "left_semi").select(df.columns)


def write_if_changed(df: DataFrame, path: str, partition: str = "stock_code") -> None:
    """Writes changed partitions only; the comparison is written to a side folder first, as a table can't be read while it is replaced."""
    side = f"{path.rstrip('/')}__staged"
    changed_partitions(df, path, partition).write.mode("overwrite").parquet(side)
    spark = df.sparkSession
    write_partitions(spark.read.schema(df.schema).parquet(side), path, partition)


def publish(spark: SparkSession, staging: str, target: str, findings: DataFrame, partition: str = "stock_code") -> bool:
    """Staged publication: the staged table replaces its partitions of the target only if there are no findings."""
    if not findings.isEmpty():
        return False
    write_partitions(spark.read.parquet(staging), target, partition)
    return True


def with_templates(companies: DataFrame, details: DataFrame, key: str = "stock_code") -> DataFrame:
    """Details with an empty row for each company that has none."""
    missing = companies.select(key).join(details, key, "left_anti")
    return details.unionByName(missing, allowMissingColumns=True)


def write_report(df: DataFrame, path: str) -> None:
    """A one-row report as JSON."""
    df.limit(1).coalesce(1).write.mode("overwrite").json(path)


def json_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Bytes of the JSON files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def write_private_samples(messages: DataFrame, path: str, key: str = "stock_code", message: str = "id", text: str = "text") -> None:
    """Raw texts below a private folder, one folder for each company and message; messages that come again replace theirs."""
    rows = messages.select(F.coalesce(F.col(text), F.lit("")).alias("value"), F.col(key), F.col(message))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("lineSep", "\u0000").partitionBy(key, message).text(path)


def read_private_samples(spark: SparkSession, path: str) -> DataFrame:
    """The texts of ``write_private_samples`` with the folders' columns as strings."""
    with_kinds = spark.read.text(path, wholetext=True)
    columns = [F.col(c).cast("string").alias(c) for c in with_kinds.columns if c != "value"]
    return with_kinds.select(F.regexp_replace("value", "\u0000$", "").alias("text"), *columns)
