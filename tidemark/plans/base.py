"""Registration of queries and the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with SQL that gives the same rows where there is one."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


#: Tables of whole texts: what is done to them is dear, so a scan of few splits is spread over all cores.
TEXTS = ("documents", "pages")


def spread(rows: DataFrame) -> DataFrame:
    """Rows over all cores where they have fewer splits: what is done to each is dear."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows over all cores by their key, whatever their splits: a Parquet file's splits are empty but where a row group begins."""
    return rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism, key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in TEXTS else rows
