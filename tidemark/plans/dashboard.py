"""Dashboard queries: filters, sorts, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import query, table


def news_regions(domestic: Column, international: Column, language: Column) -> Column:
    """Regions of an event: both counts, else the one that is there, else by language."""
    return (
        F.when((domestic > 0) & (international > 0), F.array(F.lit("domestic"), F.lit("international"), F.lit("both")))
        .when(domestic > 0, F.array(F.lit("domestic"))).when(international > 0, F.array(F.lit("international")))
        .otherwise(F.when(F.contains(F.lower(language), F.lit("korean")), F.array(F.lit("domestic"))).otherwise(F.array(F.lit("international"))))
    )


def news_providers(providers: Column) -> Column:
    """Providers of an event, with 'both' if it has both; the second source by default."""
    own = F.when(F.size(F.coalesce(providers, F.array().cast("array<string>"))) > 0, providers).otherwise(F.array(F.lit("gdelt")))
    return F.when(F.array_contains(own, "naver") & F.array_contains(own, "gdelt"), F.array_append(own, F.lit("both"))).otherwise(own)


_EVENTS = """e AS (SELECT user_id, event_type, count(*) AS n, count(*) FILTER (value > 50) AS dom, count(*) FILTER (value <= 50) AS intl, max(ts) AS latest FROM events GROUP BY user_id, event_type)"""


def grouped_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("dom"), F.count_if(F.col("value") <= 50).alias("intl"), F.max("ts").alias("latest"))


@query(f"WITH {_EVENTS}, m AS (SELECT max(latest) AS now FROM e) SELECT user_id, event_type, n, CASE WHEN dom > 0 AND intl > 0 THEN 'domestic,international,both' WHEN dom > 0 THEN 'domestic' ELSE 'international' END AS regions FROM e, m WHERE latest >= now - INTERVAL 7 DAY AND n >= 2")
def dashboard_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the last week with at least two articles, with their regions."""
    rows = grouped_events(spark, sf_dir)
    now = table(spark, sf_dir, "events").agg(F.max("ts").alias("now"))
    kept = rows.crossJoin(F.broadcast(now)).where((F.col("latest") >= F.col("now") - F.make_dt_interval(F.lit(7))) & (F.col("n") >= 2))  # one row
    return kept.select("user_id", "event_type", "n", F.array_join(news_regions(F.col("dom"), F.col("intl"), F.lit("")), ",").alias("regions"))


@query("""
WITH l AS (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS d FROM orders GROUP BY o_custkey)
SELECT c_custkey, CAST(d AS VARCHAR) AS latest_date, row_number() OVER (PARTITION BY c_nationkey ORDER BY d DESC NULLS LAST, c_custkey) AS place FROM customer LEFT JOIN l ON o_custkey = c_custkey
""")
def dashboard_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watch-list order by calendar date of the latest disclosure, missing last, ties in input order, per list (nation)."""
    from pyspark.sql import Window

    latest = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.col("o_orderdate").cast("date")).alias("latest_date"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(latest, "c_custkey", "left")
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.col("latest_date").desc_nulls_last(), "c_custkey"))
    return rows.select("c_custkey", F.col("latest_date").cast("string").alias("latest_date"), place.cast("bigint").alias("place"))


@query("SELECT event_id, ts, value FROM events ORDER BY ts DESC, value DESC, event_id LIMIT 40 OFFSET 40")
def dashboard_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of forty newest events (a top-k)."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    return events.orderBy(F.col("ts").desc(), F.col("value").desc(), "event_id").offset(40).limit(40)


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(c_name || c_custkey), '1') AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def dashboard_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watch-list search in lower-cased name and code with a category."""
    name = F.lower(F.concat("c_name", F.col("c_custkey").cast("string")))
    return table(spark, sf_dir, "customer").where(F.contains(name, F.lit("1")) & F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_name", "c_mktsegment")
