"""Counts, integrity findings and run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import query, table


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS owners, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS suppliers FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1")
def cross_owner_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that several companies own, with the sorted owners."""
    owners = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("s")).where(F.size("s") > 1)
    return owners.select("l_partkey", F.size("s").cast("bigint").alias("owners"), F.array_join(F.array_sort("s"), ",").alias("suppliers"))


@query("""
SELECT user_id, count(*) FILTER (event_type = 'error') AS timeouts, count(*) FILTER (event_type IN ('click', 'view')) AS rate_limited, count(*) FILTER (value > 50) AS server_errors, count(*) FILTER (event_type = 'purchase' AND value <= 50) AS others FROM events GROUP BY user_id
""")
def error_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional counts by class in one pass."""
    kind, value = F.col("event_type"), F.col("value")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(kind == "error").alias("timeouts"), F.count_if(kind.isin("click", "view")).alias("rate_limited"), F.count_if(value > 50).alias("server_errors"), F.count_if((kind == "purchase") & (value <= 50)).alias("others")
    )


@query("""
SELECT count(*) AS raw, count(DISTINCT text) AS accepted, count(*) - count(DISTINCT text) AS duplicates, greatest(0, count(*) - count(DISTINCT source)) AS excluded, count(DISTINCT source) AS sources, min(doc_id) AS first_id, max(doc_id) AS last_id,
 bool_and(n_chars > 0) AS all_filled FROM documents
""")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-row totals of a run; distinct texts are counted by hash, so no text is shuffled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.sha2("text", 256).alias("t"))
    n, texts, sources = F.count("*"), F.count_distinct("t"), F.count_distinct("source")
    return docs.agg(n.alias("raw"), texts.alias("accepted"), (n - texts).alias("duplicates"), F.greatest(F.lit(0), n - sources).alias("excluded"), sources.alias("sources"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.bool_and(F.col("n_chars") > 0).alias("all_filled"))


@query("""
SELECT r_name, n_name, count(o_orderkey) AS orders, count(DISTINCT c_custkey) AS customers, CAST(sum(CAST(round(coalesce(o_totalprice, 0) * 100) AS BIGINT)) AS BIGINT) AS cents, CAST(grouping(r_name) + grouping(n_name) AS INTEGER) AS level
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ROLLUP (r_name, n_name)
""")
def operation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals per company, group and overall."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("c"))
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    # per customer first: the roll-up then works on customers, not orders
    per = orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("c").alias("c"))
    joined = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.rollup("r_name", "n_name").agg(
        F.sum(F.coalesce("n", F.lit(0))).alias("orders"), F.count_distinct("c_custkey").alias("customers"), F.sum(F.coalesce("c", F.lit(0))).alias("cents"), (F.grouping("r_name") + F.grouping("n_name")).cast("int").alias("level")
    )


@query("""
SELECT 'missing_detail' AS finding, CAST(c_custkey AS VARCHAR) AS key, 1 AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)
UNION ALL SELECT 'unexpected_detail', CAST(user_id AS VARCHAR), count(*) FROM events WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id) GROUP BY user_id
UNION ALL SELECT 'duplicate_id', CAST(o_orderkey AS VARCHAR), count(*) FROM orders GROUP BY o_orderkey HAVING count(*) > 1
UNION ALL SELECT 'case_collision', lower(url), count(*) FROM pages GROUP BY lower(url) HAVING count(*) > 1
UNION ALL SELECT 'forbidden_text', CAST(doc_id AS VARCHAR), 1 FROM documents WHERE regexp_matches(text, '(?i)api[_-]?key|password|[a-z0-9._]+@[a-z0-9.-]+[.][a-z]{2,}')
UNION ALL SELECT 'several_owners', CAST(ps AS VARCHAR), n FROM (SELECT l_orderkey AS ps, count(DISTINCT o_custkey) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey) WHERE n > 1
""")
def integrity_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All integrity findings as one long table."""
    customer, orders, events = (table(spark, sf_dir, t) for t in ("customer", "orders", "events"))
    one = F.lit(1).cast("bigint")
    missing = customer.join(events, F.col("c_custkey") == F.col("user_id"), "left_anti").select(F.lit("missing_detail").alias("finding"), F.col("c_custkey").cast("string").alias("key"), one.alias("n"))
    unexpected = events.join(customer, F.col("c_custkey") == F.col("user_id"), "left_anti").groupBy("user_id").agg(F.count("*").alias("n")).select(F.lit("unexpected_detail").alias("finding"), F.col("user_id").cast("string").alias("key"), "n")
    # an order's least and greatest owner tell whether there are several, so lines only meet the few orders that have more than one
    per_order = orders.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.min("o_custkey").alias("lo"), F.max("o_custkey").alias("hi"))
    twice = per_order.where("n > 1").select(F.lit("duplicate_id").alias("finding"), F.col("o_orderkey").cast("string").alias("key"), "n")
    collide = table(spark, sf_dir, "pages").groupBy(F.lower("url").alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("case_collision").alias("finding"), "key", "n")
    # most texts hold nothing that the pattern could begin at: plain searches come before it
    low = F.lower("text")
    near = F.contains("text", F.lit("@")) | F.contains(low, F.lit("api")) | F.contains(low, F.lit("password"))
    forbidden = table(spark, sf_dir, "documents").where(near & F.rlike("text", F.lit("(?i)api[_-]?key|password|[a-z0-9._]+@[a-z0-9.-]+[.][a-z]{2,}"))).select(F.lit("forbidden_text").alias("finding"), F.col("doc_id").cast("string").alias("key"), one.alias("n"))
    shared = orders.join(per_order.where("lo < hi").select("o_orderkey"), "o_orderkey", "left_semi").groupBy("o_orderkey").agg(F.count_distinct("o_custkey").alias("n"))
    owners = shared.join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select(F.lit("several_owners").alias("finding"), F.col("o_orderkey").cast("string").alias("key"), "n")
    out = missing
    for part in (unexpected, twice, collide, forbidden, owners):
        out = out.unionByName(part)
    return out


@query("SELECT CAST(CAST(ts + INTERVAL 9 HOUR AS DATE) AS VARCHAR) AS usage_day, event_type, count(*) AS calls FROM events GROUP BY 1, 2")
def daily_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls a day, days turning at midnight in Seoul (UTC+9)."""
    day = (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(9))).cast("date")
    return table(spark, sf_dir, "events").groupBy(day.cast("string").alias("usage_day"), "event_type").agg(F.count("*").alias("calls"))
