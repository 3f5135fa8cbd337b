"""Fiscal-series queries: customers' orders as quarterly results of companies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fiscal
from ..operators import series
from .base import query, table

# company = nation of the customer; value in cents, statuses P provisional, F final, O unverified
_SERIES_SQL = """
s AS (SELECT c_custkey, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS qi, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT) - 15000000) AS BIGINT) AS cents
      FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)"""
_LABEL = "(qi // 4) || ' Q' || (qi % 4 + 1)"


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, qi, cents): quarterly result of each customer, often negative and with gaps."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_totalprice")
    known = table(spark, sf_dir, "customer").select("c_custkey")
    index = fiscal.quarter_index(F.year("o_orderdate"), F.quarter("o_orderdate"))
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint") - 15_000_000
    return orders.join(known, "c_custkey").groupBy("c_custkey", index.alias("qi")).agg(F.sum(cents).alias("cents"))


@query(f"WITH {_SERIES_SQL} SELECT c_custkey, CAST(qi AS INTEGER) AS qi, {_LABEL} AS quarter, cents FROM s")
def quarter_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarters(spark, sf_dir).select("c_custkey", "qi", fiscal.quarter_label(F.col("qi")).alias("quarter"), "cents")


_GROWTH = """CASE WHEN p.cents IS NULL OR p.cents = 0 THEN NULL WHEN p.cents < 0 AND s.cents > 0 THEN '흑자전환' WHEN p.cents > 0 AND s.cents < 0 THEN '적자전환'
 WHEN p.cents < 0 AND s.cents < 0 AND s.cents > p.cents THEN '적자축소' WHEN p.cents < 0 AND s.cents < 0 AND s.cents < p.cents THEN '적자확대' WHEN p.cents < 0 AND s.cents < 0 THEN '적자지속' ELSE 'percentage' END"""


@query(f"""WITH {_SERIES_SQL}
SELECT s.c_custkey, CAST(s.qi AS INTEGER) AS qi, s.cents, p.cents AS qoq_base, y.cents AS yoy_base, {_GROWTH} AS qoq, {_GROWTH.replace('p.cents', 'y.cents')} AS yoy
FROM s LEFT JOIN s p ON p.c_custkey = s.c_custkey AND p.qi = s.qi - 1 LEFT JOIN s y ON y.c_custkey = s.c_custkey AND y.qi = s.qi - 4""")
def growth_shift_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarter-over-quarter and year-over-year by value of the quarter before, not by row before."""
    rows = series.shifted(quarters(spark, sf_dir), "c_custkey", "qi", "cents", {"qoq_base": 1, "yoy_base": 4})
    return rows.select("c_custkey", "qi", "cents", "qoq_base", "yoy_base", fiscal.growth_label(F.col("cents"), F.col("qoq_base")).alias("qoq"), fiscal.growth_label(F.col("cents"), F.col("yoy_base")).alias("yoy"))


@query(f"""WITH {_SERIES_SQL}
SELECT s.c_custkey, CAST(s.qi AS INTEGER) AS qi, CASE WHEN p.cents IS NULL THEN '-' WHEN p.cents = 0 THEN CASE WHEN s.cents > 0 THEN '흑자전환' WHEN s.cents < 0 THEN '적자전환' ELSE '변동 없음' END
 WHEN p.cents < 0 AND s.cents > 0 THEN '흑자전환' WHEN p.cents > 0 AND s.cents < 0 THEN '적자전환'
 WHEN p.cents < 0 AND s.cents < 0 THEN CASE WHEN s.cents > p.cents THEN '적자축소' WHEN s.cents < p.cents THEN '적자확대' ELSE '적자지속' END ELSE 'percentage' END AS label
FROM s LEFT JOIN s p ON p.c_custkey = s.c_custkey AND p.qi = s.qi - 1""")
def growth_display_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series.shifted(quarters(spark, sf_dir), "c_custkey", "qi", "cents", {"base": 1})
    return rows.select("c_custkey", "qi", fiscal.display_label(F.col("cents"), F.col("base")).alias("label"))


@query("""
WITH a AS (SELECT l_orderkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS actual, CAST(sum(CAST(round(l_quantity * p_retailprice * 100) AS BIGINT)) AS BIGINT) AS estimate
           FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey)
SELECT l_orderkey, metric, value FROM (
  SELECT l_orderkey, 'actual' AS metric, actual AS value FROM a UNION ALL SELECT l_orderkey, 'estimate', estimate FROM a UNION ALL SELECT l_orderkey, 'difference', actual - estimate FROM a) WHERE value IS NOT NULL
""")
def forecast_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual, estimate and difference as a long chart series; series without an estimate lack its points."""
    cents = lambda c: F.sum(F.round(c * 100).cast("bigint"))
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    wide = joined.groupBy("l_orderkey").agg(cents(F.col("l_extendedprice")).alias("actual"), cents(F.col("l_quantity") * F.col("p_retailprice")).alias("estimate")).withColumn("difference", F.col("actual") - F.col("estimate"))
    return wide.unpivot(["l_orderkey"], ["actual", "estimate", "difference"], "metric", "value").where("value is not null")


@query(f"""WITH {_SERIES_SQL},
l AS (SELECT c_custkey, max(qi) AS latest, count(*) AS n FROM s GROUP BY c_custkey),
w AS (SELECT c_custkey, latest, n, unnest(range(latest - 7, latest + 1)) AS qi FROM l),
m AS (SELECT w.c_custkey, w.latest, w.n, string_agg(CAST(w.qi AS VARCHAR), ',' ORDER BY w.qi) FILTER (s.qi IS NULL) AS missing, count(s.qi) AS inside FROM w LEFT JOIN s ON s.c_custkey = w.c_custkey AND s.qi = w.qi GROUP BY ALL)
SELECT c_custkey, CAST(latest AS INTEGER) AS latest, CAST(n AS INTEGER) AS n_quarters, coalesce(missing, '') AS missing, CASE WHEN inside = 8 THEN 'complete' WHEN inside >= 5 THEN 'with_gap' ELSE 'needs_review' END AS status FROM m""")
def continuity_eight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the last eight quarters each company lacks."""
    rows = series.continuity(quarters(spark, sf_dir), "c_custkey", "qi")
    return rows.withColumn("missing", F.array_join(F.transform("missing", lambda x: x.cast("string")), ","))


_STATUS = {"complete": "complete", "with_gap": "with_gap", "needs_review": "needs_review", "duplicate_quarter": "duplicate_quarter", "no_valid_quarter": "no_valid_quarter"}


@query(f"""WITH {_SERIES_SQL}, l AS (SELECT c_custkey, max(qi) AS latest FROM s GROUP BY c_custkey),
i AS (SELECT l.c_custkey, count(*) AS inside FROM l JOIN s ON s.c_custkey = l.c_custkey AND s.qi BETWEEN l.latest - 7 AND l.latest GROUP BY 1),
t AS (SELECT CASE WHEN inside IS NULL THEN 'no_valid_quarter' WHEN inside = 8 THEN 'complete' WHEN inside >= 5 THEN 'with_gap' ELSE 'needs_review' END AS status FROM customer LEFT JOIN i USING (c_custkey)),
v AS (SELECT unnest(['complete', 'with_gap', 'needs_review', 'duplicate_quarter', 'no_valid_quarter']) AS status)
SELECT v.status, count(t.status) AS companies FROM v LEFT JOIN t ON t.status = v.status GROUP BY v.status""")
def status_counts_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies by completion status, with zeros for statuses that none has."""
    held = series.continuity(quarters(spark, sf_dir), "c_custkey", "qi").select("c_custkey", "status")
    each = table(spark, sf_dir, "customer").select("c_custkey").join(held, "c_custkey", "left").select(F.coalesce("status", F.lit("no_valid_quarter")).alias("status"))
    counts = each.groupBy("status").agg(F.count("*").alias("n"))
    names = spark.createDataFrame([(s,) for s in _STATUS], "status string")
    return names.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("companies"))


_VERSIONS_SQL = """v AS (SELECT o_custkey, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS qi, o_orderkey, o_orderdate, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderpriority,
 CASE o_orderstatus WHEN 'F' THEN false WHEN 'P' THEN true END AS provisional FROM orders)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as versions of (customer, quarter); provisional is null where the status is unknown."""
    orders = table(spark, sf_dir, "orders")
    index = fiscal.quarter_index(F.year("o_orderdate"), F.quarter("o_orderdate"))
    provisional = F.when(F.col("o_orderstatus") == "F", False).when(F.col("o_orderstatus") == "P", True)
    return orders.select("o_custkey", index.alias("qi"), "o_orderkey", "o_orderdate", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"), "o_orderpriority", provisional.alias("provisional"))


@query(f"""WITH {_VERSIONS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, qi ORDER BY coalesce(provisional = false, false) DESC, o_orderdate DESC, o_orderkey DESC) AS k FROM v)
SELECT o_custkey, CAST(qi AS INTEGER) AS qi, o_orderkey, cents, CASE WHEN provisional IS NULL THEN 'latest_unverified' WHEN provisional THEN 'provisional' ELSE 'final' END AS status FROM r WHERE k = 1""")
def version_final_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = series.final_wins(versions(spark, sf_dir), ["o_custkey", "qi"], "provisional", [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])
    return picked.select("o_custkey", "qi", "o_orderkey", "cents", "status")


@query(f"""WITH {_VERSIONS_SQL}, c AS (SELECT *, o_orderpriority = '1-URGENT' AS corrected, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey, qi) AS any_c FROM v),
e AS (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey, qi) AS last_d FROM c WHERE any_c = 0 OR corrected),
n AS (SELECT *, min(cents) OVER (PARTITION BY o_custkey, qi) AS lo, max(cents) OVER (PARTITION BY o_custkey, qi) AS hi, row_number() OVER (PARTITION BY o_custkey, qi ORDER BY cents DESC, o_orderkey) AS k FROM e WHERE o_orderdate = last_d)
SELECT o_custkey, CAST(qi AS INTEGER) AS qi, o_orderkey, cents, CASE WHEN lo <> hi THEN 'same_time_values_differ' END AS conflict FROM n WHERE k = 1""")
def version_corrected_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = versions(spark, sf_dir).withColumn("corrected", F.col("o_orderpriority") == "1-URGENT")
    picked = series.corrected_latest(marked, ["o_custkey", "qi"], "corrected", "o_orderdate", ["cents"], [F.col("cents").desc(), F.col("o_orderkey")])
    return picked.select("o_custkey", "qi", "o_orderkey", "cents", "conflict")


@query(f"WITH {_VERSIONS_SQL} SELECT o_custkey, CAST(qi AS INTEGER) AS qi, count(*) AS n_versions, count(DISTINCT cents) > 1 AS values_differ, count(DISTINCT coalesce(CAST(provisional AS VARCHAR), '?')) > 1 AS status_differs FROM v GROUP BY 1, 2 HAVING count(*) > 1")
def version_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = versions(spark, sf_dir).groupBy("o_custkey", "qi").agg(F.count("*").alias("n_versions"), (F.count_distinct("cents") > 1).alias("values_differ"), (F.count_distinct(F.coalesce(F.col("provisional").cast("string"), F.lit("?"))) > 1).alias("status_differs"))
    return grouped.where("n_versions > 1")


@query(f"""WITH {_VERSIONS_SQL}, d AS (SELECT o_custkey, qi, o_orderpriority, provisional, string_agg(CAST(o_orderkey AS VARCHAR), '+' ORDER BY o_orderkey) AS sources FROM v GROUP BY ALL)
SELECT o_custkey, CAST(qi AS INTEGER) AS qi, count(*) AS n_versions, string_agg(o_orderpriority || ':' || coalesce(CAST(provisional AS VARCHAR), '?') || ':' || sources, ';' ORDER BY o_orderpriority, provisional NULLS FIRST) AS history FROM d GROUP BY 1, 2""")
def history_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of each quarter as nested distinct versions, shown as text."""
    nested = series.version_history(versions(spark, sf_dir), ["o_custkey", "qi"], ["o_orderpriority", "provisional"], "o_orderkey")
    shown = F.transform("history", lambda h: F.concat(h["o_orderpriority"], F.lit(":"), F.coalesce(h["provisional"].cast("string"), F.lit("?")), F.lit(":"), F.array_join(F.transform(h["sources"], lambda s: s.cast("string")), "+")))
    return nested.select("o_custkey", "qi", "n_versions", F.array_join(shown, ";").alias("history"))


@query("""
WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'click' THEN value END AS clicked, CASE WHEN event_type = 'purchase' THEN value END AS bought FROM events)
SELECT user_id, arg_max(clicked, event_id) FILTER (clicked IS NOT NULL) AS clicked, arg_max(bought, event_id) FILTER (bought IS NOT NULL) AS bought FROM e GROUP BY user_id""")
def latest_non_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "click", F.col("value")).alias("clicked"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("bought"))
    return series.latest_non_null(events, "user_id", F.col("event_id"), ["clicked", "bought"])


@query("""
WITH t AS (SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q, l_returnflag FROM lineitem),
a AS (SELECT *, CASE l_returnflag WHEN 'R' THEN '(' || q || '억원)' WHEN 'A' THEN q || '.5 백만 원' ELSE '1,' || q || '00조' END AS raw FROM t)
SELECT l_orderkey, l_linenumber, raw, CASE l_returnflag WHEN 'R' THEN -CAST(q AS BIGINT) * 100000000 WHEN 'A' THEN CAST(q AS BIGINT) * 1000000 + 500000 ELSE CAST('1' || q || '00' AS BIGINT) * 1000000000000 END AS won,
 CASE l_returnflag WHEN 'R' THEN CAST(q AS BIGINT) * 100000000 WHEN 'A' THEN CAST(q AS BIGINT) * 1000000 + 500000 ELSE CAST('1' || q || '00' AS BIGINT) * 1000000000000 END AS forecast_won FROM a""")
def amount_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money texts with units, thousands and parentheses as won."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").cast("string").alias("q"), "l_returnflag")
    raw = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("("), "q", F.lit("억원)"))).when(F.col("l_returnflag") == "A", F.concat("q", F.lit(".5 백만 원"))).otherwise(F.concat(F.lit("1,"), "q", F.lit("00조")))
    rows = lines.select("l_orderkey", "l_linenumber", raw.alias("raw"))
    return rows.withColumns({"won": fiscal.parse_amount(F.col("raw")), "forecast_won": fiscal.parse_amount(F.col("raw"), negative_parentheses=False)})
