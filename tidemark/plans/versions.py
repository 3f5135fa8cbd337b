"""Versions of the customer table as queries: read back at two of them, joined as of a time, repaired from a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import new_path
from ..sources import versions as V
from .base import query, table

_TIMES = ["2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-01-04 12:00:00"]
_VERSIONS = f"""v AS (SELECT c_custkey AS code, c_mktsegment AS segment, c_nationkey AS nation, 1 AS version, TIMESTAMP '{_TIMES[0]}' AS committed_at FROM customer
 UNION ALL SELECT CASE WHEN c_custkey % 13 = 0 THEN c_custkey + 1000000 ELSE c_custkey END, CASE WHEN c_custkey % 3 = 0 THEN 'OTHER' ELSE c_mktsegment END, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey END, 2, TIMESTAMP '{_TIMES[1]}' FROM customer WHERE c_custkey % 10 <> 0
 UNION ALL SELECT c_custkey, 'LAST', c_nationkey, 3, TIMESTAMP '{_TIMES[2]}' FROM customer WHERE c_custkey % 4 = 0)"""


def versioned(spark: SparkSession, sf_dir: str) -> str:
    """Writes three versions of the customers; the path of the table."""
    path = new_path(spark, "versions")
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    second = rows.where(k % 10 != 0).select(F.when(k % 13 == 0, k + 1_000_000).otherwise(k).alias("code"), F.when(k % 3 == 0, "OTHER").otherwise(F.col("segment")).alias("segment"), F.when(k % 7 != 0, F.col("nation")).alias("nation"))
    third = rows.where(k % 4 == 0).select(k.alias("code"), F.lit("LAST").alias("segment"), "nation")
    for number, (part, at) in enumerate(zip((rows.withColumnRenamed("c_custkey", "code"), second, third), _TIMES, strict=True), 1):
        V.write_version(part, path, number, at)
    return path


@query(f"""WITH {_VERSIONS}, a AS (SELECT * FROM v WHERE version = 1), b AS (SELECT * FROM v WHERE version = 2), m AS (SELECT coalesce(a.code, b.code) AS code, a.code AS was, b.code AS now, a.segment AS s1, b.segment AS s2, CAST(a.nation AS VARCHAR) AS n1, CAST(b.nation AS VARCHAR) AS n2 FROM a FULL JOIN b ON a.code = b.code)
SELECT code, CASE WHEN was IS NULL THEN 'added' ELSE 'removed' END AS change, NULL AS column, NULL AS old_value, NULL AS new_value FROM m WHERE was IS NULL OR now IS NULL
UNION ALL SELECT code, 'changed', 'segment', s1, s2 FROM m WHERE was = now AND s1 IS DISTINCT FROM s2 UNION ALL SELECT code, 'changed', 'nation', n1, n2 FROM m WHERE was = now AND n1 IS DISTINCT FROM n2""")
def version_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between two versions of a table, by key and column."""
    path = versioned(spark, sf_dir)
    return V.change_set(V.at_version(spark, path, 1), V.at_time(spark, path, "2024-01-03 00:00:00"), ["code"], ["segment", "nation"])


@query(f"WITH {_VERSIONS} SELECT e.event_id, e.user_id AS code, e.ts, v.segment, v.version FROM events e ASOF LEFT JOIN v ON e.user_id = v.code AND e.ts >= v.committed_at")
def version_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their company as it was then."""
    versions = V.all_versions(spark, versioned(spark, sf_dir))
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("code"), "ts")
    return V.as_of(events, versions, "code", "ts", "committed_at", ["segment", "version"])


@query("""WITH h AS (SELECT o_orderkey AS message, o_custkey AS code FROM orders), r AS (SELECT DISTINCT l_orderkey AS message, o_custkey AS code FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 45)
SELECT code, count(*) FILTER (EXISTS (SELECT 1 FROM r WHERE r.message = h.message AND r.code = h.code)) AS removed, count(*) FILTER (NOT EXISTS (SELECT 1 FROM r WHERE r.message = h.message AND r.code = h.code)) AS kept FROM h WHERE code IN (SELECT code FROM r) GROUP BY code""")
def wrong_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held messages of companies that a repair names: how many go, how many stay."""
    held = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("message"), F.col("o_custkey").alias("code"))
    wrong = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("message")).distinct().join(held, "message")
    kept, removed = V.without_assignments(held, wrong, "code", "message")
    return removed.join(kept.groupBy("code").agg(F.count("*").alias("kept")), "code", "left").na.fill({"kept": 0})


@query(f"WITH {_VERSIONS} SELECT code, segment, nation FROM v WHERE version = 2 AND code % 5 <> 1 UNION ALL SELECT code, segment, nation FROM v WHERE version = 1 AND code % 5 = 1")
def version_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with its damaged companies as an earlier version has them."""
    path = versioned(spark, sf_dir)
    return V.restored(V.at_version(spark, path, 2), V.at_version(spark, path, 1), "code", F.col("code") % 5 == 1)
