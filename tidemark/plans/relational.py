"""Index, retention, joins, merges and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge, rank
from .base import query, table


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS k FROM events),
t AS (SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY k) AS top_events FROM r WHERE k <= 3 GROUP BY user_id),
a AS (SELECT user_id, count(*) AS event_count, min(ts) AS first_ts, max(ts) AS latest_ts, count(DISTINCT event_type) AS event_types FROM events GROUP BY user_id)
SELECT c_custkey, c_name, coalesce(event_count, 0) AS event_count, first_ts, latest_ts, coalesce(event_types, 0) AS event_types, coalesce(top_events, '') AS top_events
FROM customer LEFT JOIN a ON a.user_id = c_custkey LEFT JOIN t ON t.user_id = c_custkey
""")
def event_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index of all companies with their newest three events and totals."""
    events = table(spark, sf_dir, "events")
    top = rank.top_k(events.select("user_id", "event_id", "ts"), ["user_id"], [F.col("ts").desc_nulls_last(), F.col("event_id")], 3)
    listed = top.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "event_id"))), lambda x: x["event_id"].cast("string")), ",").alias("top_events"))
    totals = events.groupBy("user_id").agg(F.count("*").alias("event_count"), F.min("ts").alias("first_ts"), F.max("ts").alias("latest_ts"), F.count_distinct("event_type").alias("event_types"))
    index = totals.join(listed, "user_id", "left").withColumnRenamed("user_id", "c_custkey")
    joined = table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(index, "c_custkey", "left")
    return joined.select("c_custkey", "c_name", F.coalesce("event_count", F.lit(0)).alias("event_count"), "first_ts", "latest_ts", F.coalesce("event_types", F.lit(0)).alias("event_types"), F.coalesce("top_events", F.lit("")).alias("top_events"))


@query("""
WITH n AS (SELECT max(ts) AS now FROM events),
e AS (SELECT event_id, user_id, ts, event_type, CASE event_type WHEN 'purchase' THEN 'material' WHEN 'click' THEN 'contextual' ELSE 'low' END AS bucket FROM events),
y AS (SELECT e.*, date_diff('second', ts, now) // 86400 AS age FROM e, n),
f AS (SELECT *, CASE bucket WHEN 'material' THEN 20 WHEN 'contextual' THEN 14 ELSE 7 END AS days, CASE bucket WHEN 'material' THEN 10 WHEN 'contextual' THEN 5 ELSE 3 END AS cap FROM y),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, bucket ORDER BY ts DESC, event_id) AS bucket_rank FROM f WHERE age <= days)
SELECT user_id, event_id, bucket, ts, CAST(bucket_rank AS INTEGER) AS bucket_rank FROM r WHERE bucket_rank <= cap
""")
def retention_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest row per event, then age and count limits per company and importance bucket."""
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now_ts"))
    bucket = F.when(F.col("event_type") == "purchase", "material").when(F.col("event_type") == "click", "contextual").otherwise("low")
    rows = events.select("event_id", "user_id", "ts", bucket.alias("bucket")).crossJoin(F.broadcast(now))  # one row
    kept = rank.retained(rows, F.col("now_ts"), group="user_id", key="event_id", time="ts", bucket="bucket", limits={"material": (20, 10), "contextual": (14, 5), "low": (7, 3)})
    return kept.select("user_id", "event_id", "bucket", "ts", "bucket_rank")


@query("SELECT o_custkey, o_orderkey, o_totalprice, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return rank.top_k(orders, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)


@query("SELECT o_custkey, o_orderkey, o_orderdate, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k <= 8")
def last_n_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return rank.top_k(orders, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 8)


@query("""
WITH r AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'en' THEN 0 ELSE 1 END, n_chars DESC, doc_id) AS k FROM documents)
SELECT source, doc_id, n_chars FROM r WHERE k = 1
""")
def representative_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best article of each group by tier, then size, as one partial aggregate."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", "lang")
    return rank.representative(docs, ["source"], [F.when(F.col("lang") == "en", 0).otherwise(1), -F.col("n_chars"), F.col("doc_id")], ["doc_id", "n_chars"])


@query("""
WITH cut AS (SELECT min(o_orderdate) + (max(o_orderdate) - min(o_orderdate)) / 2 AS d FROM orders),
s AS (SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice, o_orderdate >= d AS incoming FROM orders, cut),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY incoming DESC, o_orderkey DESC) AS k FROM s)
SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM r WHERE k = 1
""")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the later half of the time range replace earlier ones of the same key."""
    orders = table(spark, sf_dir, "orders")
    cut = orders.agg((F.min("o_orderdate") + (F.max("o_orderdate") - F.min("o_orderdate")) / 2).alias("cut"))
    split = orders.select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice", "o_orderdate").crossJoin(F.broadcast(cut))  # one row
    columns = ["o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice"]
    return merge.upserted(split.where("o_orderdate < cut").select(*columns), split.where("o_orderdate >= cut").select(*columns), ["o_custkey", "o_orderpriority"], [F.col("o_orderkey").desc()])


@query("""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F'
""")
def partition_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with final orders keep only those; all others keep theirs."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return merge.partition_replaced(orders, orders.where("o_orderstatus = 'F'"), "o_custkey")


@query("""
WITH s AS (SELECT doc_id, text, source, CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS p FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY p, doc_id) AS k FROM s)
SELECT doc_id, source, CAST(p AS INTEGER) AS source_priority FROM r WHERE k = 1
""")
def union_priority_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams united; of equal texts the first stream's, then the smallest id, stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.sha2("text", 256).alias("text_hash"))
    domestic, foreign = docs.where("lang = 'en'"), docs.where("lang <> 'en' or lang is null")
    return merge.union_by_priority([domestic, foreign], ["text_hash"], [F.col("doc_id")]).select("doc_id", "source", "source_priority")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)")
def anti_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(seen, "c_custkey", "left_anti")


@query("SELECT event_id, user_id FROM events WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id)")
def semi_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return table(spark, sf_dir, "events").select("event_id", "user_id").join(known, "user_id", "left_semi").select("event_id", "user_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'P' AND l.l_returnflag = 'R')")
def anti_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows minus a removal set keyed by two columns."""
    removals = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit("R").alias("l_returnflag"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return lines.join(removals, ["l_orderkey", "l_returnflag"], "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""
SELECT coalesce(c.k, o.k) AS k, CASE WHEN c.k IS NULL THEN 'unexpected' WHEN o.k IS NULL THEN 'missing' ELSE 'both' END AS state
FROM (SELECT DISTINCT c_custkey AS k FROM customer) c FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON c.k = o.k
""")
def set_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return merge.reconciled(customers, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("""
WITH s AS (SELECT l_orderkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents, count(*) AS lines FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS stored_cents, CAST(cents AS BIGINT) AS computed_cents,
  CASE WHEN cents IS NULL THEN 'source_missing' WHEN o_totalprice IS NULL THEN 'stored_missing' WHEN CAST(round(o_totalprice * 100) AS BIGINT) = cents THEN 'match'
       WHEN CAST(round(o_totalprice * 100) AS BIGINT) = -cents THEN 'sign_mismatch' WHEN CAST(round(o_totalprice * 100) AS BIGINT) > cents THEN 'stored_larger' ELSE 'stored_smaller' END AS outcome
FROM orders LEFT JOIN s ON l_orderkey = o_orderkey
""")
def value_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored totals against totals recomputed from their lines."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(cents).alias("computed_cents"))
    joined = table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("stored_cents")).join(sums, "o_orderkey", "left")
    stored, computed = F.col("stored_cents"), F.col("computed_cents")
    outcome = F.when(computed.isNull(), "source_missing").when(stored.isNull(), "stored_missing").when(stored == computed, "match").when(stored == -computed, "sign_mismatch").when(stored > computed, "stored_larger").otherwise("stored_smaller")
    return joined.select("o_orderkey", "stored_cents", "computed_cents", outcome.alias("outcome"))


@query("""
WITH d AS (SELECT c_name, count(*) AS n FROM customer GROUP BY c_name)
SELECT c_custkey, CASE WHEN n_nationkey IS NULL THEN 'not_found' WHEN d.n > 1 THEN 'duplicate_name' WHEN c_acctbal < 0 THEN 'corrected' ELSE 'verified' END AS validation, n_name, r_name
FROM customer JOIN d USING (c_name) LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
""")
def validate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs against official records by code, with duplicate names found."""
    customer = table(spark, sf_dir, "customer")
    names = customer.groupBy("c_name").agg(F.count("*").alias("n"))
    official = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    joined = customer.join(names, "c_name").join(official, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    state = F.when(F.col("n_nationkey").isNull(), "not_found").when(F.col("n") > 1, "duplicate_name").when(F.col("c_acctbal") < 0, "corrected").otherwise("verified")
    return joined.select("c_custkey", state.alias("validation"), "n_name", "r_name")


@query("""
WITH t AS (SELECT DISTINCT lower(p_brand) AS code, lower(w) AS term FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS w FROM part) UNION SELECT DISTINCT lower(p_brand), lower(p_name) FROM part)
SELECT a.code, list_sort(list(DISTINCT b.term)) AS x FROM t a JOIN t b ON a.code <> b.code AND contains(b.term, a.term) AND b.term <> a.term GROUP BY a.code
""".replace("list_sort(list(DISTINCT b.term)) AS x", "CAST(count(DISTINCT b.term) AS BIGINT) AS excluded_terms, min(b.term) AS first_term, max(b.term) AS last_term"))
def containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of other companies that strictly contain an own term.

    Containment needs no cross join: every term is cut into its substrings once, at the lengths that
    terms have, and substrings join terms by equality.
    """
    part = table(spark, sf_dir, "part")
    words = part.select(F.lower("p_brand").alias("code"), F.explode(F.concat(F.split("p_name", " "), F.array("p_name"))).alias("term"))
    terms = words.select("code", F.lower("term").alias("term")).distinct()
    longer = terms.select("term").distinct()
    pieces = longer.select(F.col("term").alias("outer_term"), F.explode(F.sequence(F.lit(1), F.length("term"))).alias("i")).select("outer_term", "i", F.explode(F.sequence(F.lit(1), F.length("outer_term") - F.col("i") + 1)).alias("n"))
    inner = pieces.select("outer_term", F.expr("substring(outer_term, i, n)").alias("term")).where("term <> outer_term").distinct()
    contained = inner.join(longer, "term", "left_semi")
    own = terms.join(contained, "term").select("code", "outer_term")
    other = terms.select(F.col("code").alias("other_code"), F.col("term").alias("outer_term"))
    hits = own.distinct().join(other, "outer_term").where("code <> other_code")
    return hits.groupBy("code").agg(F.count_distinct("outer_term").alias("excluded_terms"), F.min("outer_term").alias("first_term"), F.max("outer_term").alias("last_term"))


@query("""
SELECT a.user_id, a.event_id AS a_event, b.event_id AS b_event, date_diff('second', a.ts, b.ts) AS seconds FROM events a JOIN events b
ON a.user_id = b.user_id AND (a.ts < b.ts OR (a.ts = b.ts AND a.event_id < b.event_id)) AND date_diff('second', a.ts, b.ts) <= 259200
""")
def band_join_72h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a company's events at most 72 hours apart, by time bands."""
    from ..operators.articles import pairs_within

    pairs = pairs_within(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", "event_id", "ts", 259_200, [])
    seconds = F.unix_timestamp(F.col("b_ts").cast("timestamp")) - F.unix_timestamp(F.col("a_ts").cast("timestamp"))
    return pairs.select("user_id", F.col("a_event_id").alias("a_event"), F.col("b_event_id").alias("b_event"), seconds.alias("seconds"))


@query("""
WITH a AS (SELECT c_custkey AS k, c_name, c_acctbal, c_mktsegment FROM customer),
b AS (SELECT c_custkey AS k, c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_mktsegment <> 'MACHINERY'
      UNION ALL SELECT -s_suppkey, s_name, s_acctbal, 'NEW' FROM supplier)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k
WHERE a.k IS NULL OR b.k IS NULL OR a.c_name IS DISTINCT FROM b.c_name OR a.c_acctbal IS DISTINCT FROM b.c_acctbal OR a.c_mktsegment IS DISTINCT FROM b.c_mktsegment
""")
def change_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed keys between two versions of a table."""
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name", "c_acctbal", "c_mktsegment")
    edited = old.where("c_mktsegment <> 'MACHINERY'").withColumn("c_acctbal", F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    added = table(spark, sf_dir, "supplier").select((-F.col("s_suppkey")).alias("k"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"), F.lit("NEW").alias("c_mktsegment"))
    return merge.changed(old, edited.unionByName(added), "k", ["c_name", "c_acctbal", "c_mktsegment"])


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') IS NULL AS missing FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested JSON text read under an explicit schema."""
    parsed = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").select("event_id", parsed.alias("k"), parsed.isNull().alias("missing"))
