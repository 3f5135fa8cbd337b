"""Portfolio, audit and review queries: companies, gates, accounting, quality, refresh and report totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fiscal
from ..operators import audits as U
from ..operators import companies as C
from .base import query, table

_INPUTS = """i AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS stock_code, c_name AS company_name, n_name AS category, CASE c_mktsegment WHEN 'BUILDING' THEN 'core' WHEN 'AUTOMOBILE' THEN 'watch' ELSE 'background' END AS tier,
 CASE WHEN c_acctbal < 0 THEN 'rejected' WHEN c_acctbal < 5000 THEN 'verified' ELSE 'corrected' END AS validation, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN c_name ELSE c_name || ' Inc' END AS official, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS market
 FROM customer JOIN nation ON n_nationkey = c_nationkey)"""


def company_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Inputs, validation and category keywords made of customers and nations."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    code = F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("stock_code")
    tier = F.when(F.col("c_mktsegment") == "BUILDING", "core").when(F.col("c_mktsegment") == "AUTOMOBILE", "watch").otherwise("background")
    inputs = rows.select(code, F.col("c_name").alias("company_name"), F.col("n_name").alias("category"), tier.alias("monitoring_tier"))
    status = F.when(F.col("c_acctbal") < 0, "rejected").when(F.col("c_acctbal") < 5000, "verified").otherwise("corrected")
    official = F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, F.col("c_name")).otherwise(F.concat("c_name", F.lit(" Inc")))
    validation = rows.select(code, status.alias("validation_status"), official.alias("official_company_name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("market"))
    words = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_name").alias("category"), F.array(F.lower("n_name"), F.lit("earnings"), F.lit("export")).alias("keywords"))
    return inputs, validation, words


@query(f"""WITH {_INPUTS} SELECT stock_code, CASE WHEN official = '' THEN company_name ELSE official END AS company_name, CASE WHEN market = '' THEN category ELSE market END AS sector, tier AS monitoring_tier,
 CASE WHEN official IN ('', company_name) THEN company_name ELSE official || '|' || company_name END AS aliases, CASE WHEN validation = 'rejected' THEN 'inactive' ELSE 'active' END AS status, validation <> 'rejected' AS news_enabled,
 CASE tier WHEN 'core' THEN 5 WHEN 'watch' THEN 3 ELSE 1 END AS naver_query_budget, CASE tier WHEN 'core' THEN 2 ELSE 1 END AS gdelt_query_budget, CASE WHEN n_nationkey < 20 THEN lower(category) || '|earnings|export' ELSE '' END AS keywords
 FROM i JOIN nation ON n_name = category""")
def company_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Onboarded companies: names united, budgets by tier, active where validated."""
    rows = C.built_companies(*company_inputs(spark, sf_dir))
    return rows.select("stock_code", "company_name", "sector", "monitoring_tier", F.array_join("aliases", "|").alias("aliases"), "status", "news_enabled", "naver_query_budget", "gdelt_query_budget", F.array_join("important_keywords", "|").alias("keywords"))


@query(f"WITH {_INPUTS} SELECT stock_code, tier AS monitoring_tier FROM i WHERE validation <> 'rejected'")
def active_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies that flows may work on."""
    return C.active_companies(C.built_companies(*company_inputs(spark, sf_dir))).select("stock_code", "monitoring_tier")


@query("""WITH g AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN MAP {'news_limit': '9', 'tier': NULL} WHEN 1 THEN MAP {'tier': 'core'} ELSE MAP {'x': 'y'} END AS m FROM customer)
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '9' ELSE '5' END AS news_limit, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'core' ELSE 'background' END AS tier, 3 + (c_custkey % 3 = 2)::INT - 1 AS n_keys FROM g""")
def company_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings with defaults below them: a given null stays null."""
    k, text = F.col("c_custkey") % 3, "map<string,string>"
    given = F.when(k == 0, F.from_json(F.lit('{"news_limit":"9","tier":null}'), text)).when(k == 1, F.from_json(F.lit('{"tier":"core"}'), text)).otherwise(F.from_json(F.lit('{"x":"y"}'), text))
    merged = C.with_defaults(given, F.from_json(F.lit('{"news_limit":"5","tier":"background"}'), text))
    return table(spark, sf_dir, "customer").select("c_custkey", merged.alias("m")).select("c_custkey", F.try_element_at("m", F.lit("news_limit")).alias("news_limit"), F.try_element_at("m", F.lit("tier")).alias("tier"), F.size("m").alias("n_keys"))


@query(f"""WITH {_INPUTS}, a AS (SELECT *, lower(category) AS word, CASE tier WHEN 'core' THEN 5 WHEN 'watch' THEN 3 ELSE 1 END AS budget, validation = 'corrected' AS ambiguous FROM i)
SELECT stock_code, CASE WHEN ambiguous THEN '("' || company_name || '") AND ("' || stock_code || '" OR "' || category || '")' ELSE '("' || company_name || '")' END AS by_alias,
 array_to_string((CASE WHEN ambiguous THEN ['"' || company_name || '" ' || category, '"' || company_name || '" ' || stock_code] ELSE [company_name] END || ['"' || company_name || '" ' || word, '"' || company_name || '" export'])[1:budget], ';') AS by_name FROM a""")
def source_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries that go to the two sources."""
    inputs, validation, _ = company_inputs(spark, sf_dir)
    rows = inputs.join(validation, "stock_code")
    ambiguous = F.col("validation_status") == "corrected"
    by_alias = C.alias_query(F.array("company_name"), ambiguous, F.array("stock_code", "category"))
    words = F.array(F.lower("category"), F.lit("Earnings "), F.lit(" "), F.lit(" export"))
    by_name = C.name_queries(F.col("company_name"), ambiguous, F.col("category"), F.col("stock_code"), words, C.budget_of(F.col("monitoring_tier"), 0))
    return rows.select("stock_code", by_alias.alias("by_alias"), F.array_join(by_name, ";").alias("by_name"))


@query("""WITH s AS (SELECT page_id, regexp_extract(url, '([a-z]+)/?$', 1) AS provider, least(100, (CASE WHEN regexp_matches(lower(html), '<title>[^<]*\\bthe\\b') THEN 80 WHEN regexp_matches(lower(html), '<title>[^<]*\\bde\\b') THEN 35 ELSE 0 END)
 + least(20, 4 * ((CASE WHEN contains(html, 'ing') THEN 1 ELSE 0 END) + (CASE WHEN contains(html, 'tion') THEN 1 ELSE 0 END)))) AS score FROM pages)
SELECT provider, score >= 60 AS kept, count(*) AS articles, CAST(min(score) AS INTEGER) AS least_score FROM s GROUP BY ALL""")
def relevance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles by source that reach the relevance of 60, and those that do not."""
    html = F.lower("html")
    base = F.when(F.rlike(html, F.lit(r"<title>[^<]*\bthe\b")), 80).when(F.rlike(html, F.lit(r"<title>[^<]*\bde\b")), 35).otherwise(0)
    hits = sum((F.contains("html", F.lit(w)).cast("int") for w in ("ing", "tion")), F.lit(0))
    rows = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "([a-z]+)/?$", 1).alias("provider"), F.least(F.lit(100), base + F.least(F.lit(20), 4 * hits)).alias("score"))
    return rows.groupBy("provider", (F.col("score") >= 60).alias("kept")).agg(F.count("*").alias("articles"), F.min("score").cast("int").alias("least_score"))


_PRICES = """q AS (SELECT l_suppkey AS company, year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS qi, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, min(l_linestatus) AS line, max(l_returnflag) AS flag FROM lineitem GROUP BY ALL)"""


def supplier_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters of suppliers: company, qi, cents, line, flag."""
    index = fiscal.quarter_index(F.year("l_shipdate"), F.quarter("l_shipdate"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("company"), index.alias("qi")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"), F.min("l_linestatus").alias("line"), F.max("l_returnflag").alias("flag"))


@query(f"""WITH {_PRICES}, c AS (SELECT l_suppkey AS company, year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS qi, l_returnflag, l_linestatus, l_discount FROM lineitem),
s AS (SELECT company, count(DISTINCT CASE WHEN line IN ('O', 'F') THEN line END) > 1 AS basis_mixed, count(DISTINCT flag) > 1 AS metric_mixed, count(*) FILTER (flag = 'R') AS corrected FROM q GROUP BY company),
m AS (SELECT company, count(*) AS mixed_status FROM (SELECT company, qi FROM c WHERE l_linestatus = 'F' GROUP BY company, qi HAVING count(DISTINCT l_returnflag) > 1) GROUP BY company),
u AS (SELECT company, bool_or(l_discount > 0.09) AS cumulative FROM c GROUP BY company)
SELECT s.company, basis_mixed, metric_mixed, false AS annual_as_quarter, corrected, coalesce(mixed_status, 0) AS mixed_status, cumulative FROM s LEFT JOIN m ON m.company = s.company JOIN u ON u.company = s.company""")
def accounting_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes of basis, metric and status of each company."""
    basis = F.when(F.col("line") == "O", "consolidated").when(F.col("line") == "F", "separate")
    selected = supplier_quarters(spark, sf_dir).select("company", basis.alias("basis"), F.col("flag").alias("metric_basis"), (F.col("flag") == "R").alias("corrected"), F.col("qi").alias("quarter_index"))
    lines = table(spark, sf_dir, "lineitem").withColumn("company", F.col("l_suppkey"))
    index = fiscal.quarter_index(F.year("l_shipdate"), F.quarter("l_shipdate"))
    found = lines.select("company", index.alias("fiscal_quarter"), F.col("l_returnflag").alias("status"), (F.col("l_linestatus") == "F").alias("is_current"))
    return U.accounting_audit(selected, found, lines.select("company", (F.col("l_discount") > 0.09).alias("cumulative")), "company")


@query(f"""WITH {_PRICES}, l AS (SELECT company, max_by(flag, qi) AS flag, max(qi) AS qi FROM q GROUP BY company) SELECT CASE flag WHEN 'A' THEN 'historical' WHEN 'N' THEN 'final' ELSE 'unknown' END AS status, count(*) AS companies, CAST(max(qi) AS INTEGER) AS latest FROM l GROUP BY 1""")
def latest_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies by the status of their latest quarter."""
    last = supplier_quarters(spark, sf_dir).groupBy("company").agg(F.max_by("flag", "qi").alias("flag"), F.max("qi").alias("qi"))
    raw = F.when(F.col("flag") == "A", "historical_reference").when(F.col("flag") == "N", "final").otherwise("other")
    return last.groupBy(U.latest_status(raw).alias("status")).agg(F.count("*").alias("companies"), F.max("qi").cast("int").alias("latest"))


@query(f"WITH {_PRICES}, r AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY qi DESC) AS k, count(*) OVER (PARTITION BY company) AS n FROM q) SELECT company, CAST(qi AS INTEGER) AS qi, cents, CAST(k AS INTEGER) AS at FROM r WHERE n < 8 OR k IN (1, 5) OR k = n")
def audit_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last, fifth last and first quarter of each company."""
    return U.sampled_quarters(supplier_quarters(spark, sf_dir), "company", "qi").select("company", "qi", "cents", "at")


@query(f"WITH {_PRICES}, g AS (SELECT a.company, a.qi, a.cents - b.cents AS change FROM q a JOIN q b ON a.company = b.company AND a.qi = b.qi + 4) SELECT company, CAST(qi AS INTEGER) AS qi, change FROM g ORDER BY company, qi LIMIT 30")
def growth_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thirty growth checks in order (the cut is the feature)."""
    rows = supplier_quarters(spark, sf_dir)
    before = rows.select("company", (F.col("qi") + 4).alias("qi"), F.col("cents").alias("base"))
    return rows.join(before, ["company", "qi"]).select("company", "qi", (F.col("cents") - F.col("base")).alias("change")).orderBy("company", "qi").limit(30)


@query(f"""WITH {_PRICES}, p AS (SELECT company, qi, row_number() OVER (PARTITION BY company ORDER BY (qi * 7) % 5, qi) AS place FROM q WHERE qi >= (SELECT max(qi) - 8 FROM q) AND (company + qi) % 11 <> 0),
x AS (SELECT *, lag(qi) OVER (PARTITION BY company ORDER BY place) AS b FROM p), c AS (SELECT company, count(*) AS n, count(DISTINCT qi) AS d, bool_or(coalesce(qi < b, false)) AS unordered, max_by(qi, place) AS latest, list(DISTINCT qi) AS found FROM x GROUP BY company),
m AS (SELECT *, len(list_filter(range(latest - 7, latest + 1), lambda v: NOT list_contains(found, v))) AS missing FROM c)
SELECT CASE WHEN n > d THEN 'duplicate_quarter' WHEN unordered THEN 'quarter_order_issue' WHEN n = 8 AND missing = 0 THEN 'complete_8q_continuous' WHEN n = 8 THEN 'complete_8q_with_gap' ELSE 'needs_review' END AS status, count(*) AS companies, CAST(sum(missing) AS BIGINT) AS missing FROM m GROUP BY 1""")
def continuity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuity of the eight quarters by status: duplicates, order, gaps."""
    rows = supplier_quarters(spark, sf_dir)
    last = rows.agg((F.max("qi") - 8).alias("from_qi"))
    kept = rows.crossJoin(F.broadcast(last)).where("qi >= from_qi and (company + qi) % 11 <> 0")  # one row
    placed = kept.withColumn("place", F.row_number().over(Window.partitionBy("company").orderBy((F.col("qi") * 7) % 5, "qi")))
    held = U.continuity(placed, "company", "qi", "place")
    return held.groupBy("status").agg(F.count("*").alias("companies"), F.sum(F.size("missing")).alias("missing"))


@query("""WITH p AS (SELECT l_orderkey AS cluster_id, min(l_returnflag) AS reason FROM lineitem WHERE l_quantity > 45 GROUP BY 1), f AS (SELECT l_orderkey AS cluster_id, min(l_linestatus) AS reason FROM lineitem WHERE l_discount > 0.09 GROUP BY 1),
u AS (SELECT *, false AS is_new FROM p UNION ALL SELECT *, true FROM f WHERE cluster_id NOT IN (SELECT cluster_id FROM p)) SELECT reason, is_new, count(*) AS events, min(cluster_id) AS first_id FROM u GROUP BY ALL""")
def quality_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed events by reason over audits, each id once."""
    lines = table(spark, sf_dir, "lineitem").withColumn("cluster_id", F.col("l_orderkey"))
    previous = lines.where("l_quantity > 45").groupBy("cluster_id").agg(F.min("l_returnflag").alias("reason"))
    found = lines.where("l_discount > 0.09").groupBy("cluster_id").agg(F.min("l_linestatus").alias("reason"))
    return U.merged_removals(previous, found).groupBy("reason", "is_new").agg(F.count("*").alias("events"), F.min("cluster_id").alias("first_id"))


@query("""WITH a AS (SELECT l_orderkey AS message_id, l_suppkey AS target, max(l_returnflag) AS reason FROM lineitem WHERE l_quantity > 40 GROUP BY ALL), b AS (SELECT l_orderkey AS message_id, l_suppkey AS target, 'duplicate' AS reason FROM lineitem WHERE l_discount > 0.08 GROUP BY ALL)
SELECT message_id, target, coalesce(b.reason, a.reason) AS reason FROM a FULL JOIN b USING (message_id, target)""")
def quarantine_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarantine records of two audits, the later one of each message and target."""
    rows = table(spark, sf_dir, "lineitem").withColumns({"message_id": F.col("l_orderkey"), "target": F.col("l_suppkey")})
    first = rows.where("l_quantity > 40").select("message_id", "target", F.col("l_returnflag").alias("reason"))
    second = rows.where("l_discount > 0.08").select("message_id", "target", F.lit("duplicate").alias("reason"))
    return U.merged_quarantine([first, second])


@query("""WITH r AS (SELECT user_id, max(ts) AS completed_at, bool_or(event_type = 'purchase') AS changed, max(ts) FILTER (event_type = 'click') AS e, max(ts) FILTER (event_type = 'view') AS d, max(ts) FILTER (event_type = 'signup') AS n FROM events GROUP BY user_id),
s AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '2020-01-01' END AS last_content FROM customer)
SELECT r.user_id, completed_at AS last_success, CASE WHEN changed THEN completed_at ELSE coalesce(last_content, greatest(e, d, n)) END AS last_content FROM r LEFT JOIN s ON s.user_id = r.user_id""")
def refresh_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each company was last refreshed, and when its content last changed."""
    events, when = table(spark, sf_dir, "events"), lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts")))
    runs = events.groupBy("user_id").agg(F.max("ts").alias("completed_at"), F.bool_or(F.col("event_type") == "purchase").alias("changed"), when("click").alias("earnings_at"), when("view").alias("disclosures_at"), when("signup").alias("news_at"))
    even = F.when(F.col("c_custkey") % 2 == 0, F.lit("2020-01-01").cast(events.schema["ts"].dataType))
    return U.refreshed(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), even.alias("last_content")), runs, "user_id")


@query("""WITH r AS (SELECT event_id, user_id, event_type, ts, CASE user_id % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'watch' ELSE 'background' END AS tier, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS k FROM events)
SELECT event_id, user_id, CAST(k AS INTEGER) AS place FROM r WHERE CASE tier WHEN 'core' THEN k <= 3 WHEN 'watch' THEN k <= 1 ELSE event_type IN ('purchase', 'error') END""")
def review_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News that a review shows, as many as the company's tier allows."""
    level = F.when(F.col("event_type") == "purchase", "critical").when(F.col("event_type") == "error", "important").otherwise("low")
    tier = F.when(F.col("user_id") % 3 == 0, "core").when(F.col("user_id") % 3 == 1, "watch").otherwise("background")
    rows = table(spark, sf_dir, "events").withColumn("level", level)
    return U.review_news(rows, "user_id", tier, "level", [F.col("ts").desc(), F.col("event_id")]).select("event_id", "user_id", "place")


@query("""WITH o AS (SELECT o_custkey AS company, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS q, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS a, CASE WHEN o_orderkey % 2 = 0 AND o_orderstatus <> 'P' THEN o_orderkey END AS b, o_orderpriority AS raw FROM orders),
c AS (SELECT company, q, 0 AS m, CASE WHEN raw LIKE '1%' THEN '' ELSE raw END AS raw FROM o WHERE a IS NOT NULL UNION ALL SELECT company, q, 1, NULL FROM o WHERE b IS NOT NULL), f AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY q, m) AS k FROM c),
s AS (SELECT o.company, count(f.k) AS checked, count(f.k) FILTER (coalesce(raw, '') = '') AS bare FROM (SELECT DISTINCT company FROM o) o LEFT JOIN f ON f.company = o.company AND k <= 3 GROUP BY 1)
SELECT company, 'missing_raw_amount' AS kind, bare AS n FROM s WHERE bare > 0 UNION ALL SELECT company, 'insufficient_amount_samples', checked FROM s WHERE checked < 3""")
def amount_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three amounts of each company need their raw text."""
    p = F.col("o_orderpriority")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("company"), "o_orderdate", "o_orderkey", F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("revenue"), F.when(p.startswith("1"), "").otherwise(p).alias("revenue_raw"),
        F.when((F.col("o_orderkey") % 2 == 0) & (F.col("o_orderstatus") != "P"), F.col("o_orderkey")).cast("double").alias("profit"), F.lit(None).cast("string").alias("profit_raw"),
    )
    return U.amount_sanity(rows, "company", [F.col("o_orderdate"), F.col("o_orderkey")], ["revenue", "profit"])


@query("SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS failures, count(DISTINCT year(l_shipdate) * 4 + quarter(l_shipdate)) AS quarters, count(*) AS rows FROM lineitem GROUP BY l_suppkey")
def company_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures and distinct quarters of each company."""
    quarter = F.year("l_shipdate") * 4 + F.quarter("l_shipdate")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("failures"), F.count_distinct(quarter).alias("quarters"), F.count("*").alias("rows"))


@query("""SELECT count(*) AS files, count(*) FILTER (text = '') AS empty, count(*) FILTER (n_chars > 4000) AS uncertain, count(*) - count(DISTINCT md5(text)) AS duplicates, count(DISTINCT lang) AS encodings, CAST(round(avg(n_chars), 3) AS DOUBLE) AS mean_chars, count(DISTINCT CASE WHEN n_chars > 100 THEN source END) AS matched FROM documents""")
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over all files: empty, uncertain, repeated, encodings; one row."""
    docs = table(spark, sf_dir, "documents").select("text", "n_chars", "lang", "source", F.md5("text").alias("h"))
    n = F.count("*")
    return docs.agg(
        n.alias("files"), F.count_if(F.col("text") == "").alias("empty"), F.count_if(F.col("n_chars") > 4000).alias("uncertain"), (n - F.count_distinct("h")).alias("duplicates"), F.count_distinct("lang").alias("encodings"),
        F.round(F.avg("n_chars"), 3).alias("mean_chars"), F.count_distinct(F.when(F.col("n_chars") > 100, F.col("source"))).alias("matched"),
    )


@query("SELECT event_type, count(*) AS calls, count(DISTINCT event_id) AS distinct_ids, count(DISTINCT user_id) AS companies, CAST(round(count(*) / count(DISTINCT user_id), 6) AS DOUBLE) AS calls_per_company, CAST(round(avg(value), 4) AS DOUBLE) AS mean_value FROM events GROUP BY event_type")
def scenario_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of runs: calls a company, mean value."""
    n, who = F.count("*"), F.count_distinct("user_id")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(n.alias("calls"), F.count_distinct("event_id").alias("distinct_ids"), who.alias("companies"), F.round(n / who, 6).alias("calls_per_company"), F.round(F.avg("value"), 4).alias("mean_value"))


@query("""WITH r AS (SELECT p_brand, CASE WHEN p_type LIKE '%STEEL' THEN 'a' WHEN p_type LIKE '%TIN' THEN 'b' END AS old, CASE WHEN p_type LIKE '%STEEL' THEN 'a' WHEN p_type LIKE 'PROMO%' THEN 'b' END AS new FROM part)
SELECT p_brand, count(*) AS rows, count(*) FILTER (old IS DISTINCT FROM new) AS changed, count(*) FILTER (new IS NULL) AS unlabelled FROM r GROUP BY p_brand""")
def reclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a new classification changes."""
    kind = F.col("p_type")
    old = F.when(kind.endswith("STEEL"), "a").when(kind.endswith("TIN"), "b")
    new = F.when(kind.endswith("STEEL"), "a").when(kind.startswith("PROMO"), "b")
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("rows"), F.count_if(~old.eqNullSafe(new)).alias("changed"), F.count_if(new.isNull()).alias("unlabelled"))


@query("SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') || '+09:00' AS seoul, CAST(round(value * 100000000) AS BIGINT) / 100000000.0 AS eok, CAST(ts AS VARCHAR) IS NOT NULL AS timed FROM events")
def seoul_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in Seoul as ISO texts, amounts in units of 100 million."""
    local = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(9))
    won = F.round(F.col("value") * 100_000_000).cast("bigint")
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00")).alias("seoul"), fiscal.to_eok(won).alias("eok"), F.col("ts").isNotNull().alias("timed"))


def canonical_category(value: Column) -> Column:
    """Both names of earnings are one; nothing is 'other'."""
    return F.when(value.isin("실적", "performance"), "earnings").otherwise(F.coalesce(F.nullif(value, F.lit("")), F.lit("기타")))


@query("""WITH d AS (SELECT o_orderkey, o_custkey, o_orderdate, CASE o_orderpriority WHEN '1-URGENT' THEN '실적' WHEN '2-HIGH' THEN 'performance' WHEN '3-MEDIUM' THEN '' WHEN '5-LOW' THEN NULL ELSE '배당' END AS c FROM orders)
SELECT o_orderkey, CASE WHEN c IN ('실적', 'performance') THEN 'earnings' ELSE coalesce(nullif(c, ''), '기타') END AS category, CASE WHEN c IN ('실적', 'performance') THEN '실적' ELSE coalesce(nullif(c, ''), '기타') END AS label FROM d WHERE o_custkey % 2 = 1 AND (c IN ('실적', 'performance') OR c = '배당')""")
def dashboard_disclosures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disclosures of chosen companies and canonical categories, with the shown label."""
    p = F.col("o_orderpriority")
    raw = F.when(p == "1-URGENT", "실적").when(p == "2-HIGH", "performance").when(p == "3-MEDIUM", "").when(p == "5-LOW", F.lit(None)).otherwise("배당")
    rows = table(spark, sf_dir, "orders").where("o_custkey % 2 = 1").select("o_orderkey", canonical_category(raw).alias("category"))
    return rows.where(F.col("category").isin("earnings", "배당")).withColumn("label", F.when(F.col("category") == "earnings", "실적").otherwise(F.col("category")))


@query("""WITH m AS (SELECT max(ts) AS now FROM events), f AS (SELECT *, CASE WHEN value > 80 THEN 'critical' WHEN value > 40 THEN 'watch' ELSE 'low' END AS level FROM events, m WHERE ts >= now - INTERVAL 7 DAY AND user_id % 5 IN (0, 1) AND event_type IN ('click', 'view', 'purchase'))
SELECT event_id, level, value >= 40 AS core, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts DESC, event_id) AS by_importance, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, value DESC, event_id) AS by_time FROM f""")
def dashboard_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News by company, provider and period, with core items and both orders of the list of a company."""
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now"))
    kept = events.crossJoin(F.broadcast(now)).where((F.col("ts") >= F.col("now") - F.make_dt_interval(F.lit(7))) & (F.col("user_id") % 5).isin(0, 1) & F.col("event_type").isin("click", "view", "purchase"))  # one row
    value, time = F.col("value").desc(), F.col("ts").desc()
    place = lambda *order: F.row_number().over(Window.partitionBy("user_id").orderBy(*order, "event_id")).cast("bigint")
    return kept.select("event_id", F.when(F.col("value") > 80, "critical").when(F.col("value") > 40, "watch").otherwise("low").alias("level"), (F.col("value") >= 40).alias("core"), place(value, time).alias("by_importance"), place(time, value).alias("by_time"))


# The labels of company states.
COMPLETION = {"complete_8q": "최근 8개 분기", "partial_5_to_7q": "5~7개 분기", "partial_1_to_4q": "1~4개 분기", "no_valid_quarter": "실적 N/A", "needs_review": "검토 필요", "conflicting_data": "충돌 검토"}
TIERS, LEVELS = {"core": "Core", "watch": "Watch", "background": "Background"}, {"critical": "Critical", "important": "Important", "watch": "Watch", "low": "Low"}


def label_of(value: Column, labels: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for name, label in labels.items():
        out = F.when(value == name, label).otherwise(out)
    return out


def watch_status(completion: Column, has_earnings: Column, disclosures: Column) -> Column:
    return (
        F.when((completion == "complete_8q") & (disclosures > 0), "8분기·공시").when(completion == "complete_8q", "8분기").when(completion.isin("needs_review", "conflicting_data"), "검토 필요")
        .when(has_earnings & (disclosures > 0), "실적·공시").when(has_earnings, "실적").when(disclosures > 0, "공시").otherwise("N/A")
    )


@query("""WITH w AS (SELECT s_suppkey AS code, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'KQ' END AS market FROM supplier), c AS (SELECT c_custkey AS code, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS name, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS market,
 CASE c_custkey % 4 WHEN 0 THEN 'complete_8q' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'partial_1_to_4q' ELSE 'x' END AS completion, c_acctbal > 0 AS earned FROM customer WHERE c_custkey % 5 <> 0), d AS (SELECT o_custkey AS code, count(*) AS n FROM orders GROUP BY 1)
SELECT w.code, coalesce(c.name, w.name) AS name, coalesce(c.market, w.market) AS market, CASE c.completion WHEN 'complete_8q' THEN '최근 8개 분기' WHEN 'needs_review' THEN '검토 필요' WHEN 'partial_1_to_4q' THEN '1~4개 분기' ELSE '분기 상태 N/A' END AS completion,
 CASE WHEN c.completion = 'complete_8q' AND coalesce(n, 0) > 0 THEN '8분기·공시' WHEN c.completion = 'complete_8q' THEN '8분기' WHEN c.completion = 'needs_review' THEN '검토 필요' WHEN coalesce(earned, false) AND coalesce(n, 0) > 0 THEN '실적·공시' WHEN coalesce(earned, false) THEN '실적' WHEN coalesce(n, 0) > 0 THEN '공시' ELSE 'N/A' END AS status
 FROM w LEFT JOIN c ON c.code = w.code LEFT JOIN d ON d.code = w.code""")
def watch_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watched companies with what is known of them, and their labels."""
    watch = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("w_name"), F.when(F.col("s_suppkey") % 2 == 0, "KQ").alias("w_market"))
    k = F.col("c_custkey")
    state = F.when(k % 4 == 0, "complete_8q").when(k % 4 == 1, "needs_review").when(k % 4 == 2, "partial_1_to_4q").otherwise("x")
    known = table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(k.alias("code"), F.when(k % 3 != 0, F.col("c_name")).alias("name"), F.when(k % 4 == 0, F.col("c_mktsegment")).alias("market"), state.alias("state"), (F.col("c_acctbal") > 0).alias("earned"))
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("code")).agg(F.count("*").alias("n"))
    rows = watch.join(known, "code", "left").join(counts, "code", "left")
    completion, n = F.coalesce("state", F.lit("")), F.coalesce("n", F.lit(0))
    return rows.select("code", F.coalesce("name", "w_name").alias("name"), F.coalesce("market", "w_market").alias("market"), label_of(completion, COMPLETION, "분기 상태 N/A").alias("completion"), watch_status(completion, F.coalesce("earned", F.lit(False)), n).alias("status"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN true WHEN 'view' THEN user_id = 7 WHEN 'purchase' THEN true ELSE false END AS about FROM events""")
def message_about(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages about a company: its code between other than digits, or its name with a word of issuers."""
    kind, code = F.col("event_type"), F.lpad(F.col("user_id").cast("string"), 6, "0")
    text = F.when(kind == "click", F.concat(F.lit("news a"), code, F.lit("."))).when(kind == "view", F.when(F.col("user_id") == 7, "회사 공시").otherwise("회사 소식")).when(kind == "purchase", "회사의 영업이익").otherwise(F.concat(F.lit("9"), code, F.lit("1")))
    return table(spark, sf_dir, "events").select("event_id", C.is_about(text, code, F.lit("회사")).alias("about"))


@query("""WITH n AS (SELECT event_id, event_type, user_id FROM events ORDER BY event_id DESC LIMIT 200) SELECT event_id FROM n WHERE event_type = 'click' AND user_id % 10 = 3""")
def company_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the newest 200 messages those about one company (the cut is the feature)."""
    code = F.when((F.col("event_type") == "click") & (F.col("user_id") % 10 == 3), "A000123").otherwise("1000123")
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("news "), code).alias("text"))
    return C.newest_about(rows, "000123", "회사", 200, "event_id").select("event_id")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'unknown_company' WHEN c_custkey % 4 = 0 THEN 'exact_match' WHEN c_custkey % 4 = 1 THEN 'alias_match' WHEN c_custkey % 4 = 2 AND other THEN 'company_mismatch' ELSE 'folder_only_match' END AS match,
 CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 4 = 2 AND other THEN lpad(CAST(c_custkey + 1 AS VARCHAR), 6, '0') ELSE '' END AS others FROM (SELECT *, c_custkey + 1 <= (SELECT max(c_custkey) FROM customer) AND (c_custkey + 1) % 7 <> 0 AS other FROM customer)""")
def file_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How files agree with the company of their folder."""
    customer = table(spark, sf_dir, "customer")
    k, code = F.col("c_custkey"), lambda c: F.lpad(c.cast("string"), 6, "0")
    text = (
        F.when(k % 4 == 0, F.concat(F.lit("종목코드: A"), code(k), F.lit("\n기업명: "), F.col("c_name"))).when(k % 4 == 1, F.concat(F.lit("stock code: "), code(k), F.lit("\n회사명: Alias"), k.cast("string")))
        .when(k % 4 == 2, F.concat(F.lit("종목 코드： "), code(k + 1))).otherwise("매출 10억")
    )
    files = customer.select(k.cast("string").alias("path"), code(k).alias("folder_code"), text.alias("text"))
    companies = customer.where("c_custkey % 7 <> 0").select(code(k).alias("stock_code"), F.col("c_name").alias("company_name"), F.array(F.concat(F.lit("alias"), k.cast("string"))).alias("terms"))
    return C.match_status(files, companies).select(F.col("path").cast("bigint").alias("c_custkey"), "match", F.array_join("others", ",").alias("others"))
