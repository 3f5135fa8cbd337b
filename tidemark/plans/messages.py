"""Message queries: codes, routing, batches, windows, categories of report names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, labels
from ..operators import messages as M
from .base import query, table

# a message of each event: labelled, company line, URL, standalone, alias or nothing, by event type
_TEXT = """CASE event_type WHEN 'click' THEN '종목코드: A' || lpad(CAST(user_id AS VARCHAR), 6, '0') WHEN 'purchase' THEN '기업명: 회사 (' || lpad(CAST(user_id AS VARCHAR), 6, '0') || ')'
 WHEN 'view' THEN 'https://news.example.com/x?code=' || lpad(CAST(user_id AS VARCHAR), 6, '0') WHEN 'signup' THEN 'codes ' || lpad(CAST(user_id AS VARCHAR), 6, '0') || ' and ' || lpad(CAST(event_id % 1500 AS VARCHAR), 6, '0')
 ELSE 'news of Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') || ' today' END"""


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = lambda c: F.lpad(c.cast("string"), 6, "0")
    kind, user = F.col("event_type"), F.col("user_id")
    text = (
        F.when(kind == "click", F.concat(F.lit("종목코드: A"), code(user)))
        .when(kind == "purchase", F.concat(F.lit("기업명: 회사 ("), code(user), F.lit(")")))
        .when(kind == "view", F.concat(F.lit("https://news.example.com/x?code="), code(user)))
        .when(kind == "signup", F.concat(F.lit("codes "), code(user), F.lit(" and "), code(F.col("event_id") % 1500)))
        .otherwise(F.concat(F.lit("news of Customer#"), F.lpad(user.cast("string"), 9, "0"), F.lit(" today")))
    )
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), text.alias("text"))


@query("""
WITH e AS (SELECT event_id AS id, event_type, user_id, lpad(CAST(user_id AS VARCHAR), 6, '0') AS code, lpad(CAST(event_id % 1500 AS VARCHAR), 6, '0') AS other FROM events),
c AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code, c_mktsegment = 'MACHINERY' AS requires, lower(c_name) AS name FROM customer),
x AS (SELECT id, code FROM e WHERE event_type IN ('click', 'purchase', 'view') OR (event_type = 'signup' AND code = other)),
n AS (SELECT id, 'customer ' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS name FROM e WHERE event_type NOT IN ('click', 'purchase', 'view', 'signup'))
SELECT x.id, x.code AS stock_code, CASE WHEN c.code IS NULL THEN 'quarantine' ELSE 'assigned' END AS status, CASE WHEN c.code IS NULL THEN 'code_not_in_portfolio' END AS reason FROM x LEFT JOIN c ON c.code = x.code
UNION ALL SELECT id, NULL, 'quarantine', 'ambiguous_explicit_codes' FROM e WHERE event_type = 'signup' AND code <> other
UNION ALL SELECT n.id, c.code, CASE WHEN requires THEN 'quarantine' ELSE 'assigned' END, CASE WHEN requires THEN 'target_requires_explicit_code' END FROM n JOIN c ON replace(c.name, '#', ' ') = n.name
UNION ALL SELECT n.id, NULL, 'dropped', NULL FROM n WHERE NOT EXISTS (SELECT 1 FROM c WHERE replace(c.name, '#', ' ') = n.name)
""")
def code_extract_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages to at most one company, by code or name, or to quarantine."""
    customer = table(spark, sf_dir, "customer")
    companies = customer.select(F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("stock_code"), F.array("c_name").alias("terms"), (F.col("c_mktsegment") == "MACHINERY").alias("requires_code"))
    return M.routed(event_messages(spark, sf_dir), companies).drop("parsed_code", "term")


_SAFE = "[^가-힣A-Za-z0-9]"
_NAMED = """m AS (SELECT event_id AS id, k AS nation, (k + 7) % 25 AS other, event_type, CASE event_type WHEN 'click' THEN '기업명: N&' || k || chr(10) || 'news of N&' || ((k + 7) % 25) WHEN 'view' THEN '가나' || k || '전자는 실적' WHEN 'purchase' THEN '가나' || k || '전자사 실적'
 WHEN 'signup' THEN 'N&' || k || ' and N&' || ((k + 7) % 25) ELSE '거래상대: N&' || k || chr(10) || 'N ' || k END AS text FROM (SELECT *, user_id % 25 AS k FROM events))"""


@query(f"""
WITH {_NAMED}, c AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 6, '0') AS code, n_nationkey AS k, n_regionkey = 0 AS requires FROM nation),
f AS (SELECT m.id, c.code, c.requires FROM m JOIN c ON event_type = 'click' AND regexp_matches(regexp_extract(text, '기업명: ([^\n]+)', 1), '(^|{_SAFE})N&' || c.k || '($|{_SAFE})')),
b AS (SELECT m.id, c.code, c.requires FROM m JOIN c ON event_type <> 'click' AND (regexp_matches(regexp_replace(text, '거래상대[^\n]*', ''), '(^|{_SAFE})N&' || c.k || '($|{_SAFE})')
  OR regexp_matches(text, '(^|{_SAFE})가나' || c.k || '전자($|{_SAFE}|(은|는|이|가|와|과|을|를|의|도|에)($|{_SAFE}))'))),
h AS (SELECT * FROM f UNION SELECT * FROM b), p AS (SELECT id, count(*) AS n, max(code) AS code FROM h WHERE NOT requires GROUP BY id)
SELECT id, code AS stock_code, 'quarantine' AS status, 'target_requires_explicit_code' AS reason FROM h WHERE requires
UNION ALL SELECT id, CASE WHEN n = 1 THEN code END, CASE WHEN n = 1 THEN 'assigned' ELSE 'quarantine' END, CASE WHEN n > 1 THEN 'ambiguous_alias_match' END FROM p
UNION ALL SELECT id, NULL, 'dropped', NULL FROM m WHERE id NOT IN (SELECT id FROM h)""")
def name_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by name: company fields before other lines, particles behind Korean names, punctuation in names, counter-parties ignored."""
    k, other = (F.col("user_id") % 25).cast("string"), ((F.col("user_id") % 25 + 7) % 25).cast("string")
    kind = F.col("event_type")
    text = (
        F.when(kind == "click", F.concat(F.lit("기업명: N&"), k, F.lit("\nnews of N&"), other))
        .when(kind == "view", F.concat(F.lit("가나"), k, F.lit("전자는 실적")))
        .when(kind == "purchase", F.concat(F.lit("가나"), k, F.lit("전자사 실적")))
        .when(kind == "signup", F.concat(F.lit("N&"), k, F.lit(" and N&"), other))
        .otherwise(F.concat(F.lit("거래상대: N&"), k, F.lit("\nN "), k))
    )
    number = F.col("n_nationkey").cast("string")
    companies = table(spark, sf_dir, "nation").select(F.lpad(number, 6, "0").alias("stock_code"), F.array(F.concat(F.lit("N&"), number), F.concat(F.lit("가나"), number, F.lit("전자"))).alias("terms"), (F.col("n_regionkey") == 0).alias("requires_code"))
    return M.routed(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), text.alias("text")), companies).drop("parsed_code", "term")


@query(f"SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'labeled_stock_code' WHEN 'purchase' THEN 'company_name_field' WHEN 'view' THEN 'url_query_code' WHEN 'signup' THEN 'standalone_code' END AS source, length({_TEXT}) AS n_chars FROM events")
def code_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each message's code was found."""
    rows = event_messages(spark, sf_dir)
    return rows.select("id", codes.codes_by_level(F.col("text"))["source"].alias("source"), F.length("text").cast("bigint").alias("n_chars"))


@query("SELECT event_id, ts, user_id FROM events WHERE event_id > (SELECT min(event_id) + 100 FROM events) ORDER BY event_id LIMIT 500")
def cursor_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next 500 events after a cursor (the bounded batch is the feature)."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    cursor = events.agg((F.min("event_id") + 100).alias("cursor"))
    after = events.crossJoin(F.broadcast(cursor)).where("event_id > cursor")  # one row
    return M.batch_after(after, F.col("cursor"), 500, "event_id").select("event_id", "ts", "user_id")


@query("""
WITH n AS (SELECT max(ts) AS now FROM events), l AS (SELECT user_id, max(ts) FILTER (event_type = 'purchase') AS last FROM events GROUP BY user_id)
SELECT user_id, last, CASE WHEN last IS NULL THEN now - INTERVAL 7 DAY ELSE greatest(now - INTERVAL 16 HOUR, last - INTERVAL 3 HOUR) END AS start_at FROM l, n
""")
def collection_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start of each company's next collection."""
    events = table(spark, sf_dir, "events")
    last = events.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("last"))
    rows = last.crossJoin(F.broadcast(events.agg(F.max("ts").alias("now"))))  # one row
    return rows.select("user_id", "last", M.collection_start(F.col("now"), F.col("last")).alias("start_at"))


@query("""
WITH f AS (SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal < 0 AS failing, CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'AUTOMOBILE' THEN 1 ELSE 2 END AS tier FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY failing DESC, tier, c_custkey) AS k FROM f)
SELECT c_custkey, c_nationkey, CAST((k - 1) // 25 AS BIGINT) AS batch, CAST(sum(tier + 1) OVER (PARTITION BY c_nationkey ORDER BY k) AS BIGINT) AS running, sum(tier + 1) OVER (PARTITION BY c_nationkey ORDER BY k) <= 50 AS allowed FROM r
""")
def priority_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processing order within a provider (nation), batches of 25 and the prefix form of the budget gate."""
    tier = F.when(F.col("c_mktsegment") == "BUILDING", 0).when(F.col("c_mktsegment") == "AUTOMOBILE", 1).otherwise(2)
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (F.col("c_acctbal") < 0).alias("failing"), tier.alias("tier"))
    order = [F.col("failing").desc(), F.col("tier"), F.col("c_custkey")]
    from pyspark.sql import Window

    placed = rows.withColumn("k", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(*order))).withColumn("budget", F.col("tier") + 1)
    gated = M.budget_bound(placed, "c_nationkey", [F.col("k")], "budget", 50)
    return gated.select("c_custkey", "c_nationkey", F.floor((F.col("k") - 1) / 25).alias("batch"), "running", "allowed")


_GATE = """WITH RECURSIVE f AS (SELECT c_custkey, c_nationkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'AUTOMOBILE' THEN 2 ELSE 3 END AS budget, CAST(c_custkey % 3 AS INTEGER) AS actual, CAST(c_custkey // 100 AS INTEGER) AS day, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer),
r AS (SELECT DISTINCT c_nationkey, CAST(0 AS BIGINT) AS k, NULL::BIGINT AS c_custkey, NULL::INTEGER AS budget, NULL::INTEGER AS actual, NULL::INTEGER AS day, 0 AS used, 0 AS today, NULL::BOOLEAN AS allowed FROM f
 UNION ALL SELECT c_nationkey, k, c_custkey, budget, actual, day, used + CASE WHEN ok THEN actual ELSE 0 END, before + CASE WHEN ok THEN actual ELSE 0 END, ok
 FROM (SELECT f.*, r.used, CASE WHEN f.day = r.day THEN r.today ELSE 0 END AS before, r.used + f.budget <= 50 AND CASE WHEN f.day = r.day THEN r.today ELSE 0 END + f.budget <= {daily} AS ok FROM r JOIN f ON f.c_nationkey = r.c_nationkey AND f.k = r.k + 1))"""


def _gate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.when(F.col("c_mktsegment") == "BUILDING", 0).when(F.col("c_mktsegment") == "AUTOMOBILE", 1).otherwise(2)
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (tier + 1).alias("budget"), (F.col("c_custkey") % 3).cast("int").alias("actual"), F.floor(F.col("c_custkey") / 100).cast("int").alias("day"))


@query(_GATE.format(daily=10**9) + " SELECT c_custkey, c_nationkey, budget, actual, allowed FROM r WHERE k > 0")
def budget_gate_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequential gate on actual use, as stretches whose uses are known for every start."""
    return M.budget_gate(_gate_requests(spark, sf_dir).drop("day"), "c_nationkey", "c_custkey", "budget", "actual", 50)


@query(_GATE.format(daily=5) + " SELECT c_custkey, c_nationkey, budget, actual, day, allowed FROM r WHERE k > 0")
def budget_gate_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate with a limit of the run and one of the day."""
    return M.budget_gate(_gate_requests(spark, sf_dir), "c_nationkey", "c_custkey", "budget", "actual", 50, "day", 5)


_P = "p_type"


@query(f"SELECT p_partkey, CASE {' '.join(f'WHEN ' + ' OR '.join(f'contains(n, {chr(39)}{t}{chr(39)})' for t in terms) + f' THEN {chr(39)}{label}{chr(39)}' for label, terms in labels.CATEGORIES)} ELSE '기타' END AS category FROM (SELECT p_partkey, {labels.analog_sql(_P)} AS n FROM part)")
def category_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disclosure category of report names, first rule wins."""
    names = table(spark, sf_dir, "part").select("p_partkey", labels.analog(F.col(_P)).alias("n"))
    return names.select("p_partkey", labels.disclosure_category(F.col("n"), F.lit(False)).alias("category"))


@query(f"SELECT p_partkey, CASE {' '.join(f'WHEN ' + ' OR '.join(f'contains(n, {chr(39)}{t}{chr(39)})' for t in terms) + f' THEN {chr(39)}{label}{chr(39)}' for label, terms in labels.LATEST)} ELSE '기타' END AS label FROM (SELECT p_partkey, lower(regexp_replace({labels.analog_sql(_P)}, '[^0-9A-Za-z가-힣]', '', 'g')) AS n FROM part)")
def report_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short label of report titles, 18 ordered rules."""
    names = table(spark, sf_dir, "part").select("p_partkey", labels.analog(F.col(_P)).alias("n"))
    return names.select("p_partkey", labels.latest_type(F.col("n")).alias("label"))
