"""Older public forms and report totals: clusters of one source, disclosure summaries, backfill and validation counts, sanitised reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import articles as A
from ..operators import messages as M
from ..operators import parser as P
from ..operators import similar
from ..operators.graph import least_labels, stored
from . import flows
from .base import query, table
from .parsing import _ORDER, order_messages
from .portfolio import _RUN, run_companies, run_messages

# Categories that a public disclosure may have, secrets in summaries.
CATEGORIES = ["earnings", "시설투자", "공급계약", "자사주·배당", "증자·사채", "지분", "기타"]
SECRET = r"(?i)(api[_ -]?hash|client[_ -]?secret|session|phone)[^\s,:=]*\s*[:=]\s*[^\s,]+"


def legacy_articles(raw: DataFrame, companies: DataFrame, collected_at: str) -> DataFrame:
    """Articles of the second source as they were first published (title, url, seendate, language, stock_code): ten columns."""
    joined = raw.join(companies, "stock_code")
    names = F.concat(F.coalesce("aliases", F.array()), F.coalesce("english_aliases", F.array()))
    title = F.trim(F.coalesce("title", F.lit("")))
    domain = T.canonical_domain(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    kind = F.when(T.domain_in(domain, F.coalesce("official_sources", F.array())), "official").when(T.domain_in(domain, F.coalesce("major_source_domains", F.array())), "major").otherwise("other")
    time = F.date_format(F.to_utc_timestamp(flows.event_time(F.col("seendate")), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return joined.select(
        title.alias("title"), T.normalize_url(F.col("url")).alias("url"), domain.alias("source_domain"), time.alias("published_at"), F.coalesce(F.nullif("language", F.lit("")), F.lit("Unknown")).alias("language"), T.longest_alias(title, names).alias("matched_alias"), "company_name", "stock_code",
        kind.alias("source_type"), F.lit(collected_at).alias("collected_at"),
    )


def public_clusters(articles: DataFrame, companies: DataFrame, now: Column) -> DataFrame:
    """Clusters of legacy articles in their public form: ids by the first title, the best source's newest article, score and reasons."""
    rows = stored(articles.withColumns({"norm": T.normalize_title(F.col("title")), "at": flows.event_time(F.col("published_at"))}).withColumn("tokens", T.title_tokens(F.col("norm"))).withColumn("article", F.xxhash64("stock_code", "url", "title", "published_at", "source_domain")), "legacy")
    labels = least_labels(stored(similar.title_edges(rows, "stock_code", "article", "at", "norm", "tokens"), "legacy-edges"))
    each = rows.join(labels, rows["article"] == labels["node"], "left").withColumn("component", F.coalesce("component", "article"))
    rank = F.when(F.col("source_type") == "official", 2).when(F.col("source_type") == "major", 1).otherwise(0)
    best = F.struct(rank.alias("r"), F.col("at").isNotNull().alias("t"), F.col("at").alias("a"), F.col("article").alias("k"))
    pick = lambda c: F.max_by(c, best).alias(c)
    held = each.groupBy("stock_code", "component").agg(*[pick(c) for c in ("title", "url", "source_domain", "published_at", "at", "language", "norm", "company_name")], F.min("norm").alias("anchor"), F.array_sort(F.collect_set(F.when(F.col("source_domain") != "", F.col("source_domain")))).alias("sources"))
    none = F.array().cast("array<string>")
    wide = held.join(companies.select("stock_code", *[F.coalesce(F.col(c), none).alias(c) for c in ("aliases", "english_aliases", "official_sources", "major_source_domains", "important_keywords", "excluded_keywords")]), "stock_code")
    official, major = T.domain_in(F.col("source_domain"), F.col("official_sources")), T.domain_in(F.col("source_domain"), F.col("major_source_domains"))
    matched = T.longest_alias(F.col("title"), F.concat("aliases", "english_aliases")).isNotNull()
    plain = lambda words: F.filter(F.transform(words, lambda k: F.trim(F.regexp_replace(F.lower(k), "[^0-9a-z가-힣]+", " "))), lambda k: F.contains(F.col("norm"), k))
    hits, unwanted = F.size(plain(F.col("important_keywords"))), F.size(plain(F.col("excluded_keywords"))) > 0
    age = F.unix_timestamp(now) - F.unix_timestamp("at")
    recent, noise, roundup, several = F.coalesce(age.between(0, 86_400), F.lit(False)), unwanted | T.contains_any(F.col("norm"), T.STOCK_NOISE_TERMS), T.contains_any(F.col("norm"), T.MARKET_ROUNDUP_TERMS), F.size("sources") >= 3
    score = A.score_cluster(official=official, major=major, alias=matched, keyword_hits=hits, domains=F.size("sources"), recent=recent, noise=noise, roundup=roundup)
    points = F.least(hits * 5, F.lit(20))
    # The texts of the reasons.
    reasons = F.array(
        F.when(official, "공식 기업·기관 출처 +40").when(major, "주요 언론 출처 +25"), F.when(matched, "회사명이 제목에 정확히 등장 +15"), F.when(points > 0, F.concat(F.lit("핵심 키워드 "), hits.cast("string"), F.lit("개 +"), points.cast("string"))), F.when(several, "서로 다른 3개 이상 매체 보도 +15"),
        F.when(recent, "최근 24시간 기사 +10"), F.when(noise, "단순 주가·종목 추천 성격 -25"), F.when(roundup, "시장 종합 기사 단순 언급 -20"),
    )
    return wide.select(
        similar.cluster_id(F.col("stock_code"), F.col("anchor")).alias("cluster_id"), "company_name", "stock_code", F.col("title").alias("representative_title"), F.col("url").alias("representative_url"), F.col("source_domain").alias("representative_source"), "published_at",
        F.size("sources").alias("source_count"), "sources", "language", score.alias("importance_score"), T.importance_level(score).alias("importance_level"), T.ruled_categories(F.col("norm")).alias("categories"), F.filter(reasons, lambda r: r.isNotNull()).alias("scoring_reasons"),
    )


@query()
def legacy_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as clusters of one source in their older public form (tested on rows with known results)."""
    pages = table(spark, sf_dir, "pages")
    raw = pages.select(F.lpad((F.col("page_id") % 9).cast("string"), 6, "0").alias("stock_code"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), "url", F.concat(F.lit("202401"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"), F.lit("T000000Z")).alias("seendate"), F.lit("").alias("language"))
    nation = table(spark, sf_dir, "nation")
    companies = nation.select(
        F.lpad(F.col("n_nationkey").cast("string"), 6, "0").alias("stock_code"), F.col("n_name").alias("company_name"), F.array(F.lit("The"), F.lit("Der")).alias("aliases"), F.array().cast("array<string>").alias("english_aliases"), F.array(F.lit("example.org")).alias("official_sources"), F.array(F.lit("example.com")).alias("major_source_domains"),
        F.array(F.lit("ing"), F.lit("tion")).alias("important_keywords"), F.array(F.lit("xyz")).alias("excluded_keywords"),
    )
    return public_clusters(legacy_articles(raw, companies, "2024-02-01"), companies, F.lit("2024-01-29 00:00:00").cast("timestamp"))


def disclosure_summaries(disclosures: DataFrame) -> DataFrame:
    """(code, disclosures, latest): of each file's own and canonical records the distinct ones by source id, and the last time.

    disclosures: file_code, code, category, receipt, message_id, source_id, disclosed_at, report_name.
    """
    text = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    identity = F.coalesce(F.concat(F.lit("r:"), text("receipt")), F.concat(F.lit("m:"), F.nullif(text("message_id"), F.lit("0"))), F.concat(F.lit("s:"), text("source_id")), F.concat_ws("|", F.lit("t:"), F.coalesce("disclosed_at", F.lit("-")), F.coalesce("report_name", F.lit("-"))))
    valid = disclosures.where((F.coalesce(F.col("code").cast("string"), F.lit("")) == F.col("file_code")) & F.col("category").isin(CATEGORIES))
    one = valid.groupBy("file_code", identity.alias("identity")).agg(F.max(text("disclosed_at")).alias("last"))
    return one.groupBy(F.col("file_code").alias("code")).agg(F.count("*").alias("disclosures"), F.max("last").alias("latest"))


@query("""WITH d AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS file_code, CASE WHEN o_orderkey % 9 = 0 THEN '000000' ELSE lpad(CAST(o_custkey AS VARCHAR), 6, '0') END AS code, o_orderkey % 4 <> 3 AS known, CASE WHEN o_orderkey % 2 = 0 THEN 'm:' || (o_orderkey // 8 + 1) ELSE 'r:' || o_orderkey END AS identity, strftime(o_orderdate, '%Y-%m-%d') AS at_ FROM orders)
SELECT file_code AS code, count(DISTINCT identity) AS disclosures, max(at_) AS latest FROM d WHERE code = file_code AND known GROUP BY file_code""")
def disclosure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct valid disclosures of each company and the newest time."""
    key = F.col("o_orderkey")
    own = F.lpad(F.col("o_custkey").cast("string"), 6, "0")
    category = F.when(key % 4 == 0, "earnings").when(key % 4 == 1, "기타").when(key % 4 == 2, "지분").otherwise("other")
    rows = table(spark, sf_dir, "orders").select(
        own.alias("file_code"), F.when(key % 9 == 0, "000000").otherwise(own).alias("code"), category.alias("category"), F.when(key % 2 == 1, key.cast("string")).alias("receipt"), (F.floor(key / 8) + 1).alias("message_id"), F.lit(None).cast("string").alias("source_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("disclosed_at"), F.lit("r").alias("report_name"),
    )
    return disclosure_summaries(rows)


def backfill_report(searched: DataFrame, parsed: DataFrame, quarters: DataFrame) -> DataFrame:
    """One row: messages searched and related, by kind, and the distinct quarters that they gave."""
    counts = parsed.agg(F.count("*").alias("related"), F.count_if("has_earnings_data").alias("earnings"), F.count_if(F.col("classification") == "unknown").alias("unknown"), F.count_if(~F.col("has_earnings_data") & (F.col("classification") != "unknown") & F.col("report_name").isNotNull()).alias("general"))
    labels = quarters.agg(F.count_distinct("fiscal_quarter").alias("unique_quarters"), F.array_join(F.array_sort(F.collect_set("fiscal_quarter")), ",").alias("quarters"))
    return searched.agg(F.count("*").alias("searched")).crossJoin(counts).crossJoin(labels)  # a row each


@query(f"""WITH {_ORDER}, a AS (SELECT py || ' Q' || pq AS l FROM t WHERE kind < 2 UNION ALL SELECT y || ' Q' || q FROM t WHERE kind < 2) SELECT (SELECT count(*) FROM t) AS searched, (SELECT count(*) FROM t WHERE id % 3 = 0) AS related, (SELECT count(*) FROM t WHERE id % 3 = 0 AND kind < 2) AS earnings,
 (SELECT count(*) FROM t WHERE id % 3 = 0 AND kind = 3) AS unknown, (SELECT count(*) FROM t WHERE id % 3 = 0 AND kind = 2) AS general, count(DISTINCT l) AS unique_quarters, string_agg(DISTINCT l, ',' ORDER BY l) AS quarters FROM (SELECT py || ' Q' || pq AS l FROM t WHERE kind < 2 AND id % 3 = 0 UNION ALL SELECT y || ' Q' || q FROM t WHERE kind < 2 AND id % 3 = 0)""")
def backfill_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a company backfill."""
    messages = order_messages(spark, sf_dir)
    parsed = stored(P.parsed_messages(messages.where("id % 3 = 0")), "parsed")
    return backfill_report(messages, parsed, P.candidates(parsed))


@query(f"WITH {_RUN} SELECT (SELECT count(*) FROM m) AS fetched, count(DISTINCT id) AS matched, count(*) FILTER (problem IS NULL) AS parsed FROM a")
def validation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a validation of the message source: distinct ids over all companies, and messages that parse for their own."""
    messages = run_messages(spark, sf_dir).dropDuplicates(["id"])
    routes = stored(M.routed(messages, run_companies(spark, sf_dir)).where("status = 'assigned'").select("id", F.col("stock_code").alias("target")), "routes")
    fields = P.parsed_fields(messages.join(routes.select("id"), "id", "left_semi")).select("id", "classification", "stock_code", "explicit_code_found").join(routes, "id")
    good = (F.col("classification") != "unknown") & F.col("explicit_code_found") & (F.col("stock_code") == F.col("target"))
    return messages.agg(F.count("*").alias("fetched")).crossJoin(fields.agg(F.count_distinct("id").alias("matched"), F.count_if(good).alias("parsed")))  # a row each


def sanitized_report(reports: DataFrame, lists: list[str], kept: list[str]) -> DataFrame:
    """Reports with lists of companies as their lengths, and nothing but the named columns."""
    return reports.select(*kept, *[F.coalesce(F.size(c), F.lit(0)).alias(f"{c}_count") for c in lists])


@query("""SELECT event_type, count(*) AS calls, CAST(count(DISTINCT user_id) FILTER (value > 50) AS INTEGER) AS successful_count, CAST(count(DISTINCT user_id) FILTER (value <= 5) AS INTEGER) AS failed_count FROM events GROUP BY event_type""")
def sanitized_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run reports without the companies that they list."""
    users = lambda when: F.collect_set(F.when(when, F.col("user_id")))
    reports = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("calls"), users(F.col("value") > 50).alias("successful"), users(F.col("value") <= 5).alias("failed"))
    return sanitized_report(reports, ["successful", "failed"], ["event_type", "calls"])


def sanitized_summary(text: Column) -> Column:
    """The first 500 characters of a summary, secrets replaced."""
    return F.substring(F.regexp_replace(F.when(F.coalesce(text, F.lit("")) == "", "test failed").otherwise(text), SECRET, "[redacted]"), 1, 500)


@query(rf"SELECT conv_id, turn, sha256(substr(regexp_replace(t, '{SECRET}', '[redacted]', 'g'), 1, 500)) AS summary FROM (SELECT *, CASE WHEN coalesce(text, '') = '' THEN 'test failed' WHEN turn % 3 = 0 THEN text || ' Session_id: abc, api-hash=9' ELSE text END AS t FROM conversations)")
def sanitized_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as public summaries."""
    text = F.when((F.coalesce("text", F.lit("")) != "") & (F.col("turn") % 3 == 0), F.concat("text", F.lit(" Session_id: abc, api-hash=9"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(sanitized_summary(text), 256).alias("summary"))


def company_status(completion: Column, has_quarter: Column, disclosures: Column) -> Column:
    """Label and tone of a company's page. The labels."""
    pair = lambda label, tone: F.struct(F.lit(label).alias("label"), F.lit(tone).alias("tone"))
    return (
        F.when((completion == "complete_8q") & (disclosures > 0), pair("8분기·공시", "")).when(completion == "complete_8q", pair("8분기 확보", "")).when(completion.isin("needs_review", "conflicting_data"), pair("검토 필요", "warn"))
        .when(~has_quarter & (disclosures == 0), pair("N/A", "neutral")).when(disclosures > 0, pair("공시 확인", "")).otherwise(pair("실적 확인", ""))
    )


@query("""WITH c AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'complete_8q' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'conflicting_data' WHEN 3 THEN 'partial_1_to_4q' END AS completion, c_acctbal > 0 AS earned, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer)
SELECT c_custkey, CASE WHEN completion = 'complete_8q' AND n > 0 THEN '8분기·공시' WHEN completion = 'complete_8q' THEN '8분기 확보' WHEN completion IN ('needs_review', 'conflicting_data') THEN '검토 필요' WHEN NOT earned AND n = 0 THEN 'N/A' WHEN n > 0 THEN '공시 확인' ELSE '실적 확인' END AS label,
 CASE WHEN completion = 'complete_8q' THEN '' WHEN completion IN ('needs_review', 'conflicting_data') THEN 'warn' WHEN NOT earned AND n = 0 THEN 'neutral' ELSE '' END AS tone FROM c""")
def company_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each company's page."""
    k = F.col("c_custkey")
    completion = F.when(k % 5 == 0, "complete_8q").when(k % 5 == 1, "needs_review").when(k % 5 == 2, "conflicting_data").when(k % 5 == 3, "partial_1_to_4q").otherwise("")
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "customer").join(counts, "c_custkey", "left")
    status = company_status(completion, F.col("c_acctbal") > 0, F.coalesce("n", F.lit(0)))
    return rows.select("c_custkey", status["label"].alias("label"), status["tone"].alias("tone"))
