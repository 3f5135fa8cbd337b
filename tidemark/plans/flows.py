"""The three data flows as compositions of operators: news events, messages, earnings files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions import text as T
from ..operators import articles as A
from ..operators import messages as M
from ..operators import parser as P
from ..operators import rank, series
from ..operators.graph import cut, least_labels, stored
from ..operators.merge import upserted
from ..operators.similar import event_edges

# Retention of public events (days, cap) by level.
RETENTION = {"material": (90, 100), "contextual": (30, 30), "low": (14, 10)}
LEVEL_BUCKET = {"critical": "material", "important": "material", "watch": "contextual", "contextual": "contextual", "low": "low", "market_noise": "low"}


def event_time(text: Column) -> Column:
    """Instant of ISO, compact and RFC-822 times; zone-less text is UTC, unreadable text null."""
    value = F.trim(text)
    rfc = F.try_to_timestamp(F.regexp_replace(value, "^[A-Za-z]{3}, *", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.coalesce(F.try_to_timestamp(value, F.lit("yyyyMMdd'T'HHmmssX")), F.try_to_timestamp(value, F.lit("yyyyMMdd'T'HHmmss")), value.try_cast("timestamp"), rfc)


def normalized_articles(raw: DataFrame, companies: DataFrame, provider: str, collected_at: str, beside: Sequence[str] = ()) -> DataFrame:
    """Standard articles of raw items (stock_code, title, description, url, published_at, language), with the columns of their company named in ``beside``."""
    names = F.concat(F.coalesce("aliases", F.array()), F.coalesce("english_aliases", F.array()))
    # texts are normalised before the join: a filter on both sides of one may hold no Python function
    clean = raw.withColumns({"title": T.clean_markup(F.col("title")), "description": T.clean_markup(F.coalesce("description", F.lit(""))), "canonical_url": T.normalize_url(F.col("url"))}).drop("url")
    clean = clean.withColumns({"normalized_title": T.normalize_title(F.col("title")), "combined": T.normalize_title(F.concat_ws(" ", "title", "description"))})
    rows = clean.join(companies.withColumn("names", names), "stock_code")
    rows = rows.withColumns({"source_domain": T.canonical_domain(F.regexp_extract("canonical_url", "^https://([^/?]+)", 1)), "matched_title": T.longest_alias(F.col("title"), F.col("names"))})
    tier = F.when(T.domain_in(F.col("source_domain"), F.coalesce("official_sources", F.array())), "official").when(T.domain_in(F.col("source_domain"), F.coalesce("major_source_domains", F.array())), "tier1").otherwise("other")
    hits = F.size(F.filter(F.coalesce("important_keywords", F.array()), lambda k: F.contains(F.col("combined"), F.lower(k))))
    base = F.when(F.col("matched_title").isNotNull(), 80).when(T.longest_alias(F.col("description"), F.col("names")).isNotNull(), 35).otherwise(0)
    language = F.coalesce("language", F.lit("Korean" if provider == "naver" else "Unknown"))
    domestic = F.lit(provider == "naver") | (F.lower(language) == "korean") | F.endswith("source_domain", F.lit(".kr")) | F.contains("source_domain", F.lit(".co.kr"))
    return rows.select(
        T.article_id(F.lit(provider), F.col("canonical_url"), F.col("normalized_title")).alias("article_id"), F.lit(provider).alias("provider"), F.array(F.lit(provider)).alias("providers"), "company_name", "stock_code",
        "title", "normalized_title", F.col("canonical_url").alias("url"), "canonical_url", "source_domain", F.col("source_domain").alias("source_name"), F.col("published_at").alias("published_at_raw"), event_time(F.col("published_at")).alias("published_at"),
        F.lit(collected_at).alias("collected_at"), language.alias("language"), F.when(domestic, "domestic").otherwise("international").alias("region"), F.coalesce("matched_title", T.longest_alias(F.col("description"), F.col("names"))).alias("matched_alias"),
        T.ruled_categories(F.col("combined")).alias("categories"), T.event_signals(F.col("normalized_title")).alias("event_keywords"), (tier == "official").alias("official_source"), tier.alias("source_tier"),
        F.least(F.lit(100), base + F.least(F.lit(20), hits * 4)).alias("relevance_score"), *beside,
    )


def deduplicated(articles: DataFrame) -> DataFrame:
    """Greedy two-key merge in time order: arrays united, provider 'both', columns of a better source taken over."""
    # the order itself is the position (undated ones first), so companies are neither ranked nor mixed up
    placed = articles.dropDuplicates(["stock_code", "published_at", "article_id"]).withColumn("position", F.struct("published_at", "article_id"))
    merged = A.greedy_deduplicated(placed, "stock_code", "canonical_url", "normalized_title", "position")
    better = F.struct(F.when(F.col("position") == F.col("kept_position"), F.when(F.col("source_tier") == "other", 1).otherwise(0)).when(F.col("source_tier").isin("official", "tier1"), 0).otherwise(2).alias("k"), F.col("position").alias("p"))
    own = F.struct((F.col("position") != F.col("kept_position")).cast("int").alias("k"), F.col("position").alias("p"))
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    taken = ["url", "canonical_url", "source_domain", "source_name", "source_tier", "official_source"]
    arrays = ["providers", "event_keywords", "categories"]
    kept = [c for c in articles.columns if c not in (*taken, *arrays, "stock_code", "provider")]
    # whole rows are picked: a buffer of each column would carry its order with it
    rows = merged.groupBy("stock_code", "kept_position").agg(F.min_by(F.struct(*kept, "provider"), own).alias("own"), F.min_by(F.struct(*taken), better).alias("taken"), *[united(c) for c in arrays])
    out = rows.select("stock_code", "own.*", "taken.*", *arrays)
    return out.withColumn("provider", F.when(F.size("providers") > 1, "both").otherwise(F.col("provider"))).select(articles.columns)


def same_event_edges(articles: DataFrame) -> DataFrame:
    """(src, dst) article ids of one company within 72 hours with two common keywords or a ratio of 0.82."""
    rows = stored(articles.select("stock_code", "article_id", "published_at", "normalized_title", "event_keywords"), "titles")  # read for both kinds of pairs
    return event_edges(rows, "stock_code", "article_id", "published_at", "normalized_title", "event_keywords")


def news_events(articles: DataFrame, companies: DataFrame, now: Column) -> DataFrame:
    """Public events: clusters of articles with their representative, aggregates, importance and article list."""
    edges = stored(same_event_edges(articles), "event-edges")
    labelled = articles if edges.isEmpty() else articles.join(least_labels(edges).withColumnRenamed("node", "article_id"), "article_id", "left")
    clustered = labelled.withColumn("cluster", F.coalesce("component", "article_id") if "component" in labelled.columns else F.col("article_id"))
    tier = F.when(F.col("source_tier") == "official", 4).when(F.col("source_tier") == "tier1", 3).otherwise(1)
    order = F.struct((-tier).alias("a"), F.when((F.col("region") == "domestic") & (F.col("source_tier") == "tier1"), -1).otherwise(0).alias("b"), F.when(F.col("matched_alias").isNotNull(), -1).otherwise(0).alias("c"), F.coalesce(F.col("published_at"), F.lit("9999-12-31").cast("timestamp")).alias("d"), F.col("article_id").alias("e"))
    best = {"company_name": "company_name", "representative_title": "title", "representative_url": "url", "canonical": "canonical_url", "representative_source": "source_name", "representative_language": "language", "alias": "matched_alias", "norm": "normalized_title"}
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    shown = F.struct(F.col("published_at_raw").alias("published_at"), "title", "url", F.col("source_name").alias("source"), "source_domain", "language", "region", F.when(F.size("providers") > 1, "BOTH").otherwise(F.upper("provider")).alias("provider"))
    events = clustered.groupBy("stock_code", "cluster").agg(
        F.min_by(F.struct(*[F.col(c).alias(name) for name, c in best.items()]), order).alias("best"),
        F.min("published_at").alias("first_published_at"), F.max("published_at").alias("last_published_at"), F.count("*").cast("int").alias("article_count"), F.count_if(F.col("region") == "domestic").cast("int").alias("domestic_article_count"), F.count_if(F.col("region") == "international").cast("int").alias("international_article_count"),
        united("providers").alias("providers"), F.array_sort(F.collect_set("source_domain")).alias("source_domains"), united("categories").alias("categories"), united("event_keywords").alias("event_keywords"),
        F.bool_or("official_source").alias("official"), F.bool_or(F.col("source_tier") == "tier1").alias("tier1"), F.size(F.collect_set(F.when(F.col("source_tier").isin("official", "tier1"), F.col("source_domain")))).alias("trusted"),
        F.array_join(F.collect_list("normalized_title"), " ").alias("titles"), F.sort_array(F.collect_list(shown), asc=False).alias("articles"),
    ).select("stock_code", "best.*", "*").drop("best").join(companies.select("stock_code", F.coalesce("important_keywords", F.array()).alias("keywords")), "stock_code", "left")
    hits = F.size(F.filter(F.array_distinct(F.transform("keywords", lambda k: F.lower(k))), lambda k: F.contains(F.col("titles"), k)))
    age = F.unix_timestamp(now) - F.unix_timestamp("last_published_at")
    score = A.score_event(
        official=F.col("official"), tier1=F.col("tier1"), alias=F.col("alias").isNotNull(), keyword_hits=F.coalesce(hits, F.lit(0)), both_regions=(F.col("domestic_article_count") > 0) & (F.col("international_article_count") > 0), trusted_domains=F.col("trusted"),
        recent=F.coalesce(age.between(0, 86_400), F.lit(False)), material=F.arrays_overlap("event_keywords", T.text_array(T.MATERIAL_SIGNALS)), noise=T.contains_any(F.col("norm"), T.STOCK_NOISE),
    )
    iso = F.date_format("first_published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return events.withColumns({
        "importance_score": score.cast("int"), "importance_level": T.importance_level(score), "needs_review": (F.col("article_count") > 1) & (F.size("event_keywords") < 2),
        "cluster_id": F.substring(F.sha2(F.concat_ws("|", "stock_code", "canonical", F.coalesce(iso, F.lit("None"))), 256), 1, 16),
    }).drop("cluster", "canonical", "alias", "norm", "official", "tier1", "trusted", "titles", "keywords")


def merged_events(existing: DataFrame | None, fresh: DataFrame, now: Column) -> DataFrame:
    """New events over existing ones, if there are any, then retention by level, age and cap."""
    both = fresh if existing is None else upserted(existing, fresh, ["stock_code", "cluster_id"])
    bucket = F.lit("low")
    for level, name in LEVEL_BUCKET.items():
        bucket = F.when(F.col("importance_level") == level, name).otherwise(bucket)
    kept = rank.retained(both.withColumn("bucket", bucket), now, group="stock_code", key="cluster_id", time="last_published_at", bucket="bucket", limits=RETENTION)
    return kept.drop("bucket", "bucket_rank")


def event_index(companies: DataFrame, events: DataFrame, k: int = 3) -> DataFrame:
    """One row a company with its newest k event summaries and totals."""
    top = rank.top_k(events.drop("articles"), ["stock_code"], [F.col("last_published_at").desc_nulls_last(), F.col("cluster_id")], k)
    summary = F.struct("rank", "cluster_id", "representative_title", "importance_level", "last_published_at")
    listed = top.groupBy("stock_code").agg(F.array_sort(F.collect_list(summary)).alias("top_events"))
    totals = events.groupBy("stock_code").agg(F.count("*").alias("event_count"), F.max("last_published_at").alias("latest"))
    return companies.select("stock_code", "company_name").join(totals, "stock_code", "left").join(listed, "stock_code", "left").na.fill({"event_count": 0})


#: Tables of a message run; columns of the parse that every table reads, and those that counts read besides.
MESSAGE_TABLES = ("quarters", "disclosures", "quarantine", "companies", "totals")
_JUDGED = ["id", "target", "stock_code", "problem"]
_COUNTED = ["report_name", "disclosure_datetime", "dart_receipt_number", "report_period", "recent_earnings", "has_earnings_data", *[f"{m}_{k}" for m in P.METRICS for k in ("actual", "consensus")]]


def message_flow(messages: DataFrame, companies: DataFrame, held_quarters: DataFrame | None = None, held_disclosures: DataFrame | None = None, tables: Sequence[str] = MESSAGE_TABLES) -> dict[str, DataFrame]:
    """Messages (id, text, date) of a run into held tables: quarters, disclosures, quarantine, companies, totals.

    Messages are routed to companies (stock_code, terms, requires_code), once each; the assigned ones are parsed, and the parse,
    which all tables read, is written once.  What the parser does not know, messages that state no code themselves and those that
    state another company's go to quarantine.  ``companies`` has the counts of each company, ``totals`` one row of the run.  Work
    that none of the named ``tables`` reads is left out.
    """
    batch = messages.dropDuplicates(["id"])
    routes = stored(M.routed(batch, companies), "routes")
    assigned = routes.where("status = 'assigned'").select("id", F.col("stock_code").alias("target"))
    parsed = P.parsed_messages(batch.join(assigned, "id"), beside=["target"])
    problem = F.when(F.col("classification") == "unknown", "parse_unknown").when(F.col("stock_code").isNull(), "parsed_code_missing").when(F.col("stock_code") != F.col("target"), "parsed_code_target_mismatch")
    judged = parsed.withColumn("problem", problem)
    counted = "companies" in tables or "totals" in tables
    if not {"quarters", "disclosures"} & set(tables):
        read = [*_JUDGED, *(_COUNTED if counted else [])]
        judged = judged.withColumns({c: F.lit(None).cast(judged.schema[c].dataType) for c in judged.columns if c not in read})
    judged = stored(judged, "judged")
    good = judged.where("problem is null").drop("problem", "target")
    out = {}
    # counts need no more of a quarter than whether its values differ, and of a disclosure no more than its identity
    if "quarters" in tables:
        fresh_quarters = stored(final_quarters(good), "quarters")
    elif counted:
        fresh_quarters = quarter_conflicts(good)
    if "disclosures" in tables:
        fresh_disclosures = stored(disclosures(good), "disclosures")
    elif counted:
        fresh_disclosures = disclosures(good).select("stock_code", "identity")
    if "quarters" in tables:
        out["quarters"] = fresh_quarters if held_quarters is None else merged_quarters(held_quarters, fresh_quarters)
    if "disclosures" in tables:
        out["disclosures"] = fresh_disclosures if held_disclosures is None else merged_disclosures(held_disclosures, fresh_disclosures)
    if counted:
        out["companies"] = message_results(companies, judged, fresh_quarters, fresh_disclosures, held_disclosures)
    if "quarantine" in tables or "totals" in tables:
        out["quarantine"] = stored(quarantined(batch, routes, judged), "quarantine")
    if "totals" in tables:
        out["totals"] = message_totals(batch, out["companies"], routes, out["quarantine"])
    return {name: out[name] for name in tables}


def quarantined(messages: DataFrame, routes: DataFrame, judged: DataFrame) -> DataFrame:
    """(id, parsed_code, target, reason, stage, detected_at, context, term_context): what a run holds back, with a redacted piece of the
    text from its start, and one round the name that led there."""
    held = routes.where("status = 'quarantine'")
    by_route = held.select("id", "parsed_code", F.when(F.col("reason") == "target_requires_explicit_code", F.col("stock_code")).alias("target"), "reason", F.lit("distribution").alias("stage"), "term")
    stage = F.when(F.col("problem") == "parse_unknown", "parsing").otherwise("pre_merge_validation")
    by_parse = judged.where("problem is not null").select("id", F.col("stock_code").alias("parsed_code"), "target", F.col("problem").alias("reason"), stage.alias("stage"), F.lit(None).cast("string").alias("term"))
    rows = by_route.unionByName(by_parse).join(messages.select("id", "text", F.col("date").cast("string").alias("detected_at")), "id")
    return rows.select("id", "parsed_code", "target", "reason", "stage", "detected_at", T.context_of(F.col("text")).alias("context"), F.when(F.col("term").isNotNull(), T.context_round(F.col("text"), F.col("term"))).alias("term_context"))


def merged_quarters(held: DataFrame, fresh: DataFrame, most: int = 8) -> DataFrame:
    """Held quarters with the fresh ones over them, the last ``most`` of each company that has fresh ones."""
    touched = fresh.select("stock_code").distinct()
    both = upserted(held.join(touched, "stock_code", "left_semi"), fresh.select(held.columns), ["stock_code", "fiscal_quarter"])
    last = rank.top_k(both, ["stock_code"], [F.col("fiscal_quarter").desc()], most).drop("rank")
    return held.join(touched, "stock_code", "left_anti").unionByName(last)


def merged_disclosures(held: DataFrame, fresh: DataFrame, most: int = 100) -> DataFrame:
    """Held disclosures with the fresh ones over them by identity, newest first, ``most`` a company.  Only companies with an identity
    that is new are written: where fresh ones replace held ones alone, the held ones stay as they are."""
    written = fresh.join(held.select("stock_code", "identity"), ["stock_code", "identity"], "left_anti").select("stock_code").distinct()
    both = upserted(held.join(written, "stock_code", "left_semi"), fresh.select(held.columns).join(written, "stock_code", "left_semi"), ["stock_code", "identity"])
    newest = rank.top_k(both, ["stock_code"], [F.col("disclosure_datetime").desc(), F.col("identity")], most).drop("rank")
    return held.join(written, "stock_code", "left_anti").unionByName(newest)


def message_results(companies: DataFrame, judged: DataFrame, quarters: DataFrame, listed: DataFrame, held: DataFrame | None) -> DataFrame:
    """One row a company: matched, parsed and failed messages, new quarters and disclosures, warnings (quarters with two values)."""
    counted = judged.groupBy(F.col("target").alias("stock_code")).agg(F.count("*").alias("matched"), F.count_if(F.col("problem").isNull()).alias("parsed"), F.count_if(F.col("problem") == "parse_unknown").alias("failures"))
    new = listed if held is None else listed.join(held.select("stock_code", "identity"), ["stock_code", "identity"], "left_anti")
    parts = [counted, quarters.groupBy("stock_code").agg(F.count("*").alias("new_quarters"), F.count_if("conflict").alias("warnings")), new.groupBy("stock_code").agg(F.count("*").alias("new_disclosures"))]
    out = companies.select("stock_code").distinct()
    for part in parts:
        out = out.join(part, "stock_code", "left")
    return out.na.fill(0)


def message_totals(messages: DataFrame, results: DataFrame, routes: DataFrame, quarantine: DataFrame) -> DataFrame:
    """One row of a run: messages, distinct assigned ones, companies with any, sums over companies, quarantined rows."""
    sums = results.agg(
        F.count("*").alias("companies_considered"), F.coalesce(F.sum("matched"), F.lit(0)).alias("assignments"), F.count_if(F.col("matched") > 0).alias("companies_with_matches"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("new_quarters", "new_disclosures", "failures", "warnings")],
    )
    processed = messages.agg(F.count("*").alias("messages_processed"), F.max("id").alias("end_cursor"))
    matched = routes.where("status = 'assigned'").agg(F.count_distinct("id").alias("unique_matched"))
    held_back = quarantine.agg(F.count("*").alias("quarantine_count"))
    return sums.crossJoin(processed).crossJoin(matched).crossJoin(held_back)  # a row each


def quarter_conflicts(parsed: DataFrame) -> DataFrame:
    """(stock_code, fiscal_quarter, conflict) of ``final_quarters``: quarters by company, none of their versions picked, in one aggregate."""
    found = P.candidates(parsed, origin=["stock_code"]).where("stock_code is not null and fiscal_quarter is not null")
    values = [*P.METRICS, *[f"{m}_consensus" for m in P.METRICS]]
    differs = [F.coalesce(F.min(v) != F.max(v), F.lit(False)) | ((F.count(v) > 0) & (F.count(v) < F.count("*"))) for v in values]
    held = found.groupBy("stock_code", "fiscal_quarter").agg(reduce(or_, differs).alias("conflict"))
    return rank.top_k(held, ["stock_code"], [F.col("fiscal_quarter").desc()], 8).drop("rank")


def final_quarters(parsed: DataFrame) -> DataFrame:
    """Policy 'final wins' with history and conflicts, the last eight quarters of each company."""
    values = [*P.METRICS, *[f"{m}_consensus" for m in P.METRICS]]
    found = stored(P.candidates(parsed), "candidates")  # read three times below
    picked = series.final_wins(found, ["stock_code", "fiscal_quarter"], "provisional", [F.col("disclosure_datetime").desc_nulls_last(), F.col("id").desc(), F.col("forecasts").desc()])
    history = series.version_history(found, ["stock_code", "fiscal_quarter"], [*values, "provisional", "corrected"], "id")
    distinct = found.groupBy("stock_code", "fiscal_quarter").agg((F.count_distinct(F.struct(*[F.coalesce(F.col(v).cast("string"), F.lit("")) for v in values])) > 1).alias("conflict"))
    joined = picked.join(history, ["stock_code", "fiscal_quarter"]).join(distinct, ["stock_code", "fiscal_quarter"])
    return rank.top_k(joined, ["stock_code"], [F.col("fiscal_quarter").desc()], 8).drop("rank")


def disclosures(parsed: DataFrame, most: int = 100) -> DataFrame:
    """Disclosures by identity (receipt, else message, else time and name), newest first, capped per company."""
    named = parsed.where("report_name is not null and disclosure_datetime is not null")
    identity = F.coalesce(F.concat(F.lit("r:"), "dart_receipt_number"), F.concat(F.lit("m:"), F.col("id").cast("string")), F.concat(F.lit("t:"), "disclosure_datetime", F.lit("|"), "report_name"))
    rows = named.select("stock_code", identity.alias("identity"), "id", "disclosure_datetime", "report_name", labels.disclosure_category(F.col("report_name"), F.col("has_earnings_data")).alias("category"), labels.latest_type(F.col("report_name")).alias("label"), "dart_url", "dart_receipt_number")
    last = rank.first_per_key(rows, ["stock_code", "identity"], [F.col("id").desc()])
    return rank.top_k(last, ["stock_code"], [F.col("disclosure_datetime").desc(), F.col("identity")], most).drop("rank")


def earnings_flow(files: DataFrame) -> DataFrame:
    """Quarters of text files (path, folder_code, text, first_copy): split, parse, 'corrected, then latest', last eight."""
    kept = files.where("first_copy and text is not null and text <> ''")
    parts = cut(P.split_files(kept)).join(kept.select("path", "folder_code"), "path")
    keyed = parts.withColumn("id", F.concat_ws("|", "path", F.col("split_index").cast("string")))
    basis = keyed.select("id", "folder_code", "split_index", P.accounting_basis(F.col("text")).alias("basis"), P.metric_basis(F.col("text")).alias("metric_basis"), P.accounting_standard(F.col("text")).alias("standard"))
    found = P.candidates(cut(P.parsed_messages(keyed.select("id", "text"), date_col=None))).drop("stock_code").join(basis, "id")
    order = F.lit(0)
    for name, value in P.BASIS_RANK.items():
        order = F.when(F.col("basis") == name, value).otherwise(order)
    # a historical row never counts as corrected
    ready = found.withColumn("corrected", F.col("corrected") & F.col("is_current"))
    picked = series.corrected_latest(ready, ["folder_code", "fiscal_quarter", "metric_basis"], "corrected", "disclosure_datetime", list(P.METRICS), [F.col("is_current").desc(), F.col("forecasts").desc(), order.desc(), F.col("split_index").desc(), F.col("id")])
    return rank.top_k(picked, ["folder_code"], [F.col("fiscal_quarter").desc(), F.col("metric_basis")], 8).drop("rank")
