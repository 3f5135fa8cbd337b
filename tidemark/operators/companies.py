"""Portfolio companies: active ones, defaults, onboarding, queries to the sources, matches of files and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Call budgets by tier, validations that count, words that make a message an issuer's, terms of ambiguous names by category.
TIER_BUDGETS = {"core": (5, 2), "watch": (3, 1), "background": (1, 1)}
VALID = ["verified", "corrected"]
ISSUER_CONTEXT = r"(?i)종목\s*코드|시가총액|공시|보고서|신고서|매출|영업(?:익|이익)|순(?:익|이익)|DART|dart\.fss\.or\.kr"
FILE_CODE = r"(?im)^\s*(?:종목\s*코드|stock\s*code)\s*[:：]\s*(?:A)?([0-9A-Z]{6})\b"
FILE_NAME = r"(?im)^\s*(?:기업명|회사명|종목명)\s*[:：]\s*(.+?)\s*$"
PLAIN_KEYWORDS = ["earnings", "profit", "revenue"]


def active_companies(companies: DataFrame, enabled: str = "news_enabled") -> DataFrame:
    """Companies that are active, enabled for a flow and validated."""
    return companies.where((F.col("status") == "active") & F.col(enabled) & F.col("validation_status").isin(VALID))


def with_defaults(given: Column, defaults: Column) -> Column:
    """Settings (map) with defaults below; a key that is given keeps its value, null included."""
    return F.map_concat(F.map_filter(defaults, lambda k, _: ~F.map_contains_key(given, k)), given)


def budget_of(tier: Column, source: int) -> Column:
    out = F.lit(None).cast("int")
    for name, budgets in TIER_BUDGETS.items():
        out = F.when(tier == name, budgets[source]).otherwise(out)
    return out


def built_companies(inputs: DataFrame, validation: DataFrame, keywords: DataFrame) -> DataFrame:
    """Company rows of inputs (stock_code, company_name, category, monitoring_tier), their validation and the categories' keywords.

    Names are united without repeats; a company is active where its validation counts.
    """
    joined = inputs.join(validation, "stock_code").join(keywords, "category", "left")
    official = F.coalesce(F.nullif("official_company_name", F.lit("")), F.col("company_name"))
    valid = F.col("validation_status").isin(VALID)
    return joined.select(
        "stock_code", official.alias("company_name"), F.col("company_name").alias("input_company_name"), "category", F.coalesce(F.nullif("market", F.lit("")), F.col("category")).alias("sector"), "monitoring_tier",
        F.array_distinct(F.filter(F.array(official, F.col("company_name")), lambda n: F.trim(n) != "")).alias("aliases"), F.when(valid, "active").otherwise("inactive").alias("status"),
        *[valid.alias(f"{flow}_enabled") for flow in ("news", "disclosure", "earnings")], budget_of(F.col("monitoring_tier"), 0).alias("naver_query_budget"), budget_of(F.col("monitoring_tier"), 1).alias("gdelt_query_budget"),
        F.coalesce("keywords", F.array().cast("array<string>")).alias("important_keywords"), "validation_status",
    )


def alias_query(aliases: Column, ambiguous: Column, context: Column) -> Column:
    """Query of the first source: any alias, and for ambiguous names any context term (code, category words)."""
    quoted = lambda terms: F.concat(F.lit("("), F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR "), F.lit(")"))
    return F.when(ambiguous, F.concat(quoted(aliases), F.lit(" AND "), quoted(F.filter(context, lambda t: F.coalesce(t, F.lit("")) != "")))).otherwise(quoted(aliases))


def name_queries(name: Column, ambiguous: Column, category: Column, code: Column, keywords: Column, budget: Column) -> Column:
    """Queries of the second source within a budget: the name (with category and code if ambiguous), then name and keyword."""
    with_name = lambda term: F.concat(F.lit('"'), name, F.lit('" '), term)
    context = F.transform(F.filter(F.array(category, code), lambda t: F.coalesce(F.trim(t), F.lit("")) != ""), lambda t: with_name(F.trim(t)))
    first = F.when(ambiguous, context).otherwise(F.array(name))
    useful = F.filter(keywords, lambda k: (F.trim(k) != "") & ~F.lower(F.trim(k)).isin(PLAIN_KEYWORDS))
    # the budget is looked at behind each keyword, so one keyword query is made even where the first ones fill it
    return F.slice(F.array_distinct(F.concat(first, F.transform(useful, lambda k: with_name(F.trim(k))))), F.lit(1), F.greatest(budget, F.lit(1)))


def is_about(text: Column, code: Column, name: Column) -> Column:
    """Whether a message is about a company: its code stands in it, or its name and a word of issuers."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    by_code = F.rlike(clean, F.concat(F.lit(r"(?i)(?<!\d)(?:A)?\Q"), code, F.lit(r"\E(?!\d)")))
    return by_code | (F.contains(clean, name) & F.rlike(clean, F.lit(ISSUER_CONTEXT)))


def newest_about(messages: DataFrame, code: str, name: str, most: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Of the newest ``most`` messages those about a company (the cut is the feature)."""
    newest = messages.orderBy(F.col(id_col).desc()).limit(most)
    return newest.where(is_about(F.col(text_col), F.lit(code), F.lit(name)))


def stated(text: Column) -> dict[str, Column]:
    """Code and name that a file states, empty where it states none."""
    return {"stated_code": F.upper(F.regexp_extract(text, FILE_CODE, 1)), "stated_name": F.lower(F.trim(F.regexp_extract(text, FILE_NAME, 1)))}


def match_status(files: DataFrame, companies: DataFrame) -> DataFrame:
    """(path, folder_code, match, others): how the code and the name stated in a file agree with its folder.

    files: path, folder_code, text; companies: stock_code, company_name, terms (all names).  Names join by equality.
    """
    return matched(files.select("path", "folder_code", *[c.alias(k) for k, c in stated(F.col("text")).items()]), companies).select("path", "folder_code", "match", "others")


def matched(files: DataFrame, companies: DataFrame) -> DataFrame:
    """Adds match and others (``match_status``) to files (path, folder_code, stated_code, stated_name, ...), in place of these two.

    Each file meets one row at most of each lookup, so files are not grouped; those that have nothing to look up are spread by
    their path.
    """
    codes_ = companies.select("stock_code").distinct()
    names = companies.select(F.col("stock_code").alias("n_code"), F.explode(F.array_distinct(F.transform(F.concat(F.array("company_name"), "terms"), lambda n: F.lower(n)))).alias("n_name"), F.lower("company_name").alias("own"))
    by_name = names.where("n_name <> ''").groupBy("n_name").agg(F.collect_set("n_code").alias("named"), F.collect_set(F.when(F.col("n_name") == F.col("own"), F.col("n_code"))).alias("exact"))
    looked_up = lambda value, when: F.when(when, value).otherwise(F.concat(F.lit("\x01"), "path"))
    code, folder, name = F.col("stated_code"), F.col("folder_code"), F.col("stated_name")
    joined = files.join(codes_.withColumnRenamed("stock_code", "f_code"), folder == F.col("f_code"), "left")
    joined = joined.withColumn("c_key", looked_up(code, (code != "") & (code != folder))).join(codes_.withColumnRenamed("stock_code", "c_code"), F.col("c_key") == F.col("c_code"), "left")
    joined = joined.withColumn("n_key", looked_up(name, name != "")).join(by_name, F.col("n_key") == F.col("n_name"), "left")
    none = F.array().cast("array<string>")
    others = F.array_sort(F.array_distinct(F.filter(F.concat(F.array("c_code"), F.coalesce("named", none)), lambda c: c.isNotNull() & (c != F.col("folder_code")))))
    own_code, own_name = F.coalesce(code == F.col("f_code"), F.lit(False)), F.array_contains(F.coalesce("named", none), folder)
    all_others = joined.withColumn("others", F.when(F.col("f_code").isNull(), none).otherwise(others))
    status = (
        F.when(F.col("f_code").isNull(), "unknown_company").when(F.size("others") > 0, "company_mismatch")
        .when(own_code & F.array_contains(F.coalesce("exact", none), folder), "exact_match").when(own_code & own_name, "alias_match").otherwise("folder_only_match")
    )
    return all_others.withColumn("match", status).drop("stated_code", "stated_name", "f_code", "c_code", "c_key", "n_key", "n_name", "named", "exact")
