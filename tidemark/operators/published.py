"""Checks of what is published: JSON walked to any depth, terms, paths, phone numbers, owners.

Files are rows (file, code, text): ``code`` is the company whose file it is.  JSON is read as ``VARIANT`` and unfolded level by
level; a level is one generator over the containers of the level before, written once, so plans stay flat however deep files
nest, and a file with most values spreads over its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import stored

# Keys and terms that must not be published, code keys, shapes of paths and phone numbers.
FORBIDDEN_KEYS = ["body", "content", "html", "description", "client_secret", "api_hash", "session", "session_string", "phone", "phone_number", "telegram_message", "private_source_filename"]
FORBIDDEN_TEXT = ["private_samples", ".secrets", "telegram_session", "naver_client_secret"]
SAFETY_TERMS = ["private_samples", "private_source_filename", "private_source_hash", "telegram_message", "telegram_message_id", "session_string", "api_hash", "client_secret", "naver_client_secret", "phone_number", ".secrets"]
SECRET_TERMS = ["private_samples", "private_source_filename", "telegram_message", "session_string", "api_hash", "client_secret", "phone_number", ".secrets"]
CODE_KEYS = ["stock_code", "stockCode", "code"]
PARSED_KEYS = ["parsedCompanyCode", "parsed_company_code"]
DRIVE_PATH = r"(?i)(?<![A-Z0-9])[A-Z]:[\\/]"
QUOTED_PATH = r"(?i)(?:^[A-Z]:[\\/]|[\"'](?:[A-Z]:[\\/]|/(?:users|home|tmp)/))"
PHONE = r"(?<!\d)(?:\+82[- ]?10|010)[- ]\d{3,4}[- ]\d{4}(?!\d)"

_NODE = "file string, code string, path string, key string, kind string, value string"


def json_nodes(files: DataFrame) -> DataFrame:
    """(file, code, path, key, kind, value): every value of the files' JSON; containers have no value, array elements no key.

    kind is Spark's name of the type (OBJECT, ARRAY, STRING, BIGINT, BOOLEAN, VOID for null, ...).  Texts that are no JSON give nothing.
    """
    level = files.select("file", "code", F.lit("$").alias("path"), F.lit(None).cast("string").alias("key"), F.try_parse_json("text").alias("v")).where("v is not null")
    levels = []
    while True:
        kind = F.regexp_extract(F.schema_of_variant("v"), "^[A-Z_]+", 0)
        level = stored(level.withColumn("kind", kind), "json-level")
        levels.append(level.select("file", "code", "path", "key", "kind", F.when(~F.col("kind").isin("OBJECT", "ARRAY"), F.try_variant_get("v", "$", "string")).alias("value")))
        held = level.where(F.col("kind").isin("OBJECT", "ARRAY"))
        if held.isEmpty():
            break
        inner = held.select("file", "code", "path", "v").lateralJoin(level.sparkSession.tvf.variant_explode(F.col("v").outer()))
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("key")))
        level = inner.select("file", "code", F.concat("path", step).alias("path"), "key", F.col("value").alias("v"))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def _finding(rows: DataFrame, kind: str, detail: Column | None = None, n: Column | None = None) -> DataFrame:
    return rows.select("file", F.lit(kind).alias("type"), (F.lit("") if detail is None else detail).alias("detail"), (F.lit(1).cast("long") if n is None else n.cast("long")).alias("n"))


def has_term(text: Column, terms: Sequence[str]) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for term in terms:
        out = out | F.contains(low, F.lit(term))
    return out


def public_findings(files: DataFrame, message_key: str = "telegramMessageId") -> DataFrame:
    """(file, type, detail, n): all findings of published files, none where all is well.

    A file without text is missing; of one that is no JSON nothing else is looked at.  Of the rest: forbidden terms, drive paths and
    phone numbers in the text; forbidden keys at any depth (``detail`` lists them); codes that are no strings; codes of another
    company, in the file's own code, in its records and wherever the parser left one; messages that several companies own.
    """
    read = files.withColumn("valid", F.try_parse_json("text").isNotNull())
    valid = read.where("valid")
    nodes = stored(json_nodes(files), "json-nodes")
    parts = [
        _finding(read.where("text is null"), "missing_file"), _finding(read.where("text is not null and not valid"), "invalid_json"), _finding(valid.where(has_term(F.col("text"), FORBIDDEN_TEXT)), "forbidden_term"),
        _finding(valid.where(F.rlike("text", F.lit(DRIVE_PATH))), "absolute_path"), _finding(valid.where(F.rlike("text", F.lit(PHONE))), "phone_number"),
    ]
    keys = nodes.where(F.lower("key").isin(FORBIDDEN_KEYS)).groupBy("file").agg(F.array_join(F.array_sort(F.collect_set(F.lower("key"))), ",").alias("keys"))
    parts.append(_finding(keys, "forbidden_key", F.col("keys")))
    other_kind = F.col("key").isin(CODE_KEYS) & ~F.col("kind").isin("STRING", "VOID")
    parts.append(_finding(nodes.where(other_kind).groupBy("file").agg(F.count("*").alias("k")), "non_string_stock_code", n=F.col("k")))
    top = nodes.where(F.col("path").isin("$.stockCode", "$.stock_code")).groupBy("file").agg(F.max("value").alias("stated"))
    parts.append(_finding(read.where("valid").join(top, "file", "left").where("coalesce(stated, '') <> code"), "detail_company_code_mismatch"))
    records = nodes.where(F.rlike("path", F.lit(r"^\$\.[^.\[]+\[\d+\]\.(code|stock_code)$"))).where("coalesce(value, '') <> code")
    parts.append(_finding(records.groupBy("file").agg(F.count("*").alias("k")), "record_company_code_mismatch", n=F.col("k")))
    parsed = nodes.where(F.col("key").isin(PARSED_KEYS) & (F.col("kind") != "VOID") & (F.coalesce("value", F.lit("")) != F.col("code")))
    parts.append(_finding(parsed.groupBy("file", "key").agg(F.count("*").alias("k")), "parsed_company_code_mismatch", F.col("key"), F.col("k")))
    owners = nodes.where((F.col("key") == message_key) & (F.col("kind") != "VOID")).groupBy("value").agg(F.count_distinct("code").alias("k")).where("k > 1")
    parts.append(_finding(owners.withColumn("file", F.lit("*")), "cross_company_message", F.col("value"), F.col("k")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def safety_findings(files: DataFrame) -> DataFrame:
    """(file, term): every term of the stricter list that stands in a file, and ``absolute_path``."""
    low = F.lower("text")
    found = F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in SAFETY_TERMS], F.when(F.rlike("text", F.lit(QUOTED_PATH)), F.lit("absolute_path")))
    return files.select("file", F.explode(F.filter(found, lambda t: t.isNotNull())).alias("term"))


def first_secret(files: DataFrame) -> DataFrame:
    """(file, type): forbidden_term where any secret term stands in a file, and invalid_json; a file may have both."""
    kinds = F.array(F.when(has_term(F.col("text"), SECRET_TERMS), F.lit("forbidden_term")), F.when(F.col("text").isNotNull() & F.try_parse_json("text").isNull(), F.lit("invalid_json")))
    return files.select("file", F.explode(F.filter(kinds, lambda t: t.isNotNull())).alias("type"))


def platform_findings(files: DataFrame) -> DataFrame:
    """(type, detail) of files (path, content binary): names that differ in case alone, bytes that are no UTF-8, drive paths, and
    one row with the number of files with CRLF."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    read = files.select("path", text.alias("text"), F.contains(F.col("content"), F.lit(b"\r\n")).alias("crlf"))
    collide = files.groupBy(F.lower("path").alias("detail")).agg(F.count("*").alias("k")).where("k > 1").select(F.lit("case_collision").alias("type"), "detail")
    broken = read.where("text is null").select(F.lit("utf8_error").alias("type"), F.col("path").alias("detail"))
    drive = read.where(F.rlike("text", F.lit(DRIVE_PATH))).select(F.lit("absolute_path").alias("type"), F.col("path").alias("detail"))
    lines = read.agg(F.count_if("crlf").cast("string").alias("detail")).select(F.lit("crlf_files").alias("type"), "detail")
    return collide.unionByName(broken).unionByName(drive).unionByName(lines)
