"""Checks of published JSON as queries: a file of each customer, with its orders as records, some of them with faults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import published as P
from .base import query, table

_FILES = r"""i AS (SELECT o_custkey AS k, o_orderkey AS id, lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS code FROM orders),
j AS (SELECT k, string_agg('{"code":"' || CASE WHEN id % 43 = 0 THEN '000000' ELSE code END || '","telegramMessageId":' || (id % 1000) || ',"parsedCompanyCode":' || CASE WHEN id % 13 = 0 THEN '"999999"' WHEN id % 17 = 0 THEN 'null' ELSE '"' || code || '"' END || CASE WHEN id % 19 = 0 THEN ',"meta":{"Body":"x","deep":[[{"api_hash":1}]]}' ELSE '' END || '}', ',' ORDER BY id) AS items FROM i GROUP BY k),
t AS (SELECT c_custkey AS k, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code, '{"stockCode":' || CASE WHEN c_custkey % 7 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE '"' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '"' END || ',"note":"' || CASE WHEN c_custkey % 23 = 0 THEN 'in C:\\data' WHEN c_custkey % 29 = 0 THEN 'call 010-1234-5678 now' WHEN c_custkey % 31 = 0 THEN 'see .Secrets' ELSE 'fine' END || '","disclosures":[' || coalesce(items, '') || ']' || CASE WHEN c_custkey % 37 = 0 THEN '' ELSE '}' END AS body FROM customer LEFT JOIN j ON j.k = c_custkey),
f AS (SELECT code AS file, code, CASE WHEN k % 41 <> 0 THEN body END AS text FROM t),
v AS (SELECT * FROM f WHERE json_valid(text)),
n AS (SELECT v.file, v.code, x.key, x.type, x.fullkey, CASE WHEN x.type = 'VARCHAR' THEN json_extract_string(v.text, x.fullkey) ELSE CAST(x.value AS VARCHAR) END AS value FROM v, json_tree(v.text) x)"""


def json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, code, text): one file a customer."""
    code = lambda c: F.lpad(F.col(c).cast("string"), 6, "0")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    key = F.col("o_orderkey")
    item = F.concat(
        F.lit('{"code":"'), F.when(key % 43 == 0, "000000").otherwise(code("o_custkey")), F.lit('","telegramMessageId":'), (key % 1000).cast("string"), F.lit(',"parsedCompanyCode":'),
        F.when(key % 13 == 0, '"999999"').when(key % 17 == 0, "null").otherwise(quoted(code("o_custkey"))), F.when(key % 19 == 0, ',"meta":{"Body":"x","deep":[[{"api_hash":1}]]}').otherwise(""), F.lit("}"),
    )
    items = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("item")))), lambda s: s["item"]), ",").alias("items"))
    k = F.col("c_custkey")
    note = F.when(k % 23 == 0, r"in C:\\data").when(k % 29 == 0, "call 010-1234-5678 now").when(k % 31 == 0, "see .Secrets").otherwise("fine")
    body = F.concat(F.lit('{"stockCode":'), F.when(k % 7 == 0, k.cast("string")).otherwise(quoted(code("c_custkey"))), F.lit(',"note":"'), note, F.lit('","disclosures":['), F.coalesce("items", F.lit("")), F.lit("]"), F.when(k % 37 == 0, "").otherwise("}"))
    rows = table(spark, sf_dir, "customer").join(items, k == F.col("k"), "left")
    return rows.select(code("c_custkey").alias("file"), code("c_custkey").alias("code"), F.when(k % 41 != 0, body).alias("text"))


@query(f"""WITH {_FILES}
SELECT file, 'missing_file' AS type, '' AS detail, 1 AS n FROM f WHERE text IS NULL UNION ALL SELECT file, 'invalid_json', '', 1 FROM f WHERE text IS NOT NULL AND NOT json_valid(text)
UNION ALL SELECT file, 'forbidden_term', '', 1 FROM v WHERE contains(lower(text), 'private_samples') OR contains(lower(text), '.secrets')
UNION ALL SELECT file, 'absolute_path', '', 1 FROM v WHERE regexp_matches(text, '(?i)(^|[^A-Z0-9])[A-Z]:[\\\\/]') UNION ALL SELECT file, 'phone_number', '', 1 FROM v WHERE regexp_matches(text, '010[- ][0-9]{{3,4}}[- ][0-9]{{4}}')
UNION ALL SELECT file, 'forbidden_key', string_agg(DISTINCT lower(key), ',' ORDER BY lower(key)), 1 FROM n WHERE lower(key) IN ('body', 'content', 'html', 'description', 'api_hash', 'session', 'phone') GROUP BY file
UNION ALL SELECT file, 'non_string_stock_code', '', count(*) FROM n WHERE key IN ('stock_code', 'stockCode', 'code') AND type NOT IN ('VARCHAR', 'NULL') GROUP BY file
UNION ALL SELECT v.file, 'detail_company_code_mismatch', '', 1 FROM v LEFT JOIN n ON n.file = v.file AND n.fullkey = '$.stockCode' WHERE coalesce(n.value, '') <> v.code
UNION ALL SELECT file, 'record_company_code_mismatch', '', count(*) FROM n WHERE regexp_matches(fullkey, '^[$][.]disclosures[[][0-9]+[]][.]code$') AND value <> code GROUP BY file
UNION ALL SELECT file, 'parsed_company_code_mismatch', key, count(*) FROM n WHERE key IN ('parsedCompanyCode', 'parsed_company_code') AND type <> 'NULL' AND value <> code GROUP BY file, key
UNION ALL SELECT '*', 'cross_company_message', value, count(DISTINCT code) FROM n WHERE key = 'telegramMessageId' GROUP BY value HAVING count(DISTINCT code) > 1""")
def public_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings of published files, keys at any depth."""
    return P.public_findings(json_files(spark, sf_dir))


@query(rf"WITH {_FILES} SELECT file, code, fullkey AS path, CASE WHEN regexp_matches(fullkey, '[]]$') THEN NULL ELSE key END AS key, CASE type WHEN 'VARCHAR' THEN 'STRING' WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'NULL' THEN 'VOID' ELSE type END AS kind, CASE WHEN type NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN value END AS value FROM n")
def json_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the files with its path."""
    return P.json_nodes(json_files(spark, sf_dir))


@query(rf"WITH {_FILES}, w AS (SELECT unnest(['private_samples', '.secrets', 'api_hash', 'session_string', 'phone_number', 'telegram_message']) AS term) SELECT file, term FROM f, w WHERE contains(lower(text), term) UNION ALL SELECT file, 'absolute_path' FROM f WHERE regexp_matches(text, '(?i)[\"''][A-Z]:[\\/]')")
def safety_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every forbidden term of each file."""
    return P.safety_findings(json_files(spark, sf_dir))


@query(f"WITH {_FILES} SELECT file, 'forbidden_term' AS type FROM f WHERE contains(lower(text), '.secrets') OR contains(lower(text), 'api_hash') UNION ALL SELECT file, 'invalid_json' FROM f WHERE text IS NOT NULL AND NOT json_valid(text)")
def secret_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a secret term, and files that are no JSON."""
    return P.first_secret(json_files(spark, sf_dir))


@query(r"""WITH f AS (SELECT CASE WHEN page_id % 9 = 0 THEN upper(url) ELSE url END AS path, page_id % 11 = 0 AS broken, CASE WHEN page_id % 5 = 0 THEN html || chr(13) || chr(10) WHEN page_id % 7 = 0 THEN html || ' C:\x' ELSE html END AS text FROM pages)
SELECT 'case_collision' AS type, lower(path) AS detail FROM f GROUP BY lower(path) HAVING count(*) > 1 UNION ALL SELECT 'utf8_error', path FROM f WHERE broken
UNION ALL SELECT 'absolute_path', path FROM f WHERE NOT broken AND regexp_matches(text, '(?i)(^|[^A-Z0-9])[A-Z]:[\\/]') UNION ALL SELECT 'crlf_files', CAST(count(*) FILTER (contains(text, chr(13) || chr(10))) AS VARCHAR) FROM f""")
def platform_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, encodings, paths and line ends of files."""
    k = F.col("page_id")
    text = F.when(k % 5 == 0, F.concat("html", F.lit("\r\n"))).when(k % 7 == 0, F.concat("html", F.lit(" C:\\x"))).otherwise(F.col("html"))
    content = F.concat(text.cast("binary"), F.when(k % 11 == 0, F.lit(b"\xff")).otherwise(F.lit(b"")))
    return P.platform_findings(table(spark, sf_dir, "pages").select(F.when(k % 9 == 0, F.upper("url")).otherwise(F.col("url")).alias("path"), content.alias("content")))
