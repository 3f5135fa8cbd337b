"""WARC derivatives: metadata and plain-text conversion records built from response records.

A response record (id, target URI, date, HTTP block) gives two records that refer to it by
WARC-Refers-To and keep its target URI and date: a ``metadata`` record whose warc-fields block
lists the source's status, headers, payload digest, title, language and outlinks, and a
``conversion`` record with the page's plain text.  Digests are SHA-1 in base 32.  Everything is SQL
functions on whole payloads, row by row, without a shuffle.

Text: comments, head, script and style go; block tags become line feeds, other tags nothing; numeric
character references and the named ones of HTML 4 are resolved, others stay as they are; runs of
blanks become one, runs of line feeds one.

Defined cases: a null block is an empty one (status 0, no headers, empty text); a block without
an empty line is all headers; a null target URI leaves the field out; repeated responses give
repeated derivatives; blocks are read whole, however long; extra columns, whatever their names, are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import gzip
import json
import uuid
from html.entities import name2codepoint

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Named character references: the library's table of HTML 4, and the apostrophe of XML.
NAMED = {**{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'"}
# What a reference looks like behind its ampersand, and what stands for page parts.
REFERENCE = "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"
DROPPED = ["(?is)<!--.*?-->", "(?is)<head[^a-z].*?</head *>", "(?is)<script[^a-z].*?</script *>", "(?is)<style[^a-z].*?</style *>"]
BLOCK_TAGS = "(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|footer|header|body|html|blockquote|pre)([^a-z0-9>][^>]*)?>"
ANY_TAG, BLANKS, FEEDS = "<[^>]*>", "[ \t\x0b\x0c\r ]+", " ?\n[ \n]*"
TITLE, LANGUAGE, LINK = "(?is)<title[^>]*>(.*?)</title", "(?i)<html[^>]*lang=\"([^\"]*)\"", "(?i)<a [^>]*href=\"([^\"]*)\""
_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def digest(data: Column) -> Column:
    """sha1:<base 32> of binary data: five hex digits at a time are four base 32 digits."""
    hexed = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.concat(F.lit("sha1:"), F.translate(F.concat(*groups), _DIGITS, _BASE32))


def record_urn(*parts: Column) -> Column:
    """<urn:uuid:...> fixed by the parts."""
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def unescaped(text: Column) -> Column:
    """Character references resolved once, from left to right; what is none stays."""
    names = F.from_json(F.lit(json.dumps(NAMED)), "map<string,string>")

    def resolved(part: Column) -> Column:
        name = F.regexp_extract(part, REFERENCE, 1)
        code = F.when(F.lower(F.substring(name, 1, 2)) == "#x", F.conv(F.substr(name, F.lit(3)), 16, 10)).when(F.substring(name, 1, 1) == "#", F.substr(name, F.lit(2))).cast("long")
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.when(code.isNull(), F.try_element_at(names, name)).when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        return F.when((name == "") | char.isNull(), F.concat(F.lit("&"), part)).otherwise(F.concat(char, F.substr(part, F.length(name) + 2)))

    return F.array_join(F.transform(F.split(text, "&"), lambda part, k: F.when(k == 0, part).otherwise(resolved(part))), "")


def plain_text(html: Column) -> Column:
    text = html
    for pattern in DROPPED:
        text = F.regexp_replace(text, pattern, " ")
    text = F.regexp_replace(F.regexp_replace(text, BLOCK_TAGS, "\n"), ANY_TAG, "")
    text = F.regexp_replace(F.regexp_replace(unescaped(text), BLANKS, " "), FEEDS, "\n")
    return F.regexp_replace(text, "^[ \n]+|[ \n]+$", "")


def response_records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of crawled pages: id_col, record_id, target_uri, warc_date, block (binary)."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(
        F.col(id_col), record_urn(F.lit("response"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(url_col), F.lit(""))).alias("record_id"),
        F.col(url_col).alias("target_uri"), F.lit(date).alias("warc_date"), F.concat(head.cast("binary"), payload).alias("block"),
    )


def derivatives(responses: DataFrame, *, id_col: str = "page_id") -> DataFrame:
    """Two rows a response: id_col, record_type, record_id, refers_to, target_uri, warc_date, content_type,
    source_content_type, source_payload_digest, block, block_digest, content_length."""
    block = F.coalesce(F.col("block"), F.lit("").cast("binary"))
    # byte positions are found in Latin-1, where a byte is a character
    latin = F.decode(block, "ISO-8859-1")
    cut = F.when(F.locate("\r\n\r\n", latin) > 0, F.locate("\r\n\r\n", latin)).otherwise(F.length(latin) + 1)
    parsed = responses.select(
        F.col(id_col).alias("key"), F.col("record_id").alias("refers_to"), "target_uri", "warc_date",
        F.substring(latin, F.lit(1), cut - 1).alias("head"), F.substring(block, cut + 4, F.length(block)).alias("payload"),
    )
    kind = F.trim(F.regexp_extract("head", "(?im)^content-type: *([^\r\n]*)", 1))
    western = F.lower(kind).rlike("charset=\"?(iso-8859-1|latin-1|latin1)")
    text = F.when(western, F.decode("payload", "ISO-8859-1")).otherwise(F.make_valid_utf8(F.col("payload").cast("string")))
    read = parsed.withColumns({"source_content_type": kind, "source_payload_digest": digest(F.col("payload")), "html": text})
    title = F.regexp_replace(F.trim(unescaped(F.regexp_extract("html", TITLE, 1))), "[\r\n]+", " ")
    links = F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lambda u: F.concat(F.lit("outlink: "), F.regexp_replace(unescaped(u), "[\r\n]+", " "), F.lit("\r\n")))
    status = F.coalesce(F.nullif(F.regexp_extract("head", "^HTTP/[0-9.]+ ([0-9]+)", 1), F.lit("")), F.lit("0"))
    headers = F.array_join(F.transform(F.filter(F.slice(F.split("head", "\r\n"), F.lit(2), F.size(F.split("head", "\r\n"))), lambda h: h != ""), lambda h: F.concat(F.lit("source-header: "), h, F.lit("\r\n"))), "")
    fields = F.concat(F.lit("fetch-status: "), status, F.lit("\r\n"), headers, F.lit("source-payload-digest: "), F.col("source_payload_digest"), F.lit("\r\ntitle: "), title, F.lit("\r\nlanguage: "), F.regexp_extract("html", LANGUAGE, 1), F.lit("\r\n"), F.array_join(links, ""))
    pair = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(F.col("html")).alias("block")),
    )
    rows = read.select("key", "refers_to", "target_uri", "warc_date", "source_content_type", "source_payload_digest", F.inline(pair))
    data = F.col("block").cast("binary")
    return rows.select(
        F.col("key").alias(id_col), "record_type", record_urn(F.col("record_type"), F.col("refers_to")).alias("record_id"), "refers_to", "target_uri", "warc_date", "content_type",
        "source_content_type", "source_payload_digest", "block", digest(data).alias("block_digest"), F.octet_length(data).cast("long").alias("content_length"),
    )


def record_bytes() -> Column:
    """A derivative row as a WARC/1.1 record (binary)."""
    field = lambda name, col: F.coalesce(F.concat(F.lit(f"{name}: "), F.col(col).cast("string"), F.lit("\r\n")), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), field("WARC-Type", "record_type"), field("WARC-Record-ID", "record_id"), field("WARC-Refers-To", "refers_to"), field("WARC-Target-URI", "target_uri"),
        field("WARC-Date", "warc_date"), field("WARC-Block-Digest", "block_digest"), field("Content-Type", "content_type"), field("Content-Length", "content_length"), F.lit("\r\n"),
    )
    return F.concat(head, F.col("block"), F.lit("\r\n\r\n")).cast("binary")


def write_warc(records: DataFrame, path: str) -> DataFrame:
    """Write derivative rows to ``path`` as gzip members, one file a task; gives (file, records) when run."""

    def run(batches):
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        name = f"{folder}/part-{TaskContext.get().partitionId():05d}.warc.gz"
        mark, n = f"{name}.{uuid.uuid4().hex}", 0
        with store.open_output_stream(mark, compression=None) as f:
            for batch in batches:
                for data in batch.column(0).to_pylist():
                    f.write(gzip.compress(data, 6, mtime=0))
                    n += 1
        store.move(mark, name)
        yield pa.RecordBatch.from_pydict({"file": [name], "records": [n]})

    return records.select(record_bytes().alias("record")).mapInArrow(run, "file string, records long")


def oracle() -> str:
    """DuckDB SQL for the derivatives of the table pages."""

    def q(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    names = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in NAMED.items()) + "}"

    def clean(x: str) -> str:
        name = f"regexp_extract(part, {q(REFERENCE)}, 1)"
        code = f"CASE WHEN lower(substr({name}, 1, 2)) = '#x' THEN TRY_CAST('0x' || substr({name}, 3) AS INTEGER) WHEN {name} LIKE '#%' THEN TRY_CAST(substr({name}, 2) AS INTEGER) END"
        valid = f"({code}) BETWEEN 1 AND 1114111 AND NOT ({code}) BETWEEN 55296 AND 57343"
        char = f"CASE WHEN {name} LIKE '#%' THEN CASE WHEN {valid} THEN chr({code}) END ELSE names[{name}] END"
        part = f"CASE WHEN {name} = '' OR ({char}) IS NULL THEN '&' || part ELSE ({char}) || substr(part, length({name}) + 2) END"
        return f"(string_split({x}, '&')[1] || array_to_string(list_transform(string_split({x}, '&')[2:], lambda part: {part}), ''))"

    def base32(data: str) -> str:
        n = f"('0x' || substr(sha1({data}), CAST(5 * g + 1 AS BIGINT), 5))::BIGINT"
        digits = " || ".join(f"substr('{_BASE32}', CAST((({n} >> {s}) & 31) + 1 AS BIGINT), 1)" for s in (15, 10, 5, 0))
        return f"'sha1:' || array_to_string([{digits} FOR g IN range(0, 8)], '')"

    def urn(text: str) -> str:
        h = f"md5({text})"
        return f"'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12) || '>'"

    feed = "chr(13) || chr(10)"
    text = "html"
    for pattern in DROPPED:
        text = f"regexp_replace({text}, {q(pattern)}, ' ', 'g')"
    text = f"regexp_replace(regexp_replace({text}, {q(BLOCK_TAGS)}, chr(10), 'g'), {q(ANY_TAG)}, '', 'g')"
    text = f"regexp_replace(regexp_replace({clean(text)}, {q(BLANKS)}, ' ', 'g'), {q(FEEDS)}, chr(10), 'g')"
    text = f"regexp_replace({text}, {q(chr(94) + '[ ' + chr(10) + ']+|[ ' + chr(10) + ']+$')}, '', 'g')"
    breaks = q("[\r\n]+")
    title = f"regexp_replace(trim({clean(f'regexp_extract(html, {q(TITLE)}, 1)')}, ' '), {breaks}, ' ', 'g')"
    links = f"array_to_string(list_transform(regexp_extract_all(html, {q(LINK)}, 1), lambda u: 'outlink: ' || regexp_replace({clean('u')}, {breaks}, ' ', 'g') || {feed}), '')"
    fields = f"'fetch-status: 200' || {feed} || 'source-header: Content-Type: text/html; charset=utf-8' || {feed} || 'source-header: Content-Length: ' || strlen(html) || {feed} || 'source-payload-digest: ' || source_payload_digest || {feed} || 'title: ' || {title} || {feed} || 'language: ' || regexp_extract(html, {q(LANGUAGE)}, 1) || {feed} || {links}"
    return f"""
    WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, {names} AS names FROM pages),
    r AS (SELECT page_id, url AS target_uri, html, names, {urn("'response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '')")} AS refers_to, {base32('html')} AS source_payload_digest FROM p),
    d AS (
      SELECT page_id, target_uri, refers_to, source_payload_digest, 'metadata' AS record_type, 'application/warc-fields' AS content_type, {fields} AS block FROM r
      UNION ALL
      SELECT page_id, target_uri, refers_to, source_payload_digest, 'conversion', 'text/plain; charset=utf-8', {text} FROM r)
    SELECT page_id, record_type, {urn("record_type || '|' || refers_to")} AS record_id, refers_to, target_uri, '2024-01-01T00:00:00Z' AS warc_date, content_type,
      'text/html; charset=utf-8' AS source_content_type, source_payload_digest, block, {base32('block')} AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length
    FROM d"""
