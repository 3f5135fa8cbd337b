"""Removal of lines that many documents share.

Method: lines are normalised, hashed and exploded, distinct documents are counted for each hash, lines
whose hash is in at least ``min_docs`` documents go, and texts are put together again by position from
the lines that stay.  A line's key is the line stripped of ASCII white space with A-Z lower-cased; keys
shorter than ``min_chars`` code points never go.

Everything is built from SQL functions.  The hashes of a document's lines (MD5, 128 bits) are written
once, in order; what is exploded is a hash, its place and its row's key, never the text of a line.  A
line that a third of all documents hold would be a hot key of the join back, so hashes with at least one
part in ``HOT`` of all lines (there can be no more than ``HOT`` of them) are broadcast, and only the others
are joined by shuffle.  Texts are read twice and shuffled once, to meet the places that they lose.

Defined cases: null and empty text are one empty line, which stays; every row is a document, so repeated
rows count as often as they are there; rows of one id with several texts are told apart by a hash of the
text; null ids are ids; very long texts are split like any other, in time linear in their lines; extra
columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

#: Hashes that are broadcast at most (16 bytes each).
HOT = 10_000
#: ASCII white space.
BLANKS = " \t\n\x0b\x0c\r"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is; texts of ASCII alone take Spark's faster lower()."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def line_hashes(text: Column, min_chars: int = 1) -> Column:
    """For each line of a text the hash of its key; null where the key is too short."""
    keys = F.transform(F.split(lower_ascii(text), "\n"), lambda line: F.btrim(line, F.lit(BLANKS)))
    return F.transform(keys, lambda key: F.when(F.length(key) >= min_chars, F.md5(key)))


def frequent_lines(hashed: DataFrame, min_docs: int) -> DataFrame:
    """(h, n_docs, n_lines): hashes of ``hashed`` (hashes: one array a document) that at least ``min_docs`` documents hold."""
    documents = hashed.select(F.explode(F.array_distinct("hashes")).alias("h"), F.lit(1).alias("n_docs"), F.lit(0).alias("n_lines"))
    lines = hashed.select(F.explode("hashes").alias("h"), F.lit(0).alias("n_docs"), F.lit(1).alias("n_lines"))
    counts = documents.unionByName(lines).where("h is not null").groupBy("h").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_lines").alias("n_lines"))
    return counts.where(F.col("n_docs") >= min_docs)


def without_places(lines: Column, places: Column) -> Column:
    """The elements of an array but those at ``places`` (sorted, from 0): the runs between two places, one after the other."""
    edges = F.concat(F.array(F.lit(-1)), places, F.array(F.size(lines)))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(places)), lambda k: F.slice(lines, edges[k] + 2, edges[k + 1] - edges[k] - 1)))


def lines_removed(docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_lines, n_dropped (longs) and kept_text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("row"))
    hashed = stored(rows.select("id", "row", line_hashes(F.col("text"), min_chars).alias("hashes")), "line-hashes")
    total = hashed.agg(F.sum(F.size("hashes").cast("long"))).first()[0] or 0
    frequent = stored(frequent_lines(hashed, min_docs), "frequent-lines")
    # sum(n_lines) <= total, so no more than HOT hashes are hot
    is_hot = F.col("n_lines") * HOT >= total
    hot, rest = F.broadcast(frequent.where(is_hot).select("h")), frequent.where(~is_hot).select("h")
    lines = hashed.select("id", "row", F.posexplode("hashes").alias("place", "h")).where("h is not null")
    common = lines.join(hot, "h", "left_semi").unionByName(lines.join(hot, "h", "left_anti").join(rest, "h", "left_semi"))
    # equal rows lose equal places: a set of them, combined before the shuffle
    losses = common.groupBy(F.col("id").alias("l_id"), F.col("row").alias("l_row")).agg(F.sort_array(F.collect_set("place")).alias("places"))
    met = rows.join(losses, F.col("id").eqNullSafe(F.col("l_id")) & (F.col("row") == F.col("l_row")), "left")
    split = F.split(F.col("text"), "\n")
    kept = F.array_join(without_places(split, F.col("places")), "\n")
    return met.select(
        F.col("id").alias(id_col), F.size(split).cast("long").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("places").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
    )


def oracle(min_docs: int = 10, min_chars: int = 1) -> str:
    """DuckDB SQL for the table documents (whose ids are unique)."""
    blanks = " || ".join(f"chr({ord(c)})" for c in BLANKS)
    return f"""
    WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    k AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM t),
    n AS (SELECT doc_id, pos, line, translate(trim(line, {blanks}), '{ascii_uppercase}', '{ascii_lowercase}') AS key FROM k),
    f AS (SELECT key FROM n WHERE length(key) >= {min_chars} GROUP BY key HAVING count(DISTINCT doc_id) >= {min_docs})
    SELECT doc_id, count(*) AS n_lines, CAST(count_if(f.key IS NOT NULL) AS BIGINT) AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
    FROM n LEFT JOIN f ON n.key = f.key GROUP BY doc_id"""
