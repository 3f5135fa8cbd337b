"""Interaction audit of filters: what each filter removes in every order in which they can be applied.

Method: direct relational replay.  Every document's failed filters are a bit mask; the masks are
crossed with the broadcast table of all orders (120 for five filters, a number that the filters fix
and the data don't), each pair gets the step of its first failure, the steps are exploded, and
conditional counts are aggregated by part, order and step.  Rows of the cross never leave their
task: the partial aggregate holds one row for each part, order and step, and only those are
shuffled.  Texts are read once, masks are written once.

The text filters are A: fewer than ``min_words`` words; B: distinct words below a share of the words;
C: capitals A-Z above a share of the code points; D: holds a symbol; E: equal to the text of a
smaller id anywhere in the table.  For E the least id of each text's hash (SHA-256) is aggregated
and joined on hash and id together, so a text that a third of all rows share is no hot key.

Defined cases: null text is the empty text (its copies, null or empty, are equal); a row without an
id has no smaller id and is none, so it passes E, and has no labels; rows that share id and text are
documents of their own, all or none of which pass E; a document is good or toxic if any of its label
rows says so; a null part is the empty string; very long texts are split into words like any other;
extra columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .storage import stored

#: Documents of one task of the replay: each becomes a row for every order and step.
TASK_ROWS = 50_000
SYMBOLS = r"[#$%&*|]"
WORD = r"[^\x20\x09-\x0D]+"
FILTERS = ("A", "B", "C", "D", "E")


def text_failures(text: Column, min_words: int = 100, distinct_percent: int = 80, capital_percent: int = 10) -> dict[str, Column]:
    """Filter name -> whether a text (not null) fails it, for the filters that look at one text alone."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < min_words,
        "B": F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * distinct_percent,
        "C": capitals.cast("long") * 100 > F.length(text).cast("long") * capital_percent,
        "D": text.rlike(SYMBOLS),
    }


def flagged_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, fails, good, toxic): one row per document; bit k of ``fails`` is the k-th filter of ``FILTERS``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"))
    alone = text_failures(F.col("text"))
    bits = sum((F.when(fails, 1 << FILTERS.index(name)).otherwise(0) for name, fails in alone.items()), F.lit(0))
    masks = stored(rows.select("id", "part", bits.alias("own"), F.unhex(F.sha2(F.col("text"), 256)).alias("h")), "audit-masks")
    firsts = masks.groupBy("h").agg(F.min("id").alias("id")).where("id is not null").withColumn("is_first", F.lit(True))
    judged = masks.join(firsts, ["id", "h"], "left")
    copy = F.col("id").isNotNull() & F.col("is_first").isNull()
    # null ids meet no labels: an inner equality never holds for them
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    found = judged.join(marks, "id", "left")
    fails = F.col("own") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)
    return found.select("id", "part", fails.alias("fails"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def order_table(like: DataFrame, names: Sequence[str]) -> DataFrame:
    """(filter_order, bits): every order of the filters, and the mask bit of the filter at each step."""
    orders = [("".join(o), [1 << names.index(n) for n in o]) for o in permutations(names)]
    return like.sparkSession.createDataFrame(orders, "filter_order string, bits array<int>")


def replayed(flags: DataFrame, names: Sequence[str] = FILTERS) -> DataFrame:
    """Counts by part, filter_order and step of documents (part, fails, good, toxic) sent through every order.

    kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley are longs; ``filter`` names the step's filter.
    At most 7 filters: the orders are broadcast, and 7! is 5,040 rows.
    """
    if len(names) > 7:
        raise ValueError("more than 7 filters have too many orders to broadcast")
    steps = range(1, len(names) + 1)
    crossed = flags.crossJoin(F.broadcast(order_table(flags, names)))
    first = F.lit(len(names) + 1)
    for k in reversed(steps):
        first = F.when(F.col("fails").bitwiseAND(F.col("bits")[k - 1]) != 0, k).otherwise(first)
    each = crossed.withColumn("first", first).withColumn("step", F.explode(F.array(*map(F.lit, steps))))
    bit = F.col("bits")[F.col("step") - 1]
    each = each.select("part", "filter_order", "step", "first", "fails", "good", "toxic", bit.alias("bit"))
    failing, removed = F.col("fails").bitwiseAND(F.col("bit")) != 0, F.col("first") == F.col("step")
    counts = each.groupBy("part", "filter_order", "step", "bit").agg(
        F.count_if(F.col("first") > F.col("step")).alias("kept"),
        F.count_if(removed).alias("removed"),
        F.count_if(failing & (F.col("first") < F.col("step"))).alias("redundant"),
        F.count_if(F.col("fails") == F.col("bit")).alias("unique_fails"),
        F.count_if(removed & F.col("good")).alias("good_lost"),
        F.count_if(removed & F.col("toxic")).alias("toxic_lost"),
    )
    # a row for each part, order and step is left: the sums over orders are taken of them
    over_orders = F.sum("removed").over(Window.partitionBy("part", "bit"))
    return counts.withColumn("shapley", over_orders).withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1))).drop("bit")


def filter_audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """The replay of the five text filters over ``docs``: see ``flagged_documents`` and ``replayed``."""
    flags = stored(flagged_documents(docs, labels, **columns), "audit-flags")
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-flags.count() // TASK_ROWS))
    return replayed(flags.drop("id").repartition(tasks))


def oracle() -> str:
    """DuckDB SQL for the audit of the tables documents and labels."""
    orders = ", ".join("('" + "".join(o) + "')" for o in permutations(FILTERS))
    word = r"[^\x20\x09-\x0D]+"
    return f"""
    WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
    l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    m AS (SELECT text, min(doc_id) AS least FROM t GROUP BY text),
    f AS (SELECT t.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic, (CASE WHEN len(w) < 100 THEN 'A' ELSE '' END)
            || (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END)
            || (CASE WHEN 100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 10 * length(t.text) THEN 'C' ELSE '' END)
            || (CASE WHEN regexp_matches(t.text, '{SYMBOLS}') THEN 'D' ELSE '' END)
            || (CASE WHEN t.doc_id > m.least THEN 'E' ELSE '' END) AS fails
          FROM t JOIN m ON t.text = m.text LEFT JOIN l ON t.doc_id = l.doc_id),
    o AS (SELECT filter_order, step, filter_order[step] AS flt, filter_order[1:step - 1] AS before FROM (VALUES {orders}) v(filter_order), (SELECT unnest(range(1, 6)) AS step)),
    g AS (SELECT part, fails, count(*) AS n, count_if(good) AS n_good, count_if(toxic) AS n_toxic FROM f GROUP BY part, fails),
    x AS (SELECT *, contains(fails, flt) AS fail, regexp_matches(fails, '[' || before || '_]') AS gone FROM g, o),
    c AS (SELECT part, filter_order, step, flt AS filter,
            CAST(coalesce(sum(n) FILTER (NOT fail AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (fail AND NOT gone), 0) AS BIGINT) AS removed,
            CAST(coalesce(sum(n) FILTER (fail AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails = flt), 0) AS BIGINT) AS unique_fails,
            CAST(coalesce(sum(n_good) FILTER (fail AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n_toxic) FILTER (fail AND NOT gone), 0) AS BIGINT) AS toxic_lost
          FROM x GROUP BY ALL)
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
      CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM c"""
