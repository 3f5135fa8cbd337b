"""Mixing sources to target weights by packed blocks.

Method: each source's documents, in hash order, form one stream of words that is cut into blocks
of ``block`` words; a source of less than ``LEAST_BLOCKS`` such blocks is cut finer, into that many or
single words, so that whole blocks come near its target.  Every source gets a number of slots from its target.  A keyed pseudorandom
permutation of all slots deals them to output shards, so each shard's source counts are a draw
without replacement from the sources' totals (a multinomial draw conditioned on them): totals meet
the targets exactly and every shard varies as chance has it.  The k-th slot of a source is mapped to
a block by the source's own pseudorandom index permutation, round after round through all its
blocks, and blocks are joined by index.

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating, and share all words; a
target stops at ``most`` times its source's size and the excess goes to the others by weight.
Capping in the order of (cap / weight) gives what repeated resharing gives.  A source with B
blocks has ``round(target / size * B)`` slots, so no block, and no document, is taken more than
``most`` times.

Everything is built from SQL functions.  Positions within a source are prefix sums in two levels
(sums of hash groups, then within a group), so a source is never brought into one task; the table of
sources, a row each, is.

Defined cases: null or empty text has size 0 and nothing of it is taken; a null source is a source,
last in order; null ids and repeated rows stay rows of their own, and rows that differ in any column come
back as they are, whatever they share; very long texts are cut at block
edges like any other, with a row for each of their blocks; extra columns, whatever their names, are
ignored by ``mix`` and kept by ``mixed_documents``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

#: Words in a block, slots in an output shard.
BLOCK, SHARD_SLOTS = 128, 4096
#: Blocks that a source is cut into at least, where it has as many words.
LEAST_BLOCKS = 1024
#: Hash groups that a source is cut into at least, rows of a group beyond that.
GROUPS, GROUP_ROWS = 512, 65_536
WEIGHTS = (5.0, 2.0, 1.0)
#: Slots that one row unfolds into at a time; half rounds of the index permutations.
RUN, HALF_ROUNDS = 8_192, 8


def permuted(index: Column, count: Column, seed: Column) -> Column:
    """The place of ``index`` in a pseudorandom permutation of 0 .. count - 1.

    The indices stand row by row in a square whose last row may be short.  By turns every row and
    every column is rotated by a hash of the seed, its number and the turn; each turn is a bijection,
    whatever the count, and no product exceeds it.
    """
    side = F.ceil(F.sqrt(count.cast("double"))).cast("long")
    full, rest = F.call_function("div", count, side), count % side

    def turn(x: Column, r: Column) -> Column:
        row, column = F.call_function("div", x, side), x % side
        width = F.when(row < full, side).otherwise(rest)
        height = F.when(column < rest, full + 1).otherwise(full)
        along = row * side + (column + F.pmod(F.xxhash64(seed, r, row), width)) % width
        down = (row + F.pmod(F.xxhash64(seed, r, column), height)) % height * side + column
        return F.when(r % 2 == 0, along).otherwise(down)

    return F.aggregate(F.sequence(F.lit(0), F.lit(HALF_ROUNDS - 1)), index.cast("long"), turn)


def word_count(text: Column) -> Column:
    """Number of words, that is runs of other characters than space, tab to carriage return."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def row_key(docs: DataFrame, text_col: str = "text") -> Column:
    """A hash of all columns of a row, nulls and column names told apart."""
    others = F.to_json(F.struct(*[F.col(c) for c in docs.columns if c != text_col]))
    return F.xxhash64(others, F.col(text_col).isNull(), F.coalesce(text_col, F.lit("")))


def sized_documents(docs: DataFrame, id_col: str, text_col: str, source_col: str, key: Column | None = None) -> DataFrame:
    """(id, source, size, h, row): what the mix needs of each document; h orders it within its source, ``row`` is ``key`` if given."""
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).alias("h"), (F.lit(0).cast("long") if key is None else key).alias("row"),
    )


def source_targets(sized: DataFrame, most: float = 3.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target): one row a source."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row a source from here on: the tables are as small as the list of sources
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("rank", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights_left = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    # if every source with a smaller cap / weight is full, this one's share of what is left
    share = capped.withColumn("level", left / weights_left)
    full = share.withColumn("is_full", F.col("cap") <= F.col("level") * F.col("w"))
    # the first source that is not full fixes the level for itself and all after it
    level = F.first(F.when(~F.col("is_full"), F.col("level")), ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return full.select("source", "source_size", F.when(level.isNull(), F.col("cap")).otherwise(F.col("w") * level).alias("target"))


def positioned(sized: DataFrame, groups: int = GROUPS) -> DataFrame:
    """Adds ``start``: the words of the source's documents before this one."""
    grouped = sized.withColumn("g", F.pmod(F.col("h"), F.lit(groups)).cast("int"))
    sums = grouped.groupBy("source", "g").agg(F.sum("size").alias("held"))
    before = Window.partitionBy("source").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("source").alias("s_"), F.col("g").alias("g_"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    # equal rows (id, text) are numbered together, so copies of one row don't decide the order
    inside = Window.partitionBy("source", "g").orderBy("h", "id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    within = grouped.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return within.join(bases, F.col("source").eqNullSafe(F.col("s_")) & (F.col("g") == F.col("g_"))).select("id", "source", "size", "h", "row", (F.col("base") + F.col("within")).alias("start"))


def block_words(size: Column, block: int) -> Column:
    """Words of a block of a source of so many words."""
    return F.greatest(F.lit(1), F.least(F.lit(block), F.call_function("div", size, F.lit(LEAST_BLOCKS)))).cast("long")


def drawn_slots(targets: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """(source, block, round, out_shard, position): every slot of the mix and the block it takes."""
    blocks = F.ceil(F.col("source_size") / block_words(F.col("source_size"), block)).cast("long")
    counted = targets.where(F.col("source_size") > 0).withColumn("blocks", blocks)
    counted = counted.withColumn("slots", F.round(F.col("target") / F.col("source_size") * F.col("blocks")).cast("long"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = counted.select(
        "source", "blocks", "slots", F.coalesce(F.sum("slots").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"), F.sum("slots").over(Window.partitionBy(F.lit(0))).alias("all_slots")
    ).where(F.col("slots") > 0)
    runs = numbered.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / RUN))))
    runs = runs.repartition("source", "run")
    k = runs.withColumn("k", F.explode(F.sequence(F.col("run") * RUN, F.least((F.col("run") + 1) * RUN, F.col("slots")) - 1)))
    place = permuted(F.col("offset") + F.col("k"), F.col("all_slots"), F.xxhash64(F.lit(seed)))
    index = permuted(F.col("k") % F.col("blocks"), F.col("blocks"), F.xxhash64(F.lit(seed), F.coalesce(F.col("source"), F.lit("")), F.floor(F.col("k") / F.col("blocks"))))
    return k.select("source", index.alias("block"), F.floor(F.col("k") / F.col("blocks")).cast("int").alias("round"), F.floor(place / shard_slots).alias("out_shard"), (place % shard_slots).alias("position"))


def mix(docs: DataFrame, *, most: float = 3.0, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", key: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(targets, pieces, slots): source targets, the pieces of documents in each block, the slots of the mix.

    pieces: id, source, size, start, h, row, block, from_word and to_word (of the document, end excluded);
    a document without words has one piece without a block.  Slots join pieces on (source, block).
    """
    sized = stored(sized_documents(docs, id_col, text_col, source_col, key), "sized")
    targets = source_targets(sized, most)
    placed = positioned(sized, max(GROUPS, -(-sized.count() // GROUP_ROWS)))
    words = targets.select(F.col("source").alias("b_source"), block_words(F.col("source_size"), block).alias("words"))
    in_blocks = placed.join(words, F.col("source").eqNullSafe(F.col("b_source"))).drop("b_source")
    first, last = F.call_function("div", F.col("start"), F.col("words")), F.call_function("div", F.col("start") + F.col("size") - 1, F.col("words"))
    cut = in_blocks.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    pieces = cut.withColumn("from_word", F.greatest(F.col("block") * F.col("words") - F.col("start"), F.lit(0))).withColumn("to_word", F.least((F.col("block") + 1) * F.col("words") - F.col("start"), F.col("size")))
    return targets, pieces.drop("words"), drawn_slots(targets, block, shard_slots, seed)


def shard_counts(slots: DataFrame) -> DataFrame:
    """(out_shard, source, slots): the drawn source counts of each output shard."""
    return slots.groupBy("out_shard", "source").agg(F.count("*").alias("slots"))


def taken_words(targets: DataFrame, pieces: DataFrame, slots: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id_col, size, source_size, target, taken (words of it in the mix, repeats counted), first_shard and
    last_shard (of the output shards that hold words of it; null where none does)."""
    uses = slots.groupBy(F.col("source").alias("u_source"), F.col("block").alias("u_block")).agg(F.count("*").alias("uses"), F.min("out_shard").alias("low"), F.max("out_shard").alias("high"))
    # uses grow with the input, whatever the planner makes of unfolded runs: never broadcast them
    used = pieces.join(uses.hint("merge"), F.col("source").eqNullSafe(F.col("u_source")) & (F.col("block") == F.col("u_block")), "left")
    words = F.coalesce((F.col("to_word") - F.col("from_word")) * F.col("uses"), F.lit(0))
    # documents without words may share a start; with their row count they come back one by one
    taken = used.groupBy("id", "source", "size", "start", "h").agg(F.sum(words).alias("taken"), F.min("low").alias("first_shard"), F.max("high").alias("last_shard"), F.sum(F.when(F.col("size") == 0, 1).otherwise(0)).alias("empty"))
    with_targets = taken.join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source")))
    rows = F.sequence(F.lit(1).cast("long"), F.greatest(F.col("empty"), F.lit(1)).cast("long"))
    return with_targets.withColumn("row", F.explode(rows)).select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", "first_shard", "last_shard")


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars", **options) -> DataFrame:
    """The mix as documents: the columns of ``docs``, one row for each document and round with the words taken in it.

    A document whose blocks are all taken in a round keeps its text as it is; else its text is the
    taken words, in order, with the white space behind each.  ``chars_col``, if present, is renewed.
    """
    key = row_key(docs, text_col)
    _, pieces, slots = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, key=key, **options)
    uses = slots.select(F.col("source").alias("u_source"), F.col("block").alias("u_block"), "round")
    used = pieces.join(uses.hint("merge"), F.col("source").eqNullSafe(F.col("u_source")) & (F.col("block") == F.col("u_block")))
    keys = ["row", "source", "start", "size", "round"]
    taken = used.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("from_word").cast("int").alias("a"), F.col("to_word").cast("int").alias("b")))).alias("spans"), F.sum(F.col("to_word") - F.col("from_word")).alias("words"))
    # rows that share a key are equal in all columns; each has its own start and so its own rows
    # the document's own columns stay apart, whatever their names
    texts = docs.select(F.struct("*").alias("document"), key.alias("row")).dropDuplicates(["row"])
    joined = taken.join(texts, "row")
    whole = F.col("document")[text_col]
    words = F.regexp_extract_all(whole, F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    parts = F.flatten(F.transform("spans", lambda s: F.slice(words, s["a"] + 1, s["b"] - s["a"])))
    text = F.when(F.col("words") == F.col("size"), whole).otherwise(F.array_join(parts, ""))
    kept = joined.select("document", text.alias("text"))
    columns = [F.col("text").alias(c) if c == text_col else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == chars_col else F.col("document")[c].alias(c) for c in docs.columns]
    return kept.select(*columns)
