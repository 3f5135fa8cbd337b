"""Quality rules: base counts and n-gram perplexity bands.

Method: a modified Kneser-Ney model of order 4 over the bytes of the texts, one for each language,
is counted by Spark over all documents: 4-gram counts, continuation counts for the lower orders,
discounts from the counts of counts, interpolated down to 1/256.  Every order keeps a probability
for each of its n-grams and a back-off weight for each context, so texts outside the model are
scored too.

The verdict's perplexity is two to the bits of a text for each of its letters and digits (bytes of
other scripts count as letters).  Symbols and separators cost bits and are no letters, so stuffing a
text with them raises it, however regular they are.  Each language has a band around the median over
all its documents, in units of the median absolute deviation; short texts vary more, so the band of a
text with n letters is wider by ``sqrt((n + SHORT) / n)``.  Documents outside are rejected.

Every n-gram has an entry of its own, and every language a model.  Documents are packed into blocks
of one language; the distinct 4-grams of each block are joined to the model, and a block is scored
by the sorted hash array of its own n-grams.  No table that grows is broadcast, and a task holds a block.

Defined cases: null and empty texts have no words and fail the base rules; a text without letters has
no perplexity a letter and is rejected; a null language is a language of its own; null ids are kept;
repeated rows each get their own result row; texts are scored whole, however long; extra columns,
whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bz2
import secrets
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

ORDER = 4
#: Rejection: base rules.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Bands in bits a letter: median - max(LOW x mad, LOW_BITS) to median + max(HIGH x mad, HIGH_BITS), for long texts; letters of a short text.
LOW, LOW_BITS, HIGH, HIGH_BITS, SHORT = 8.0, 0.3, 9.0, 0.3, 300.0
#: Bytes of texts in a block, and of all blocks that a task has open.
BLOCK_BYTES, OPEN_BYTES = 8_000_000, 16_000_000
_SPACES, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LETTERS = np.array([b > 127 or chr(b).isalnum() for b in range(256)])


def word_grams(text: bytes, width: int = 5) -> tuple[list[bytes], np.ndarray]:
    """Words of a text and the 64-bit hashes of its windows of ``width`` words."""
    words = text.split()
    if len(words) < width:
        return words, np.empty(0, np.uint64)
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint64, len(words))
    distinct = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
    h = distinct[codes.astype(np.int64)]
    n = len(words) - width + 1
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * _ODD + (h[k : k + n] ^ (h[k : k + n] >> np.uint64(32)))
    return words, total


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode()
    words, windows = word_grams(raw)
    chars = len(text) - (len(raw) - len(raw.translate(None, _SPACES)))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip(_SPACES)]
    repeated = 0
    if len(windows) > 1:
        _, inverse, times = np.unique(windows, return_inverse=True, return_counts=True)
        again = times[inverse] > 1
        if again.any():
            covered = np.zeros(len(words) + 1, np.int64)
            at = np.flatnonzero(again)
            np.add.at(covered, at, 1)
            np.add.at(covered, at + 5, -1)
            repeated = int(np.count_nonzero(np.cumsum(covered)[:-1] > 0))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def byte_grams(raw: bytes) -> np.ndarray:
    """The 4-gram code that ends at each byte, three line feeds before the first."""
    b = np.frombuffer(b"\n\n\n" + raw, np.uint8).astype(np.uint32)
    return (b[:-3] << np.uint32(24)) | (b[1:-2] << np.uint32(16)) | (b[2:-1] << np.uint32(8)) | b[3:]


def slots_of(grams: np.ndarray) -> np.ndarray:
    """Hashes of n-gram codes: multiplication by an odd number modulo 2^32, so different codes have different hashes."""
    return grams.astype(np.int64) * 1_640_531_527 % 4_294_967_296


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_BLOCK = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("grams", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("texts", pa.binary())])


def _pack(batches):
    """Blocks: distinct 4-grams with counts; ids, base counts (five a document), sizes and texts of the documents."""
    open_: dict = {}
    size: dict = {}

    def out(lang):
        rows = open_.pop(lang)
        size.pop(lang)
        raws = [raw for _, _, raw in rows]
        found = [byte_grams(raw) for raw in raws if raw]
        grams, times = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0), np.empty(0))
        columns = [secrets.randbits(63), lang, grams.astype(np.int64), times.astype(np.int64), [r[0] for r in rows], [c for r in rows for c in r[1]], [len(raw) for raw in raws], bz2.compress(b"".join(raws))]
        return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(columns, _BLOCK, strict=True)], schema=_BLOCK)

    for batch in batches:
        for key, lang, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            raw = text.encode() if text else b""
            open_.setdefault(lang, []).append((key, base_counts(text), raw))
            size[lang] = size.get(lang, 0) + len(raw) + 100
            if size[lang] > BLOCK_BYTES:
                yield out(lang)
            elif sum(size.values()) > OPEN_BYTES:
                yield out(max(size, key=size.get))
    for lang in list(open_):
        yield out(lang)


def packed(docs: DataFrame, id_col: str | None, text_col: str, lang_col: str) -> DataFrame:
    """Blocks of documents of one language.  Block numbers are drawn, so the table must be stored before it is used twice."""
    key = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")
    rows = docs.select(key.alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_pack, "block long, lang string, grams array<long>, times array<long>, ids array<long>, counts array<long>, sizes array<long>, texts binary")


def block_counts(blocks: DataFrame) -> DataFrame:
    """(lang, gram, c): 4-gram counts of all blocks by language."""
    each = blocks.select("lang", F.inline(F.arrays_zip("grams", "times")))
    return each.groupBy("lang", F.col("grams").alias("gram")).agg(F.sum("times").alias("c"))


def gram_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, c): 4-gram counts of all documents by language."""
    return block_counts(packed(docs, None, text_col, lang_col))


def model_groups(counts: DataFrame, most: int) -> DataFrame:
    """(lang, model): the most frequent languages; ``quality`` has a model for each language and does not use it."""
    sizes = counts.groupBy("lang").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "lang").limit(most)
    return sizes.select("lang", F.coalesce("lang", F.lit("")).alias("model"))


def model_name(lang: Column) -> Column:
    """The key of a language's model; a null language has one of its own."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


class LanguageModel(NamedTuple):
    """Tables by order: ``probabilities`` (model, gram, p) and ``backoffs`` (model, context, b)."""

    probabilities: dict[int, DataFrame]
    backoffs: dict[int, DataFrame]


def kneser_ney(counts: DataFrame) -> LanguageModel:
    """The model of 4-gram counts (model, gram, c); probabilities are interpolated, back-off weights are what a context leaves to the order below."""
    levels = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):
        # continuation counts: in how many different longer n-grams each one is the end
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * n) - 1))
        levels[n] = levels[n + 1].groupBy("model", suffix.alias("gram")).agg(F.count("*").alias("c"))
    model = LanguageModel({}, {})
    for n in range(1, ORDER + 1):
        level = levels[n]
        stats = level.groupBy("model").agg(*[F.sum((F.col("c") == k).cast("double")).alias(f"n{k}") for k in range(1, 5)])
        y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))

        def discount(k: int, y=y):
            d = k - (k + 1) * y * F.col(f"n{k + 1}") / F.greatest(F.col(f"n{k}"), F.lit(1.0))
            return F.least(F.greatest(d, F.lit(0.01)), F.lit(k - 0.01))

        # a row a language, written so that its size is known when the join is planned
        rates = stored(stats.select("model", *[discount(k).alias(f"d{k}") for k in (1, 2, 3)]), f"rates{n}")
        each = level.join(rates, "model").select("model", "gram", "c", F.shiftright("gram", 8).alias("context"), F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")).alias("d"))
        contexts = each.groupBy("model", "context").agg(F.sum("c").alias("total"), F.sum("d").alias("freed"))
        joined = each.join(contexts, ["model", "context"])
        if n == 1:
            below = joined.withColumn("q", F.lit(1.0 / 256))
        else:
            shorter = model.probabilities[n - 1].select("model", F.col("gram").alias("suffix"), F.col("p").alias("q"))
            below = joined.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1))).join(shorter, ["model", "suffix"])
        left = F.col("freed") / F.col("total")
        order = stored(below.select("model", "gram", "context", ((F.col("c") - F.col("d")) / F.col("total") + left * F.col("q")).alias("p"), left.alias("b")), f"order{n}")
        model.probabilities[n] = order.select("model", "gram", "p")
        model.backoffs[n] = order.groupBy("model", "context").agg(F.first("b").alias("b"))
    return model


def log_probabilities(grams: DataFrame, model: LanguageModel) -> DataFrame:
    """(model, gram, logp): log2 probability of every distinct 4-gram (model, gram); what an order has not seen goes to the
    order below, times the context's back-off weight where the context is known."""
    top = model.probabilities[ORDER]
    seen = grams.join(top.hint("merge"), ["model", "gram"])
    unseen = grams.join(top.hint("merge"), ["model", "gram"], "left_anti")
    p = F.lit(1.0 / 256)
    for n in range(1, ORDER + 1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * n) - 1))
        unseen = unseen.withColumn("context", F.shiftright(suffix, 8)).join(model.backoffs[n].withColumnRenamed("b", f"b{n}").hint("merge"), ["model", "context"], "left").drop("context")
        p = p * F.coalesce(F.col(f"b{n}"), F.lit(1.0))
        if n < ORDER:
            found = model.probabilities[n].select("model", F.col("gram").alias("suffix"), F.col("p").alias(f"p{n}"))
            unseen = unseen.withColumn("suffix", suffix).join(found.hint("merge"), ["model", "suffix"], "left").drop("suffix")
            p = F.coalesce(F.col(f"p{n}"), p)
    return seen.select("model", "gram", F.log2("p").alias("logp")).unionByName(unseen.select("model", "gram", F.log2(p).alias("logp")))


def byte_bits(raw: bytes, arrays: dict[int, tuple[np.ndarray, ...]]) -> np.ndarray:
    """Negative log2 probability of each byte.  arrays, by order: sorted slots and log2 probabilities, and where the order has
    them, sorted slots of contexts and log2 back-off weights.  What no order has seen counts 1/256 (8 bits)."""
    grams = byte_grams(raw).astype(np.int64)
    bits = np.full(len(grams), 8.0)
    given = np.zeros(len(grams))  # bits of the back-off weights passed
    open_ = np.arange(len(grams))
    for n in range(ORDER, 0, -1):
        if n not in arrays or not len(open_):
            continue
        slots, logp, *backoffs = arrays[n]
        suffix = grams[open_] & ((1 << 8 * n) - 1)
        want = slots_of(suffix)
        at = np.minimum(np.searchsorted(slots, want), len(slots) - 1)
        seen = slots[at] == want
        bits[open_[seen]] = given[open_[seen]] - logp[at[seen]]
        open_ = open_[~seen]
        if backoffs and len(open_):
            contexts, weights = backoffs
            want = slots_of(suffix[~seen] >> 8)
            at = np.minimum(np.searchsorted(contexts, want), len(contexts) - 1)
            given[open_] -= np.where(contexts[at] == want, weights[at], 0.0)
    bits[open_] = 8.0 + given[open_]
    return bits


def bits_per_byte(raw: bytes, arrays: dict[int, tuple[np.ndarray, ...]]) -> float:
    """Mean negative log2 probability a byte."""
    return float(byte_bits(raw, arrays).mean())


_SCORED = f"id long, lang string, {', '.join(f'{c} long' for c in _COUNTS)}, bits double, letters long, letter_bits double"


def _score(batches):
    """Rows of documents from blocks with the log-probabilities of their n-grams."""
    for batch in batches:
        for k in range(batch.num_rows):
            lang, ids, counts, sizes, texts, grams, logp = (batch.column(n).slice(k, 1) for n in range(7))
            grams, logp = (np.asarray(c[0].values.to_numpy(zero_copy_only=False)) if c[0].is_valid else np.empty(0) for c in (grams, logp))
            slots = slots_of(grams)
            order = np.argsort(slots)
            arrays = {ORDER: (slots[order], logp[order])} if len(slots) else {}
            raws, bits, letters, by_letter, at = bz2.decompress(texts[0].as_py()), [], [], [], 0
            for n in sizes[0].as_py():
                raw = raws[at : at + n]
                total = float(byte_bits(raw, arrays).sum())
                held = int(np.count_nonzero(_LETTERS[np.frombuffer(raw, np.uint8)]))
                bits.append(total / n if n else None)
                letters.append(held)
                by_letter.append(total / held if held else None)
                at += n
            base = counts[0].values.to_numpy().reshape(-1, len(_COUNTS))
            langs = pa.array([lang[0].as_py()] * len(bits), pa.string())
            columns = [pa.array(ids[0].as_py(), pa.int64()), langs, *[pa.array(np.ascontiguousarray(base[:, n])) for n in range(len(_COUNTS))], pa.array(bits, pa.float64()), pa.array(letters, pa.int64()), pa.array(by_letter, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "lang", *_COUNTS, "bits", "letters", "letter_bits"])


def language_model(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """The model counted over all of ``docs``."""
    return _counted_model(stored(packed(docs, None, text_col, lang_col).select("lang", "grams", "times"), "reference"))


def _counted_model(blocks: DataFrame) -> LanguageModel:
    counts = block_counts(blocks).select(model_name(F.col("lang")).alias("model"), "gram", "c")
    return kneser_ney(stored(counts, "grams"))


def scored_documents(docs: DataFrame, model: LanguageModel | None = None, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Written rows (id, lang, base counts, bits, letters, letter_bits); the model is that of ``docs`` where none is given."""
    blocks = stored(packed(docs, id_col, text_col, lang_col), "blocks")
    model = model or _counted_model(blocks)
    wanted = blocks.select("block", model_name(F.col("lang")).alias("model"), F.explode("grams").alias("gram"))
    known = log_probabilities(wanted.select("model", "gram").distinct(), model)
    # both grow with the corpus: never broadcast
    found = wanted.join(known.hint("merge"), ["model", "gram"]).groupBy("block").agg(F.collect_list(F.struct("gram", "logp")).alias("found"))
    own = found.select("block", F.col("found.gram").alias("own"), F.col("found.logp").alias("logp"))
    ready = blocks.drop("grams", "times").join(own.hint("merge"), "block", "left").select("lang", "ids", "counts", "sizes", "texts", "own", "logp")
    return stored(ready.mapInArrow(_score, _SCORED), "scored")


def quality(docs: DataFrame, *, model: LanguageModel | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id_col, base counts, base_failed, kept, perplexity (a byte), letter_perplexity and its band."""
    scored = scored_documents(docs, model, id_col=id_col, text_col=text_col, lang_col=lang_col).withColumn("model", model_name(F.col("lang")))
    # tables of a row a language, written so that their size is known when the joins are planned
    middle = stored(scored.groupBy("model").agg(F.percentile_approx("letter_bits", 0.5, 10_000).alias("middle")), "middle")
    widening = F.sqrt((F.col("letters") + SHORT) / F.col("letters"))
    off = F.abs(F.col("letter_bits") - F.col("middle")) / widening
    spread = stored(scored.where("letters > 0").join(middle, "model").groupBy("model").agg(F.first("middle").alias("middle"), (F.percentile_approx(off, 0.5, 10_000) * 1.4826).alias("mad")), "spread")
    low = F.col("middle") - F.greatest(LOW * F.col("mad"), F.lit(LOW_BITS)) * widening
    high = F.col("middle") + F.greatest(HIGH * F.col("mad"), F.lit(HIGH_BITS)) * widening
    banded = scored.join(spread, "model", "left").withColumns({"low": F.when(F.col("letters") > 0, low), "high": F.when(F.col("letters") > 0, high)})
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    inside = F.coalesce(F.col("letter_bits").between(F.col("low"), F.col("high")), F.lit(False))
    return banded.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & inside).alias("kept"),
        F.pow(F.lit(2.0), "bits").alias("perplexity"), F.pow(F.lit(2.0), "letter_bits").alias("letter_perplexity"), F.pow(F.lit(2.0), "low").alias("band_low"), F.pow(F.lit(2.0), "high").alias("band_high"),
    )
