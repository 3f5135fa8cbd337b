"""Importance resampling towards a target distribution by hashed n-gram features.

Method: word-id suffix arrays per partition.  A task takes the words of its documents in blocks, gives
them ids, and sorts the block's suffixes to the depth of the longest feature (prefix doubling).  Runs of
neighbours whose common prefix has at least k words are the occurrences of one k-gram: it is hashed
once a run, and its bucket is scattered back to all places of the run.  Documents are written with the
buckets of their features; counts of the buckets over all documents and over the target texts give each
bucket a gain, and a document's weight is the mean gain of its features.  A Gumbel draw on top of the
weight makes the highest scores a sample without replacement in proportion to the importance weights.

Bounds: a block holds ``BLOCK`` words, whatever the texts' lengths: a longer text goes on in the next
block with the words that its last features lack.  Gains are one number a bucket (``buckets`` of them), and
are all that the driver collects.  Ranks need no global sort: scores are whole numbers within about
76,000 of 0 (a gain is at most 1000 ln(2^63), the noise lies between -3,100 and 22,900), so the table of
counts by score is bounded too; it is summed up in order, and ties of one score are numbered by id
within the score.  Equal rows are counted and numbered as one, so copies of a row form no hot group.

Defined cases: null text has no words; a document without features weighs 0; every row is a document;
a null id draws the hash of "<seed>:null" and comes last among ties; texts of equal ids draw equal noise;
words longer than a block, however long, are words; extra columns, whatever their names, are ignored;
an empty table gives an empty result, and with an empty target all gains rest on T = 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import long_rows, stored
from .words import rows_of

#: Words of a block; bytes of a text that are split into words at a time.
BLOCK, PIECE = 500_000, 1 << 22
#: Ranks that one row unfolds into at a time.
RUN = 65_536
FEATURES = "id long, row long, n_words long, n_features long, ids binary"

#: Byte -> itself lower-cased, or a space where it is ASCII and no letter or digit.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def word_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text in lists of bounded size."""
    data = text.translate(_FOLD)
    at = 0
    while len(data) - at > PIECE:
        cut = data.find(b" ", at + PIECE)
        if cut < 0:
            break
        yield data[at:cut].split()
        at = cut
    yield data[at:].split()


def suffix_order(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``ids`` in the order of the suffixes that begin there, compared over at least ``depth`` ids."""
    rank, covered = ids.astype(np.int64), 1
    if depth == 1:
        return np.argsort(rank)
    while covered < depth:
        ahead = np.zeros_like(rank)
        ahead[:-covered] = rank[covered:] + 1
        key = rank * (int(rank.max()) + 2) + ahead
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
        covered *= 2
    return order


def block_buckets(words: list[bytes | None], longest: int, buckets: int) -> list[np.ndarray]:
    """For each k from 1 to ``longest`` the bucket of the k-gram that begins at each word; -1 where a None or the end cuts it off.

    ``words`` are the words of some documents with a None behind each.
    """
    known: dict[bytes | None, int] = {None: 0}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    names = list(known)[1:]
    spaced = [b"", *(b" " + w for w in names)]
    crc = np.array([0, *map(zlib.crc32, names)], np.int64)
    order = suffix_order(ids, longest)
    padded = np.r_[ids, np.zeros(longest, np.int64)]
    new_run = np.zeros(len(ids), bool)  # whether the common prefix with the suffix before is shorter than k
    new_run[:1] = True
    whole = np.ones(len(ids), bool)
    out = []
    for k in range(1, longest + 1):
        column = padded[order + k - 1]
        new_run[1:] |= column[1:] != column[:-1]
        whole &= column != 0
        heads = np.flatnonzero(new_run)
        live = heads[whole[heads]]
        first = order[live]
        hashes = crc[ids[first]].tolist()
        for j in range(1, k):
            hashes = list(map(zlib.crc32, map(spaced.__getitem__, padded[first + j].tolist()), hashes))
        of_run = np.full(len(heads), -1, np.int64)
        of_run[whole[heads]] = np.array(hashes, np.int64) % buckets
        at = np.empty(len(ids), np.int64)
        at[order] = of_run[np.cumsum(new_run) - 1]
        out.append(at)
    return out


def _kind(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


class _Blocks:
    """Collects the words of rows into blocks and gives back rows with the buckets of their features."""

    def __init__(self, longest: int, buckets: int):
        self.longest, self.buckets = longest, buckets
        self.words: list[bytes | None] = []
        self.spans: list[tuple[int, int]] = []  # of each row with words in this block: its place in rows, its first word
        self.rows: list[list] = []  # id, row key, words, parts
        self.carried = 0  # words at the head of this block that the block before has as well

    def add(self, id_, row, text: bytes | None) -> Iterator[tuple]:
        self.rows.append([id_, row, 0, []])
        self.spans.append((len(self.rows) - 1, len(self.words)))
        for piece in word_pieces(text or b""):
            self.rows[-1][2] += len(piece)
            at = 0
            while at < len(piece):
                take = max(1, BLOCK - len(self.words))
                self.words += piece[at : at + take]
                at += take
                if len(self.words) >= BLOCK and at < len(piece):
                    self._close(open_=True)
        self.words.append(None)
        if len(self.words) >= BLOCK:
            yield from self.flush()

    def _close(self, open_: bool = False) -> None:
        """Hand out the block's buckets; ``open_``: the last row goes on, so what its last words begin waits for the next block."""
        grams = block_buckets(self.words, self.longest, self.buckets) if self.words else []
        ends = [first for _, first in self.spans[1:]] + [len(self.words)]
        carry = self.words[max(self.spans[-1][1], len(self.words) - self.longest + 1) :] if open_ and self.longest > 1 else []
        for nth, ((place, first), end) in enumerate(zip(self.spans, ends, strict=True)):
            for k, gram in enumerate(grams, 1):
                # of the carried words' k-grams the block before has had those that it held whole
                found = gram[first + (max(0, self.carried - k + 1) if nth == 0 else 0) : end]
                self.rows[place][3].append(found[found >= 0].astype(_kind(self.buckets)))
        self.words, self.spans = list(carry), [(self.spans[-1][0], 0)] if open_ else []
        self.carried = len(carry)

    def flush(self) -> Iterator[tuple]:
        if self.spans:
            self._close()
        for id_, row, n_words, parts in self.rows:
            ids = np.concatenate(parts) if parts else np.zeros(0, _kind(self.buckets))
            yield id_, row, n_words, len(ids), ids.tobytes()
        self.rows = []


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "row", "n_words", "n_features", "ids"])


def hashed_features(texts: DataFrame, longest: int, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """(id, row, n_words, n_features, ids): ``ids`` are the buckets of a text's features, little-endian unsigned
    (16 bits, more than 65,536 buckets 32); ``row`` is a hash of the text."""
    long_rows(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(longest, buckets)
        for id_, row, text in rows_of(batches):
            if done := list(blocks.add(id_, row, text)):
                yield _batch(done)
        if done := list(blocks.flush()):
            yield _batch(done)

    rows = texts.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("row"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, FEATURES)


def bucket_counts(features: DataFrame, buckets: int, name: str) -> DataFrame:
    """(bucket, ``name``): how often each bucket occurs; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                counts += np.bincount(np.frombuffer(ids.as_buffer(), _kind(buckets)), minlength=buckets)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(counts[found], pa.int64())], ["bucket", "n"])

    return features.select("ids").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias(name))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) for every bucket: floor(1000 ln of the smoothed share in the target by that in the source)."""
    every = source.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    counts = every.join(source, "bucket", "left").join(target, "bucket", "left").fillna(0)
    sums = counts.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    s, t, all_s, all_t = (F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t"))
    return counts.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))).alias("gain"))


def weighted(features: DataFrame, gains: np.ndarray) -> DataFrame:
    """(id, row, n_words, n_features, weight): the floored mean gain of each document's features."""
    kind = _kind(len(gains))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(gains[np.frombuffer(ids.as_buffer(), kind)].sum()) for ids in batch.column(4)]
            weight = [total // n if n else 0 for total, n in zip(sums, batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(weight, pa.int64())], ["id", "row", "n_words", "n_features", "weight"])

    return features.mapInArrow(run, "id long, row long, n_words long, n_features long, weight long")


def gumbel(id_: Column, seed: int) -> Column:
    """floor(1000 times a Gumbel variate): the draw of an id, from 32 bits of its SHA-256 with the seed."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def _unfolded(rows: DataFrame, first: Column) -> DataFrame:
    """``copies`` rows of each row with ``place`` = first, first + 1, ...; long runs unfold in two steps."""
    runs = rows.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / RUN))))
    start = F.col("run") * RUN
    return runs.withColumn("place", F.explode(F.sequence(first + start, first + F.least(start + RUN, F.col("copies")) - 1)))


def ranked(scored: DataFrame, percent: int, min_words: int) -> DataFrame:
    """Adds ``rank`` (1, 2, ... by falling score, ties by id) to the ``percent`` highest scores of the rows with at least
    ``min_words`` words; null for the others."""
    copies = scored.groupBy(*scored.columns).agg(F.count("*").alias("copies"))
    entered = F.col("n_words") >= min_words
    by_score = scored.where(entered).groupBy("score").agg(F.count("*").alias("held"))
    # one row a score from here on: a bounded number, see above
    above = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    drawn = F.call_function("div", F.lit(percent) * F.sum("held").over(Window.partitionBy(F.lit(0))), F.lit(100))
    bases = by_score.withColumn("base", F.coalesce(F.sum("held").over(above), F.lit(0))).withColumn("drawn", drawn).where("base < drawn").select("score", "base", "drawn")
    met = copies.join(F.broadcast(bases), "score", "left")
    in_draw = entered & F.col("base").isNotNull()
    ties = Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last(), "row", "n_words", "n_features", "weight").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("base") + F.coalesce(F.sum("copies").over(ties), F.lit(0))
    high = _unfolded(met.where(in_draw).withColumn("before", before), F.col("before") + 1)
    low = _unfolded(met.where(~in_draw), F.lit(1).cast("long"))
    rank = F.when(F.col("place") <= F.col("drawn"), F.col("place"))
    return high.select(*scored.columns, rank.alias("rank")).unionByName(low.select(*scored.columns, F.lit(None).cast("long").alias("rank")))


def importance_scores(docs: DataFrame, target: DataFrame, *, longest: int = 2, buckets: int = 10_000, percent: int = 25, min_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """One row per document: id_col, row (hash of its text), n_words, n_features, weight, score, rank (null where it is not drawn)."""
    features = stored(hashed_features(docs, longest, buckets, id_col, text_col), "importance-features")
    wanted = hashed_features(target.select(F.lit(0).alias("id"), F.col(target_text_col).alias("text")), longest, buckets, "id", "text")
    table = bucket_gains(bucket_counts(features, buckets, "s"), bucket_counts(wanted, buckets, "t"), buckets)
    gains = np.zeros(buckets, np.int64)
    for r in table.collect():  # one row a bucket
        gains[r.bucket] = r.gain
    scored = stored(weighted(features, gains).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)), "importance-scores")
    return ranked(scored, percent, min_words).withColumnRenamed("id", id_col)


def resampled(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The drawn documents with all their columns; of equal rows that the draw takes some of, all come."""
    drawn = importance_scores(docs, target, id_col=id_col, text_col=text_col, **options).where("rank is not null")
    keys = drawn.select(F.col(id_col).alias("drawn_id"), F.col("row").alias("drawn_row")).distinct()
    row = F.xxhash64(F.coalesce(text_col, F.lit("")))
    return docs.join(keys, docs[id_col].cast("long").eqNullSafe(F.col("drawn_id")) & (row == F.col("drawn_row")), "left_semi")


def oracle(buckets: int = 10_000, percent: int = 25, min_words: int = 20, seed: int = 7) -> str:
    """DuckDB SQL for words and pairs of words of the tables documents (whose ids are unique) and benchmark."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '{word}')"
    table = "[list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR n IN range(256)]"
    return f"""
    WITH d AS (SELECT doc_id, {words} AS w FROM documents), b AS (SELECT {words} AS w FROM benchmark),
    df AS (SELECT doc_id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, greatest(len(w), 1))])) AS f FROM d),
    bf AS (SELECT unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, greatest(len(w), 1))])) AS f FROM b),
    u AS (SELECT f, list_transform(regexp_extract_all(hex(f), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM (SELECT f FROM df UNION SELECT f FROM bf)),
    h AS (SELECT f, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % {buckets} AS bucket FROM u, (SELECT {table} AS tab)),
    s AS (SELECT bucket, count(*) AS s FROM df JOIN h ON df.f = h.f GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM bf JOIN h ON bf.f = h.f GROUP BY bucket),
    g AS (SELECT r.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s)::DOUBLE + {buckets}) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t)::DOUBLE + {buckets})))) AS gain
          FROM (SELECT unnest(range({buckets})) AS bucket) r LEFT JOIN s ON r.bucket = s.bucket LEFT JOIN t ON r.bucket = t.bucket),
    m AS (SELECT doc_id, count(*) AS n, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM df JOIN h ON df.f = h.f JOIN g ON h.bucket = g.bucket GROUP BY doc_id),
    z AS (SELECT d.doc_id, len(d.w) AS n_words, coalesce(m.n, 0) AS n_features, coalesce(m.weight, 0) AS weight,
            coalesce(m.weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || d.doc_id), 1, 8))::BIGINT + 0.5) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN m ON d.doc_id = m.doc_id),
    k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS entered FROM z WHERE n_words >= {min_words})
    SELECT z.doc_id, n_features, weight, score, CASE WHEN rank <= {percent} * entered // 100 THEN rank END AS rank FROM z LEFT JOIN k ON z.doc_id = k.doc_id"""
