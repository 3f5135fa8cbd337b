"""Token counts without token ids.

Method: every document is reduced to its pre-token frequencies; each distinct pre-token is counted
in pieces once; the counts are joined to the frequencies and summed per document.  No id sequence
is ever built for a document.

Frequencies travel as postings.  A *block* is some megabytes of documents; for each pre-token of a
block they hold the places of the documents and the frequencies there, packed by bucket, where a
bucket is a hash of the pre-token.  One shuffle brings a bucket's postings together, so a pre-token
meets all its postings in one task, is counted there once, and leaves one sum for each document of
each block.  A second, small shuffle adds these sums by block.  A pre-token that is frequent in a
block (``HOT`` documents) is dealt by block too, so very frequent ones spread over all tasks and
are counted once a task.  A task remembers the counts of its last ``KNOWN`` pre-tokens and more; one
that comes again after that is counted again.

Postings are packed because rows of (document, pre-token, frequency) would outgrow the input: 0.5 GB
of Parquet hold some 80 million of them (320 a document, counted on 5,000), 3.9 GB as rows before
compression; packed they take 0.4 GB.

Defined cases: a null or empty text has 0 bytes and 0 tokens; a null id is kept; repeated rows
each get their own result row; texts are counted whole, a very long one in a block of its own;
extra columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import long_rows
from .words import PreTokens, load_tokenizer, rows_of

#: Characters and documents of a block, buckets for each shuffle partition, documents that make a pre-token hot.
BLOCK_CHARS, BLOCK_DOCS, SPREAD, HOT = 2_000_000, 60_000, 8, 64
#: Pre-tokens whose counts a task keeps in each of two generations.
KNOWN = 200_000

_ROWS = "block long, bucket long, data binary"
_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("data", pa.binary())])
_HEAD = struct.Struct("<III")
_STATE: dict = {}


def _pack(words: pa.StringArray, ends: np.ndarray, pos: np.ndarray, freq: np.ndarray) -> bytes:
    """Words and their postings (ends: of each word's postings) as one compressed record."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    raw = words.buffers()[2].to_pybytes() if words.buffers()[2] else b""
    wide = int(freq.max(initial=0)) > 255
    parts = [_HEAD.pack(len(words), len(pos), wide), np.diff(offsets).astype("<u4").tobytes(), np.diff(ends, prepend=0).astype("<u4").tobytes(), pos.astype("<u2").tobytes(), freq.astype("<u4" if wide else "u1").tobytes(), raw[offsets[0] : offsets[-1]]]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(data: bytes) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Words, number of postings of each, places, frequencies."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    words, pairs, wide = _HEAD.unpack_from(raw)
    at = _HEAD.size
    lengths = np.frombuffer(raw, "<u4", words, at)
    spans = np.frombuffer(raw, "<u4", words, at + 4 * words)
    at += 8 * words
    pos = np.frombuffer(raw, "<u2", pairs, at)
    freq = np.frombuffer(raw, "<u4" if wide else "u1", pairs, at + 2 * pairs)
    at += 2 * pairs + pairs * (4 if wide else 1)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    text = pa.StringArray.from_buffers(words, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[at:]))
    return text.to_numpy(zero_copy_only=False).tolist(), spans, pos, freq


def _block(block: int, ids: list, texts: list, split: PreTokens, buckets: int):
    """Packed postings of one block, by bucket, and the record that lists its documents (bucket -1 - n)."""
    out_bucket, out_data = [], []
    words, codes, places, freqs = split.frequencies(texts)
    if len(words):
        documents = np.bincount(codes)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words.to_numpy(zero_copy_only=False).tolist()), np.uint64, len(words))
        hashes = np.where(documents >= HOT, hashes + np.uint64(block * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF), hashes)
        bucket = (hashes >> np.uint64(16)) % np.uint64(buckets)
        by_bucket = np.argsort(bucket, kind="stable")
        place = np.empty(len(by_bucket), np.int64)
        place[by_bucket] = np.arange(len(by_bucket))
        order = np.argsort(place[codes], kind="stable")
        pos, freq = places[order], freqs[order]
        ends = np.concatenate([[0], np.cumsum(documents[by_bucket])])
        sorted_words = words.take(pa.array(by_bucket))
        used, first = np.unique(bucket[by_bucket], return_index=True)
        for b, lo, hi in zip(used.tolist(), first.tolist(), [*first[1:].tolist(), len(by_bucket)], strict=True):
            out_bucket.append(b)
            out_data.append(_pack(sorted_words.slice(lo, hi - lo), ends[lo + 1 : hi + 1] - ends[lo], pos[ends[lo] : ends[hi]], freq[ends[lo] : ends[hi]]))
    sizes = np.array([len(t.encode()) if t else 0 for t in texts], "<i8")
    listed = np.array([i or 0 for i in ids], "<i8").tobytes() + sizes.tobytes() + np.array([i is None for i in ids], "u1").tobytes()
    out_bucket.append(-1 - block % buckets)
    out_data.append(struct.pack("<I", len(ids)) + listed)
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out_data), block), pa.int64()), pa.array(out_bucket, pa.int64()), pa.array(out_data, pa.binary())], schema=_ARROW)


def _postings(path: str, buckets: int):
    def run(batches):
        if _STATE.get("path") != path:
            _STATE.clear()  # a worker that is used again holds the splitter or the tokenizer, not both
            _STATE.update(path=path, split=PreTokens(path))
        split = _STATE["split"]
        block, ids, texts, size = 0, [], [], 0
        for key, doc, text in rows_of(batches):
            if not ids:
                block = key
            ids.append(doc)
            texts.append(text)
            size += len(text or "")
            if size >= BLOCK_CHARS or len(texts) >= BLOCK_DOCS:
                yield from _block(block, ids, texts, split, buckets)
                ids, texts, size = [], [], 0
        if ids:
            yield from _block(block, ids, texts, split, buckets)

    return run


class PieceCounts:
    """Numbers of pieces of pre-tokens, as the library gives them.

    Pre-tokens that begin with a space go many in a call: each one's first token, and no other, begins with a space.
    """

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.opens[[i for token, i in self.tokenizer.get_vocab().items() if token[0] == chr(288)]] = True  # the character that shows a space

    def __call__(self, words: list[str]) -> list[tuple[str, int]]:
        spaced = [w for w in words if w[0] == " " and len(w) > 1 and not w[1].isspace()]
        out = []
        for at in range(0, len(spaced), 256):
            part = spaced[at : at + 256]
            (found,) = self.tokenizer.encode_batch_fast([part], is_pretokenized=True, add_special_tokens=False)
            ends = np.r_[np.flatnonzero(self.opens[found.ids]), len(found.ids)]
            out += zip(part, np.diff(ends).tolist(), strict=True)
        other = list(set(words).difference(spaced))
        return out + list(zip(other, map(len, self.tokenizer.encode_batch_fast(other, add_special_tokens=False)), strict=True))


def _sum_pieces(path: str):
    """Counts each distinct pre-token of the partition once and sums by document; rows come by block."""

    def run(batches):
        if _STATE.get("tokenizer_path") != path:
            _STATE.clear()
            _STATE.update(tokenizer_path=path, counts=PieceCounts(path))
        counts = _STATE["counts"]
        pieces: dict[str, int] = {}
        older: dict[str, int] = {}
        block, sums = None, np.zeros(0, np.int64)

        def done():
            return pa.RecordBatch.from_pydict({"block": [block], "bucket": [0], "data": [zstandard.ZstdCompressor(level=1).compress(sums.astype("<i8").tobytes())]}, schema=_ARROW)

        for key, bucket, data in rows_of(batches):
            if bucket < 0:
                yield pa.RecordBatch.from_pydict({"block": [key], "bucket": [bucket], "data": [data]}, schema=_ARROW)
                continue
            if key != block:
                if len(sums):
                    yield done()
                block, sums = key, np.zeros(0, np.int64)
            words, spans, pos, freq = _unpack(data)
            if len(pieces) > KNOWN:
                pieces, older = {}, pieces
            new = [w for w in words if w not in pieces]
            if older:
                pieces.update((w, older[w]) for w in new if w in older)
                new = [w for w in new if w not in pieces]
            if new:
                pieces.update(counts(new))
            each = np.repeat(np.fromiter(map(pieces.__getitem__, words), np.int64, len(words)), spans)
            part = np.bincount(pos, each * freq).astype(np.int64)
            if len(part) > len(sums):
                sums = np.concatenate([sums, np.zeros(len(part) - len(sums), np.int64)])
            sums[: len(part)] += part
        if len(sums):
            yield done()

    return run


def _documents(batches):
    """Rows of the documents of each block: its list and all its sums, which come together."""
    block, listed, sums = None, b"", np.zeros(BLOCK_DOCS, np.int64)

    def done():
        (n,) = struct.unpack_from("<I", listed)
        ids, sizes = np.frombuffer(listed, "<i8", n, 4), np.frombuffer(listed, "<i8", n, 4 + 8 * n)
        none = np.frombuffer(listed, "u1", n, 4 + 16 * n).astype(bool)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=none), pa.array(sizes, pa.int64()), pa.array(sums[:n].copy(), pa.int64())], ["id", "n_bytes", "n_tokens"])

    for key, bucket, data in rows_of(batches):
        if key != block:
            if block is not None:
                yield done()
            block = key
            sums[:] = 0
        if bucket < 0:
            listed = data
        else:
            part = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i8")
            sums[: len(part)] += part
    if block is not None:
        yield done()


def pretoken_frequencies(docs: DataFrame, tokenizer_file: str, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed postings (block, bucket, data) of whole texts; records with a negative bucket list a block's documents."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_key"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_postings(tokenizer_file, buckets), _ROWS)


def token_counts(docs: DataFrame, tokenizer_file: str, *, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    long_rows(docs.sparkSession)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    postings = pretoken_frequencies(docs, tokenizer_file, SPREAD * partitions, id_col, text_col)
    sums = postings.repartition(partitions, "bucket").sortWithinPartitions("block", "bucket").mapInArrow(_sum_pieces(tokenizer_file), _ROWS)
    counted = sums.repartition(partitions, "block").sortWithinPartitions("block").mapInArrow(_documents, "id long, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
