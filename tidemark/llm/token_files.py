"""Token ids as flat binary files with 64-bit document offsets.

Format, a folder of shards in ascending document order: ``ids-NNNNN.bin`` holds unsigned integers
(16 bit where the vocabulary allows, else 32 bit, little-endian), ``off-NNNNN.bin`` unsigned 64-bit
offsets of the shard's documents (one more than documents, from 0) and ``doc-NNNNN.bin`` signed
64-bit document ids; ``manifest.json`` holds, for each shard, its counts and its base: the prefix
sum of the tokens of the shards before it.  A document's start is base + offset.  Readers map the
files into memory where they are local.

Texts are encoded where they are read; only ids move.  Documents are dealt to shards by range of id,
at approximate quantiles of the ids; rows that share an id (and rows without one) are dealt to all
shards between the quantiles that equal it, by a hash of the text.  A shard is written under a
temporary name and renamed, so a repeated task replaces it whole.

Defined cases: a null or empty text is the end id alone; null ids come first and are read back as
null; rows of one id stand in the order of a hash of their texts, without text first; repeated rows
are written each (equal rows in one shard); texts are encoded whole, however long, and a shard's task
holds one of them and a bounded batch; extra columns, whatever their names, are ignored; an empty table gives no documents.
"""

from __future__ import annotations

import json
import string
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from .storage import long_rows
from .words import Known, load_tokenizer, rows_of, segments, specials_pattern

#: Characters encoded together, text bytes of a shard, chunks that an encoder keeps.
BLOCK_CHARS, SHARD_BYTES, CACHED = 3_000_000, 256 << 20, 800_000
_LEAST = -(1 << 63)
_PUNCTUATION = string.punctuation


def id_kind(tokenizer: Tokenizer) -> np.dtype:
    """The unsigned integers that hold a vocabulary's ids."""
    return np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")


class ByteIds:
    """Ids of whole texts as the library gives them, from ids of chunks that it encoded once."""

    def __init__(self, path: str, cached: int = CACHED):
        self.tokenizer = load_tokenizer(path)
        self.kind = id_kind(self.tokenizer)
        self.specials = specials_pattern(path)
        self.heads, self.tails = Known(cached), Known(cached)
        self.marks: dict[str, bytes] = {}
        # letters alone are one pre-token: they need the byte characters but not the split pattern
        self.letters = load_tokenizer(path)
        self.letters.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)  # tokens that begin with a space, shown as the character 256 + 32
        self.opens[[i for token, i in self.tokenizer.get_vocab().items() if token[0] == chr(288)]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str], lead: str, tokenizer: Tokenizer) -> list[bytes]:
        """Words without spaces; behind a space many go in one call, as each one's first token tells its start."""
        if not lead:
            return [np.array(e.ids, self.kind).tobytes() for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        out: list[bytes] = []
        size = self.kind.itemsize
        for at in range(0, len(words), 256):
            (found,) = tokenizer.encode_batch_fast([[lead + w for w in words[at : at + 256]]], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(found.ids, self.kind)
            cuts = [*(np.flatnonzero(self.opens[ids]) * size).tolist(), len(ids) * size]
            flat = ids.tobytes()
            out += [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    def _learn(self, known: Known, chunks: set[str], lead: str) -> None:
        """A word of letters and the punctuation behind it are never one pre-token, so both are encoded by themselves."""
        missing = known.missing(chunks)
        now = known.now
        rest = [c for c in missing if not c.isalpha()]
        words = {c for c in missing if c.isalpha()}
        bare = [c.rstrip(_PUNCTUATION) for c in rest]
        marked = [(c, w) for c, w in zip(rest, bare, strict=True) if w.isalpha()]
        words.update([w for _, w in marked])
        plain = list(words.difference(now))
        now.update(zip(plain, self._encode_words(plain, lead, self.letters), strict=True))
        other = [c for c, w in zip(rest, bare, strict=True) if not w.isalpha()]
        unsafe = [c for c in other if not c or c[0].isspace() or c[-1].isspace()]
        now.update(dict.fromkeys(unsafe))  # the cut is not safe at these
        safe = [c for c in other if c not in now]
        now.update(zip(safe, self._encode_words(safe, lead, self.tokenizer), strict=True))
        unseen = list({c[len(w) :] for c, w in marked} - self.marks.keys())
        self.marks.update(zip(unseen, self._encode(unseen), strict=True))
        marks = self.marks
        now.update([(c, now[w] + marks[c[len(w) :]]) for c, w in marked])
        if len(self.marks) > 20_000:
            self.marks = {}

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Chunks are found, told apart and put together again by Arrow; Python looks at each distinct one once."""
        plans: list[list] = []  # of each text its specials (as texts) and pieces (as numbers)
        pieces: list[str] = []
        for text in texts:
            plan: list = []
            parts = [text or ""] if self.specials is None or not text or "<" not in text else self.specials.split(text)
            for k, part in enumerate(parts):
                if k % 2:
                    plan.append(part)
                elif part:
                    for piece in segments(part):
                        plan.append(len(pieces))
                        pieces.append(piece)
            plans.append(plan)
        found = self._pieces(pieces) if pieces else []
        return [b"".join(found[x] if isinstance(x, int) else self._encode([x])[0] for x in plan) for plan in plans]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        cut = pc.split_pattern(pa.array(pieces, pa.large_string()), " ")
        chunks = cut.flatten().dictionary_encode()
        starts = cut.offsets.to_numpy().astype(np.int64)  # of the pieces among the chunks
        starts = starts - starts[0]
        distinct = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        index = chunks.indices.to_numpy(zero_copy_only=False).copy()
        heads = [distinct[k] for k in index[starts[:-1]]]
        index[starts[:-1]] = len(distinct)  # heads are looked up by themselves, and bring nothing here
        self._learn(self.heads, set(heads), "")
        self._learn(self.tails, set(distinct), " ")
        head = self.heads.now
        ids = list(map(self.tails.now.__getitem__, distinct))
        unsafe = np.zeros(len(distinct) + 1, bool)
        lengths = np.zeros(len(distinct) + 1, np.int64)
        if None in ids:
            unsafe[[k for k, b in enumerate(ids) if b is None]] = True
            ids = [b or b"" for b in ids]
        lengths[:-1] = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
        held = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), self.kind)))
        flat = held.take(pa.array(index)).flatten().to_numpy()
        ends = np.r_[0, np.cumsum(lengths[index])][starts]
        whole = np.add.reduceat(unsafe[index], starts[:-1])
        out = []
        for k, piece in enumerate(pieces):
            first = heads[k]
            if whole[k] or (first and head[first] is None):
                out += self._encode([piece])
            else:
                rest = flat[ends[k] : ends[k + 1]].tobytes()
                out.append(head[first] + rest if first else rest)
        return out


_STATE: dict = {}


def _encoder(tokenizer_file: str) -> ByteIds:
    if _STATE.get("tokenizer_file") != tokenizer_file:
        _STATE.update(tokenizer_file=tokenizer_file, ids=ByteIds(tokenizer_file))
    return _STATE["ids"]


def shard_numbers(ids: list, ties: list, bounds: np.ndarray) -> np.ndarray:
    """Shards of documents: by the place of the id among the bounds; an id that equals several bounds goes to all shards
    between them, in the order of its ties.  No id counts as the least one."""
    key = np.array([_LEAST if i is None else i for i in ids], np.int64)
    low, high = np.searchsorted(bounds, key, "left"), np.searchsorted(bounds, key, "right")
    share = (np.array(ties, np.int64).astype(np.float64) + 2.0**63) / 2.0**64
    shard = np.minimum(low + np.floor(share * (high - low + 1)).astype(np.int64), high)
    least = np.array([i == _LEAST for i in ids], bool)  # a real id of that value stands behind those without one
    return np.where(least, high, shard)


def _encode(tokenizer_file: str, end_id: int, bounds: list[int]):
    edges = np.array(bounds, np.int64)

    def run(batches):
        encode = _encoder(tokenizer_file)
        end = np.array([end_id], encode.kind).tobytes()

        def done(ids, ties, texts):
            found = [b + end for b in encode(texts)]
            return pa.RecordBatch.from_arrays([pa.array(shard_numbers(ids, ties, edges), pa.int32()), pa.array(ids, pa.int64()), pa.array(ties, pa.int64()), pa.array(found, pa.binary())], ["shard", "id", "tie", "ids"])

        ids, ties, texts, size = [], [], [], 0
        for doc, tie, text in rows_of(batches):
            ids.append(doc)
            ties.append(tie)
            texts.append(text)
            size += len(text or "")
            if size >= BLOCK_CHARS:
                yield done(ids, ties, texts)
                ids, ties, texts, size = [], [], [], 0
        if ids:
            yield done(ids, ties, texts)

    return run


class _Shard:
    """The three files of a shard while it is written."""

    def __init__(self, store: fs.FileSystem, folder: str, shard: int, width: int):
        self.store, self.shard, self.width, self.mark = store, shard, width, uuid.uuid4().hex
        self.docs = self.nulls = self.tokens = 0
        self.names = [f"{folder}/{kind}-{shard:05d}.bin" for kind in ("ids", "off", "doc")]
        self.files = [store.open_output_stream(f"{n}.{self.mark}") for n in self.names]
        self.files[1].write(np.zeros(1, "<u8").tobytes())

    def put(self, ids: list, found: list[bytes]) -> None:
        ends = self.tokens + np.cumsum([len(b) // self.width for b in found])
        for f, data in zip(self.files, (b"".join(found), ends.astype("<u8").tobytes(), np.array([0 if i is None else i for i in ids], "<i8").tobytes()), strict=True):
            f.write(data)
        self.docs, self.nulls, self.tokens = self.docs + len(ids), self.nulls + ids.count(None), int(ends[-1])

    def close(self) -> pa.RecordBatch:
        for f, n in zip(self.files, self.names, strict=True):
            f.close()
            self.store.move(f"{n}.{self.mark}", n)
        return pa.RecordBatch.from_pydict({k: [getattr(self, k)] for k in ("shard", "docs", "nulls", "tokens", "width")})


def _write(path: str, width: int):
    """Files of the shards of a partition, whose rows come by shard and in order; a row of counts for each."""

    def run(batches):
        store, folder = fs.FileSystem.from_uri(path)
        open_: _Shard | None = None
        for batch in batches:
            shards = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if open_ is None or open_.shard != shards[a]:
                    if open_ is not None:
                        yield open_.close()
                    open_ = _Shard(store, folder, int(shards[a]), width)
                open_.put(batch.column(1).slice(a, b - a).to_pylist(), batch.column(2).slice(a, b - a).to_pylist())
        if open_ is not None:
            yield open_.close()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer_file: str, *, end_id: int = 0, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Write the files below ``path`` (a folder all executors share) and return the manifest's shards.

    Without ``shards`` there is one for each ``SHARD_BYTES`` of text, and one for each shuffle partition at least.
    """
    spark = docs.sparkSession
    long_rows(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if shards is None:
        held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // SHARD_BYTES))
    store, folder = fs.FileSystem.from_uri(path)
    store.create_dir(folder, recursive=True)
    # one bound for each shard but the first comes to the driver
    cuts = F.percentile_approx(F.coalesce("id", F.lit(_LEAST)), [k / shards for k in range(1, shards)], max(10_000, 20 * shards)) if shards > 1 else F.array().cast("array<long>")
    bounds = rows.agg(cuts.alias("bounds")).first()["bounds"] or []
    width = id_kind(load_tokenizer(tokenizer_file)).itemsize
    tie = F.when(F.coalesce("text", F.lit("")) == "", F.lit(_LEAST)).otherwise(F.xxhash64("text"))
    encoded = rows.select("id", tie.alias("tie"), "text").mapInArrow(_encode(tokenizer_file, end_id, bounds), "shard int, id long, tie long, ids binary")
    dealt = encoded.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("id").asc_nulls_first(), "tie", "ids")
    # one small row a shard comes back, never a document
    counts = dealt.select("shard", "id", "ids").mapInArrow(_write(path, width), "shard long, docs long, nulls long, tokens long, width long").collect()
    manifest, base = [], 0
    for row in sorted(counts, key=lambda r: r["shard"]):
        manifest.append(row.asDict() | {"base": base})
        base += row["tokens"]
    with store.open_output_stream(f"{folder}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def _mapped(store: fs.FileSystem, name: str, kind: str) -> np.ndarray:
    """The file as an array: mapped where it is local, else read."""
    if store.get_file_info(name).size == 0:
        return np.empty(0, kind)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(name, kind, mode="r")
    with store.open_input_file(name) as f:
        return np.frombuffer(f.read_buffer(), kind)


def _read(path: str, manifest: list[dict], most: int = 1_000_000):
    def run(batches):
        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                part = manifest[k]
                ids = _mapped(store, f"{folder}/ids-{part['shard']:05d}.bin", f"<u{part['width']}")
                off = _mapped(store, f"{folder}/off-{part['shard']:05d}.bin", "<u8").astype(np.int64)
                doc = _mapped(store, f"{folder}/doc-{part['shard']:05d}.bin", "<i8")
                at = 0
                while at < len(doc):  # documents of up to `most` tokens together, one document at least
                    to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
                    wide = np.asarray(ids[off[at] : off[to]], "<u4")
                    cuts = (off[at : to + 1] - off[at]).tolist()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(doc[at:to], pa.int64(), mask=np.arange(at, to) < part["nulls"]), pa.array(part["base"] + off[at:to], pa.int64()), pa.array(np.diff(off[at : to + 1]), pa.int64()),
                            pa.array([wide[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                        ], ["id", "start", "n_tokens", "ids"],
                    )
                    at = to

    return run


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document from the files: id_col, start, n_tokens, ids (binary, little-endian unsigned 32-bit)."""
    store, folder = fs.FileSystem.from_uri(path)
    with store.open_input_file(f"{folder}/manifest.json") as f:
        manifest = json.loads(f.read())
    shards = spark.range(0, len(manifest), 1, max(1, len(manifest)))
    return shards.mapInArrow(_read(path, manifest), "id long, start long, n_tokens long, ids binary").withColumnRenamed("id", id_col)
