"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Method: the leaves of a segment tree hold, for each adjacent pair of symbols, its merge rank and
its position; the root is then the leftmost pair of lowest rank.  A merge changes three leaves
(the merged pair, the one before, the one that vanishes), each with one walk to the root; encoding
ends when no pair has a rank.  :func:`merge_word` is the tree for one word.  :class:`MergeTrees`
holds the trees of many words of like length as the rows of one array and walks them together.

The tokenizer file is of the kind "word ends": NFC, white space to spaces, lower case, a split
pattern that drops white space, bytes shown as characters, and a suffix on the last symbol of a
word.  Its library decoder is empty, so decoding joins the tokens with spaces.

Defined cases: a null or empty text has no ids and an empty decoded text; a null id is kept;
repeated rows each get their own result row; extra columns are ignored; texts of any length are
encoded whole, in segments cut at safe spaces; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import string
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import long_rows
from .words import Known, segments, specials_pattern

_BLANKS = regex.compile(r"\s+")
NONE = 1 << 62
_LOW = (1 << 32) - 1


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def merge_word(symbols: list[int], ranks: dict[int, int], merged: list[int]) -> list[int]:
    """Ids of one word; ranks maps (left << 32 | right) to a rank, merged gives each rank's id."""
    n = len(symbols)
    if n < 2:
        return symbols
    symbols = list(symbols)
    width = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [NONE] * (2 * width)

    def leaf(i: int, j: int) -> int:
        rank = ranks.get(symbols[i] << 32 | symbols[j])
        return NONE if rank is None else rank << 32 | i

    def put(i: int, value: int) -> None:
        k = width + i
        tree[k] = value
        while k > 1:
            k >>= 1
            least = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == least:
                break
            tree[k] = least

    for i in range(n - 1):
        tree[width + i] = leaf(i, i + 1)
    for k in range(width - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    while (root := tree[1]) < NONE:
        i = root & _LOW
        j = after[i]
        symbols[i], symbols[j] = merged[root >> 32], -1
        after[i] = nxt = after[j]
        if nxt >= 0:
            before[nxt] = i
            put(j, NONE)
        put(i, NONE if nxt < 0 else leaf(i, nxt))
        if (prev := before[i]) >= 0:
            put(prev, leaf(prev, i))
    return [s for s in symbols if s >= 0]


class MergeTrees:
    """Segment trees of many words, one row each, merged together in rounds."""

    def __init__(self, pairs: np.ndarray, merged: np.ndarray):
        """pairs: (left << 32 | right) by rank; merged: id by rank."""
        order = np.argsort(pairs)
        self.keys, self.rank_of, self.merged = pairs[order], order.astype(np.int64), merged.astype(np.int64)
        self.ranks = {int(k): r for r, k in enumerate(pairs)}
        self.merged_list = merged.tolist()

    def leaves(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[slot] == key) & (left >= 0) & (right >= 0), self.rank_of[slot] << 32 | at, NONE)

    def merge(self, symbols: np.ndarray) -> np.ndarray:
        """symbols: words x places, -1 behind each word's end; gives the ids with -1 in vanished places."""
        words, places = symbols.shape
        width = 1 << max(0, (places - 2).bit_length())
        symbols = np.concatenate([symbols, np.full((words, 2), -1, np.int64)], axis=1)  # place `places` stands for none
        none = places
        tree = np.full((words, 2 * width), NONE, np.int64)
        tree[:, width : width + places - 1] = self.leaves(symbols[:, : places - 1], symbols[:, 1:places], np.arange(places - 1, dtype=np.int64))
        for k in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        after = np.tile(np.minimum(np.arange(1, places + 3), none), (words, 1))
        before = np.tile(np.concatenate([[none], np.arange(places - 1), [none, none]]), (words, 1))

        def put(row: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            live = at < places - 1
            row, at = row[live], at[live] + width
            tree[row, at] = value[live] if isinstance(value, np.ndarray) else value
            step = width
            while step > 1:
                step >>= 1
                at = at >> 1
                tree[row, at] = np.minimum(tree[row, 2 * at], tree[row, 2 * at + 1])

        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            root = tree[rows, 1]
            i = root & _LOW
            j = after[rows, i]
            nxt = after[rows, j]
            symbols[rows, i] = self.merged[root >> 32]
            symbols[rows, j] = -1
            after[rows, i] = nxt
            before[rows, nxt] = i
            prev = before[rows, i]
            now = symbols[rows, i]
            put(rows, j, NONE)
            put(rows, i, self.leaves(now, symbols[rows, nxt], i))
            put(rows, prev, self.leaves(symbols[rows, prev], now, prev))
            rows = rows[tree[rows, 1] < NONE]
        return symbols[:, :places]


class WordEndBpe:
    """Encoder and decoder for one tokenizer file."""

    #: Places up to which words share an array of trees; longer ones get a tree each.
    SHARED = 64

    def __init__(self, path: str, cached: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = dict(model["vocab"])
        suffix = model["end_of_word_suffix"]
        chars = byte_characters()
        self.plain = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        self.trees = MergeTrees(pairs, np.array([vocab[a + b] for a, b in merges], np.int64))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (vocab | self.special).items()}
        self.specials = specials_pattern(path)
        pre = spec["pre_tokenizer"]["pretokenizers"][0]
        self.shown: dict[int, bytes] = {}
        self.split = regex.compile(pre["pattern"]["Regex"])
        self.chunks, self.words = Known(cached), Known(cached)

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word (not empty), as the merges give them."""
        raw = [w.encode() for w in words]
        size = np.array([len(b) for b in raw])
        out: list = [None] * len(raw)
        # place classes: 1, 2, 3, 5, 9, 17, 33, 65 - a tree of the next power of two
        top = np.where(size <= 2, size, (1 << np.ceil(np.log2(np.maximum(size - 1, 1))).astype(int)) + 1)
        for places in np.unique(top[size <= self.SHARED]):
            which = np.flatnonzero((top == places) & (size <= self.SHARED))
            for start in range(0, len(which), max(1, 1_000_000 // int(places))):
                part = which[start : start + max(1, 1_000_000 // int(places))]
                n = size[part]
                flat = np.frombuffer(b"".join([raw[k] for k in part]), np.uint8)
                inside = np.arange(places) < n[:, None]
                grid = np.full((len(part), int(places)), -1, np.int64)
                grid[inside] = self.plain[flat]
                grid[np.arange(len(part)), n - 1] = self.last[flat[np.cumsum(n) - 1]]
                done = self.trees.merge(grid) if places > 1 else grid
                keep = done >= 0
                ids = done[keep].astype("<u4")
                ends = np.cumsum(keep.sum(axis=1))
                for k, lo, hi in zip(part.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    out[k] = ids[lo:hi]
        for k in np.flatnonzero(size > self.SHARED):
            b = np.frombuffer(raw[k], np.uint8)
            first = [*self.plain[b[:-1]].tolist(), int(self.last[b[-1]])]
            out[k] = np.array(merge_word(first, self.trees.ranks, self.trees.merged_list), "<u4")
        return out

    def _words(self, chunk: str) -> list[str]:
        """The words of a chunk: most are letters, with marks behind them or not, and need no pattern."""
        low = chunk.lower()
        if low.isalpha():
            if chunk.isascii() or ("Σ" not in chunk and unicodedata.is_normalized("NFC", chunk)):
                return [low]
        elif chunk.isascii() and (word := low.rstrip(string.punctuation)).isalpha():
            return [word, low[len(word) :]]
        text = unicodedata.normalize("NFC", chunk)
        text = _BLANKS.sub(" ", text)
        text = text.replace("Σ", "σ").lower()  # lower case goes by character: no final sigma
        return self.split.findall(text)

    def _learn(self, chunks: set[str]) -> None:
        """Encode chunks that the cache lacks, their words together.  A chunk is kept as its ids and what they show, a space
        behind each token."""
        new = self.chunks.missing(chunks)
        split = list(map(self._words, new))
        unseen = self.words.missing({w for ws in split for w in ws})
        known = self.words.now
        if unseen:
            show = {i: t.encode() + b" " for i, t in self.tokens.items()} if not self.shown else self.shown
            self.shown = show
            ids = self.encode_words(unseen)
            flat = list(map(show.__getitem__, np.concatenate(ids).tolist()))
            ends = np.cumsum(list(map(len, ids))).tolist()
            known.update(zip(unseen, [(i.tobytes(), b"".join(flat[a:b])) for i, a, b in zip(ids, [0, *ends[:-1]], ends, strict=True)], strict=True))
        here = self.chunks.now
        for chunk, ws in zip(new, split, strict=True):
            if len(ws) == 1:
                here[chunk] = known[ws[0]]
            else:
                got = [known[w] for w in ws]
                here[chunk] = (b"".join([g[0] for g in got]), b"".join([g[1] for g in got]))

    def _pieces(self, pieces: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids and shown tokens of pieces: chunks are found, told apart and put together again by Arrow."""
        cut = pc.split_pattern(pa.array(pieces, pa.large_string()), " ")
        chunks = cut.flatten().dictionary_encode()
        starts = cut.offsets.to_numpy().astype(np.int64)
        starts = starts - starts[0]
        distinct = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn(set(distinct))
        found = list(map(self.chunks.now.__getitem__, distinct))
        index = chunks.indices
        parts = []
        for k in (0, 1):
            each = [f[k] for f in found]
            lengths = np.fromiter(map(len, each), np.int64, len(each))
            held = pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)]), pa.array(np.frombuffer(b"".join(each), np.uint8)))
            ends = np.r_[0, np.cumsum(lengths[index.to_numpy(zero_copy_only=False)])][starts].tolist()
            flat = held.take(index).flatten().to_numpy().tobytes()
            parts.append([flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])
        return list(zip(*parts, strict=True))

    def encode_decode(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each text."""
        plans: list[list] = []
        pieces: list[str] = []
        for text in texts:
            plan: list = []
            parts = [text or ""] if self.specials is None or not text or "<" not in text else self.specials.split(text)
            for k, part in enumerate(parts):
                if k % 2:
                    plan.append((self.special[part].to_bytes(4, "little"), part.encode() + b" "))
                elif part:
                    for piece in segments(part):
                        plan.append(len(pieces))
                        pieces.append(piece)
            plans.append(plan)
        found = self._pieces(pieces) if pieces else []
        out = []
        for plan in plans:
            done = [found[x] if isinstance(x, int) else x for x in plan]
            out.append((b"".join([d[0] for d in done]), b"".join([d[1] for d in done])[:-1].decode()))
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids, special tokens kept."""
        return " ".join([self.tokens[i] for i in ids])


_STATE: dict = {}
#: Characters of text handled together.
BLOCK_CHARS = 3_000_000


def _run(path: str):
    def run(batches):
        if _STATE.get("path") != path:
            _STATE.update(path=path, bpe=WordEndBpe(path))
        bpe: WordEndBpe = _STATE["bpe"]

        def done(ids, texts):
            got = bpe.encode_decode(texts)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(b) // 4 for b, _ in got], pa.int64()), pa.array([b for b, _ in got], pa.binary()), pa.array([s for _, s in got], pa.string())],
                ["id", "n_tokens", "ids", "decoded"],
            )

        for batch in batches:
            ids, texts, size = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc)
                texts.append(text)
                size += len(text or "")
                if size >= BLOCK_CHARS:
                    yield done(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield done(ids, texts)

    return run


def bpe_encode_decode(docs: DataFrame, tokenizer_file: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded (string)."""
    long_rows(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_run(tokenizer_file), "id long, n_tokens long, ids binary, decoded string")
    return out.withColumnRenamed("id", id_col)
