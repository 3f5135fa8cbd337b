"""Words, pre-tokens and chunk caches shared by the text operators.

A *chunk* is what stands between two single spaces.  The byte-level pattern never lets a
pre-token start before a space and end after it, and it has no look-behind, so a text may be cut
before every space whose neighbours are not white space without changing the pre-tokens.  Chunks
repeat far more often than texts, so whatever is derived from a chunk is cached (bounded).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

# Fixed value: the published pre-tokenization pattern of byte-level BPE vocabularies.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters after which a long text is cut at the next safe space, so that lists stay small.
SEGMENT = 1 << 20
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


def rows_of(batches: Iterator[pa.RecordBatch], step: int = 256) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples; only ``step`` of them are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, step).columns), strict=True)


class Chunks(dict):
    """Bounded cache chunk -> ``derive(chunk)``; a chunk with white space at an end maps to None (cut unsafe).

    The cache is emptied when it is full: it holds no result, only saves work.
    """

    def __init__(self, derive: Callable[[str], object], limit: int = 100_000):
        super().__init__()
        self.derive, self.limit = derive, limit

    def __missing__(self, chunk: str):
        if len(self) >= self.limit:
            self.clear()
        value = None if not chunk or chunk[0].isspace() or chunk[-1].isspace() else self.derive(chunk)
        self[chunk] = value
        return value


class Known:
    """Bounded cache of two generations: what is in use moves on, the rest goes when the newer one is full."""

    def __init__(self, limit: int):
        self.limit, self.now, self.old = limit, {}, {}

    def missing(self, wanted: set[str]) -> list[str]:
        """Those of ``wanted`` that must be derived; all others are in ``now`` afterwards."""
        if len(self.now) > self.limit:
            self.old, self.now = self.now, {}
        lacking = wanted.difference(self.now)
        again = self.old.keys() & lacking
        for key in again:
            self.now[key] = self.old[key]
        return list(lacking - again)


def segments(text: str) -> Iterator[str]:
    """Pieces of a long text, cut before safe spaces only; concatenated they give the text."""
    start = 0
    while len(text) - start > SEGMENT:
        cut = _SAFE_CUT.search(text, start + SEGMENT)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def specials_pattern(tokenizer_file: str) -> re.Pattern | None:
    """Matches the added tokens of a tokenizer file, which the library finds before anything else."""
    with open(tokenizer_file, encoding="utf-8") as f:
        added = [t["content"] for t in json.load(f).get("added_tokens", [])]
    return re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None


def load_tokenizer(path: str) -> Tokenizer:
    """The library's tokenizer without truncation and padding."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class PreTokens:
    """Pre-tokens of whole texts as the byte-level pattern gives them, special strings split off first."""

    def __init__(self, tokenizer_file: str):
        self.pattern = regex.compile(BYTE_LEVEL)
        self.specials = specials_pattern(tokenizer_file)
        find = self.pattern.findall
        self.head = Chunks(lambda c: tuple(find(c)), 20_000)
        self.tail = Chunks(lambda c: (" " + c,) if c.isalpha() else tuple(find(" " + c)), 200_000)  # letters alone are one

    def __call__(self, text: str) -> list[str]:
        out: list[str] = []
        parts = [text] if self.specials is None or "<" not in text else self.specials.split(text)
        for k, part in enumerate(parts):
            if k % 2:
                out.append(part)
            elif part:
                for piece in segments(part):
                    self._plain(piece, out)
        return out

    def _plain(self, piece: str, out: list[str]) -> None:
        chunks = piece.split(" ")
        if chunks[0]:
            found = [self.head[chunks[0]]]
            rest = chunks[1:]
        else:  # a piece that begins with its space
            found, rest = [], chunks[1:]
        found += map(self.tail.__getitem__, rest)
        if None in found:
            out += self.pattern.findall(piece)
        else:
            for group in found:
                out += group

    def frequencies(self, texts: list[str | None]) -> tuple[pa.StringArray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pre-tokens of some texts, and (code, text, frequency) of each that a text has, by code and text.

        Arrow finds the chunks and tells them apart; Python looks at each distinct one once.
        """
        pieces: list[str] = []
        owners: list[int] = []
        loose: list[str] = []  # pre-tokens that come by themselves: specials, heads, those of pieces that can't be cut
        loose_of: list[int] = []

        def put(text: int, found: Iterable[str]) -> None:
            before = len(loose)
            loose.extend(found)
            loose_of.extend([text] * (len(loose) - before))

        for k, text in enumerate(texts):
            parts = [text or ""] if self.specials is None or not text or "<" not in text else self.specials.split(text)
            for j, part in enumerate(parts):
                if j % 2:
                    put(k, (part,))
                elif part:
                    for piece in segments(part):
                        pieces.append(piece)
                        owners.append(k)
        flat: list[str] = []
        codes = of_text = times = np.empty(0, np.int64)
        if pieces:
            cut = pc.split_pattern(pa.array(pieces, pa.large_string()), " ")
            chunks = cut.flatten().dictionary_encode()
            starts = cut.offsets.to_numpy().astype(np.int64)
            starts = starts - starts[0]
            distinct = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
            index = chunks.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            first = index[starts[:-1]]
            found = list(map(self.tail.__getitem__, distinct))
            bad = np.array([f is None for f in found])
            in_piece = np.repeat(np.arange(len(pieces)), np.diff(starts))
            counted = np.ones(len(index), bool)
            counted[starts[:-1]] = False
            whole = np.bincount(in_piece, bad[index] & counted, len(pieces)) > 0
            for k, chunk in enumerate(first.tolist()):
                head = self.head[distinct[chunk]] if distinct[chunk] else ()
                if head is None or whole[k]:
                    whole[k] = True
                    put(owners[k], self.pattern.findall(pieces[k]))
                else:
                    put(owners[k], head)
            counted &= ~whole[in_piece]
            width = len(distinct)
            pairs, often = np.unique(np.array(owners)[in_piece[counted]] * width + index[counted], return_counts=True)
            sizes = np.array([len(f) if f else 0 for f in found])
            flat = [p for f in found if f for p in f]
            begins = np.cumsum(sizes) - sizes
            chunk = pairs % width
            reach = sizes[chunk]
            codes = np.repeat(begins[chunk], reach) + np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
            of_text, times = np.repeat(pairs // width, reach), np.repeat(often, reach)
        coded = pa.array(flat + loose, pa.string()).dictionary_encode()
        named = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        key = np.concatenate([named[codes], named[len(flat) :]]) * len(texts) + np.concatenate([of_text, np.array(loose_of, np.int64)])
        pairs, place = np.unique(key, return_inverse=True)
        freq = np.bincount(place, np.concatenate([times, np.ones(len(loose), np.int64)]), len(pairs)).astype(np.int64)
        # pre-tokens of chunks that only pieces without a cut hold are in no text
        used, code = np.unique(pairs // max(1, len(texts)), return_inverse=True)
        return coded.dictionary.take(pa.array(used)), code, pairs % max(1, len(texts)), freq
