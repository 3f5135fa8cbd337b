import collections
import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tests.llm.helpers import no_documents, odd_documents
from tidemark.llm import bpe, queries, token_counts, token_files, words
from tidemark.llm.storage import new_path

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = list("abzAZ 09'’éÉñ\n\t.,!<|>_Σσς́ ½२日😀ı") + ["<|endoftext|>", "<|startoftext|>", "'s", "  ", "b. "]


def random_texts(n=1500, seed=3):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def test_pretokens_rebuild_texts_and_count_like_the_library():
    split, library = words.PreTokens(BYTE), words.load_tokenizer(BYTE)
    for text in random_texts():
        found = split(text)
        assert "".join(found) == text
        assert sum(len(library.encode(p, add_special_tokens=False)) for p in found) == len(library.encode(text, add_special_tokens=False))


def test_byte_ids_equal_the_library():
    encode, library = token_files.ByteIds(BYTE, cached=50), words.load_tokenizer(BYTE)
    texts = [*random_texts(), None, "", "word, word. word!! word"]
    for text, ids in zip(texts, encode(texts), strict=True):
        assert ids == np.array(library.encode(text or "", add_special_tokens=False).ids, "<u2").tobytes()


def test_segment_trees_equal_the_library():
    mine, library = bpe.WordEndBpe(WORD, cached=50), words.load_tokenizer(WORD)
    texts = [*random_texts(), None, "", "a" * 700, "ΑΣ ΣΑΣ"]
    for text, (ids, decoded) in zip(texts, mine.encode_decode(texts), strict=True):
        expected = library.encode(text or "", add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == expected
        assert decoded == library.decode(expected, skip_special_tokens=False) == mine.decode(expected)


def test_single_tree_and_many_trees_agree():
    mine = bpe.WordEndBpe(WORD)
    for word, ids in zip(bpe_words := ["hello", "internationalization", "x", "zz", "teststringteststring"], mine.encode_words(bpe_words), strict=True):
        raw = word.encode()
        first = [*mine.plain[list(raw[:-1])].tolist(), int(mine.last[raw[-1]])]
        assert bpe.merge_word(first, mine.trees.ranks, mine.trees.merged_list) == ids.tolist()


def test_long_texts_are_cut_at_safe_spaces_only():
    text = ("word " * 50 + "\n\n  x ") * 9000
    assert "".join(words.segments(text)) == text
    split = words.PreTokens(BYTE)
    assert split(text) == split.pattern.findall(text)


@pytest.mark.parametrize("make", [odd_documents, no_documents])
def test_counts_on_odd_rows(spark, make):
    docs, library = make(spark), words.load_tokenizer(BYTE)
    got = sorted(token_counts.token_counts(docs, BYTE).collect(), key=repr)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    want = sorted(((i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False)), n > 512) for i, t in rows), key=repr)
    assert sorted(map(tuple, got), key=repr) == want


@pytest.mark.parametrize("make", [odd_documents, no_documents])
def test_bpe_on_odd_rows(spark, make):
    docs, library = make(spark), words.load_tokenizer(WORD)
    got = sorted(((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in bpe.bpe_encode_decode(docs, WORD).collect()), key=repr)
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), struct.pack(f"<{len(ids)}I", *ids), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("make", [odd_documents, no_documents])
def test_token_files_round_trip(spark, make):
    docs, library = make(spark), words.load_tokenizer(BYTE)
    path = new_path(spark, "test-token-files")
    manifest = token_files.write_token_files(docs, path, BYTE, end_id=0, shards=3)
    assert [m["base"] for m in manifest] == [sum(m["tokens"] for m in manifest[:k]) for k in range(len(manifest))]
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start = 0
    assert len(got) == len(rows)
    for g, (doc, text) in zip(got, rows, strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        assert (g.doc_id, g.start, g.n_tokens) == (doc, start, len(ids))
        assert bytes(g.ids) == struct.pack(f"<{len(ids)}I", *ids)
        start += len(ids)


def test_queries_give_the_library_results(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    byte, word = words.load_tokenizer(BYTE), words.load_tokenizer(WORD)
    counts = {r.doc_id: r.n_tokens for r in queries.op1_token_counts(spark, sf_dir).collect()}
    assert counts == {i: len(byte.encode(t, add_special_tokens=False)) for i, t in docs.items()}
    start = 0
    files = {r.doc_id: r for r in queries.op7_token_files(spark, sf_dir).collect()}
    for doc in sorted(docs):
        ids = np.array([*byte.encode(docs[doc], add_special_tokens=False).ids, 0], "<u4")
        assert (files[doc].start, files[doc].n_tokens, files[doc].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    for r in queries.op3_bpe(spark, sf_dir).collect():
        ids = word.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(word.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_shards_keep_the_order_of_ids_and_split_hot_ones():
    rnd = random.Random(8)
    ids = [None] * 40 + [7] * 60 + [-(1 << 63)] * 3 + [rnd.randrange(100) for _ in range(100)]
    rows = sorted(((i, rnd.randrange(-(1 << 63), 1 << 63)) for i in ids), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    least = -(1 << 63)
    keys = [least if i is None else i for i, _ in rows]
    bounds = np.array([keys[len(keys) * k // 12] for k in range(1, 12)])
    shards = token_files.shard_numbers([i for i, _ in rows], [t for _, t in rows], bounds)
    assert (np.diff(shards) >= 0).all()  # sorted rows stay sorted over the shards
    assert len(set(shards[:40])) > 1 and len({s for s, (i, _) in zip(shards, rows, strict=True) if i == 7}) > 1


def test_counts_are_kept_in_generations(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    want = sorted(token_counts.token_counts(docs, BYTE).collect())
    postings = [b for b in token_counts._postings(BYTE, 2)(iter([pa_rows(docs)]))]
    monkeypatch.setattr(token_counts, "KNOWN", 50)
    sums = list(token_counts._sum_pieces(BYTE)(iter(postings)))
    got = [r for b in token_counts._documents(iter(sums[::-1] if sums[0].column("bucket")[0].as_py() < 0 else sums)) for r in b.to_pylist()]
    assert sorted((r["id"], r["n_bytes"], r["n_tokens"]) for r in got) == [(r.doc_id, r.n_bytes, r.n_tokens) for r in want]


def pa_rows(docs):
    rows = docs.select("doc_id", "text").toArrow().combine_chunks()
    return pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), rows.column(0).combine_chunks(), rows.column(1).combine_chunks()], ["row_key", "id", "text"])


def test_frequencies_of_a_block_are_those_of_its_texts():
    """Special strings, heads, white space at cuts, empty texts and repeats: as counting the splits of each text."""
    split = words.PreTokens(BYTE)
    texts = ["the the cat's  cat <|endoftext|> the", None, "", "  a", "a  b", " x\n\ny it's", "<|endoftext|>", "\n", "a\n b", "the the", "日本 語 é é ü1 1é", "tab\t x  y"]
    named, codes, places, freqs = split.frequencies(texts)
    got = [collections.Counter() for _ in texts]
    for code, place, n in zip(codes.tolist(), places.tolist(), freqs.tolist(), strict=True):
        got[place][named[code].as_py()] += n
    assert got == [collections.Counter(split(t)) if t else collections.Counter() for t in texts]
    assert len(set(named.to_pylist())) == len(named)
    assert [len(x) for x in split.frequencies([])] == [0, 0, 0, 0] and [len(x) for x in split.frequencies([None, ""])] == [0, 0, 0, 0]


def test_pieces_of_many_pre_tokens_in_a_call():
    library = words.load_tokenizer(BYTE)
    some = [" the", " cat's", "the", " ", "  ", " 12", " !!", " é", "<|endoftext|>", "\n", " x" * 1, " " + "z" * 300]
    assert dict(token_counts.PieceCounts(BYTE)(some)) == {w: len(library.encode(w, add_special_tokens=False).ids) for w in some}
