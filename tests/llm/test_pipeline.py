import collections

import public_tokenizers

import corpus_pipeline
from tests.llm.helpers import no_documents, odd_documents
from tests.llm.test_near_duplicates import brute_force
from tidemark.llm import words
from tidemark.llm.storage import stored


def test_stages_on_the_fixture(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "minhash", "mixing", "bpe"]
    before = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, sf_dir), f"test-{name}")
        if name != "bpe":
            assert out.columns == docs.columns and out.schema == docs.schema
            after = {r.doc_id for r in out.collect()}
            assert after <= before
            if name in ("quality", "toxicity"):
                clean = {i for i in before - after if i in labels and labels[i].quality == 1 and labels[i].toxic == 0}
                assert len(clean) <= 3  # very short or repetitive ones
            before = after
        else:
            library = words.load_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
            want = collections.Counter((r.doc_id, len(library.encode(r.text, add_special_tokens=False).ids)) for r in docs.collect())
            assert collections.Counter((r.doc_id, r.n_tokens) for r in out.collect()) == want
        docs = out


def test_near_copies_leave_one_document(spark, sf_dir):
    text = " ".join(f"word{k}" for k in range(100))
    rows = [(k, text if k % 2 else text + " tail", "en", "s", len(text)) for k in range(6)] + [(9, "other words stand here alone", "en", "s", 5), (None, text, "en", "s", 1), (9, "other words stand here alone", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.minhash_stage(spark, docs, sf_dir)
    assert sorted((r.doc_id for r in out.collect()), key=str) == [0, 9, None]


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark, sf_dir):
    """Id 5 has a copy of id 1's text and two texts of its own, one with a copy under a larger id; ids 7 hold two near-copies."""
    one, two, three, four = (" ".join(f"{name}{k}" for k in range(100)) for name in ("a", "b", "c", "d"))
    rows = [(1, one), (5, one + " tail"), (5, two), (8, two + " tail"), (5, three), (7, four), (7, four + " tail"), (None, three), (None, three + " tail"), (None, three + " tail"), (None, "own words of a row without an id"), (None, "own words of a row without an id")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text.split()[0]) for r in corpus_pipeline.minhash_stage(spark, docs, sf_dir).collect()]
    assert sorted(got, key=str) == sorted([(1, "a0"), (5, "b0"), (5, "c0"), (7, "d0"), (None, "c0"), (None, "own")], key=str)


def test_odd_rows_pass_every_stage(spark, sf_dir):
    for make in (odd_documents, no_documents):
        docs = make(spark)
        for name, stage in corpus_pipeline.STAGES:
            out = stored(stage(spark, docs, sf_dir), f"odd-{name}")
            if name != "bpe":
                assert out.columns == docs.columns
            out.count()
            docs = make(spark) if name == "quality" else docs


def test_rows_that_share_an_id_go_through_the_chain_by_their_own_texts(spark, sf_dir):
    """Stages in a row, each on what the one before kept: one id with two clean texts and a junk text, near copies, and a row without an id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clean = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.quality == 1 and r.toxic == 0}
    texts = {r.doc_id: r.text for r in docs.collect()}
    _, group = brute_force(texts, 80)
    size = collections.Counter(group.values())
    lang = {r.doc_id: r.lang for r in docs.collect()}
    a, b = [i for i in sorted(texts) if i in clean and size[group[i]] == 1 and lang[i] == "en" and 100 < len(texts[i].split()) < 1000][:2]
    tail = " ".join(texts[a].split()[:3])
    rows = [(7000, texts[a]), (7000, texts[b]), (7000, "too short"), (7001, texts[a] + " " + tail), (None, texts[b]), (7002, "Scum### scum$$$ " * 40), (7003, None), (7003, "")]
    more = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], docs.schema)
    kept = docs.where(~docs.doc_id.isin(a, b)).unionByName(more)
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stored(stage(spark, kept, sf_dir), f"chain-{name}")
    special = sorted(((r.doc_id, r.text) for r in kept.where("doc_id >= 7000 or doc_id is null").collect()), key=repr)
    assert special == sorted([(7000, texts[a]), (7000, texts[b]), (None, texts[b])], key=repr)
    mixed = stored(corpus_pipeline.mixing_stage(spark, kept, sf_dir), "chain-mixing")
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in kept.collect()}
