import math
import random
import re

import numpy as np
import pytest

from tests.llm.helpers import components, no_documents, odd_documents, sentence
from tidemark.llm import embedding_dedup, minhash, regions
from tidemark.llm.components import connected_components


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words)} if len(words) < 5 else {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute_force(docs, percent):
    sets = {i: shingle_set(t) for i, t in docs.items()}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 100 * (n := len(sets[a] & sets[b])) >= percent * (len(sets[a]) + len(sets[b]) - n)]
    return sets, components(ids, links)


@pytest.mark.parametrize("percent", [80, 85])
def test_groups_equal_brute_force(spark, sf_dir, percent):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = {r.doc_id: r.text for r in table.collect()}
    sets, want = brute_force(docs, percent)
    got = {r.doc_id: r for r in minhash.near_duplicates(table, percent=percent).collect()}
    assert {i: (len(sets[i]), want[i], want[i] == i) for i in docs} == {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()}


def test_large_regions_are_split_and_the_rest_is_tested(spark):
    """A star: copies link with their base only; every region is above the limit."""
    rnd = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    docs = {0: " ".join(base)}
    for i in range(1, 60):
        words = list(base)
        for at in rnd.sample(range(120), 2):
            words[at] = f"x{i}_{at}"
        docs[i] = " ".join(words)
    docs |= {i: docs[3] for i in range(60, 70)} | {i: sentence(i, 80) for i in range(70, 80)}
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    _, want = brute_force(docs, 85)
    for limit in (minhash.LIMIT, 600):
        assert {r.doc_id: r.component_id for r in minhash.near_duplicates(table, percent=85, limit=limit).collect()} == want


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = minhash.near_duplicates(docs, percent=80).collect()
    assert len(rows) == docs.count()
    by = {(r.doc_id, r.n_shingles): r for r in rows if r.doc_id is not None}
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert by[3, 0].kept and by[4, 0].kept and by[5, 0].kept
    assert by[1, 56].component_id == 0 and by[2, 56].component_id == 0 and by[8, 1].component_id == 7 and by[6, 1].kept
    assert minhash.near_duplicates(no_documents(spark)).count() == 0


def test_join_components_tests_every_pair_between_components():
    rnd = random.Random(2)
    for _ in range(50):
        n = rnd.randint(2, 25)
        near = np.zeros((n, n), bool)
        for _ in range(rnd.randint(0, n)):
            a, b = rnd.randrange(n), rnd.randrange(n)
            near[a, b] = near[b, a] = True
        labels = np.array([rnd.randrange(n) for _ in range(n)])
        links = regions.join_components(np.arange(n), labels, lambda x, near=near: near[x])
        want = components(range(n), [(int(labels[a]), int(labels[b])) for a in range(n) for b in range(n) if near[a, b]])
        assert components(range(n), links) == want


def test_components_of_long_chains(spark):
    links = [(k, k + 1) for k in range(200)] + [(1000, 900), (900, 950)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == {k: 0 for k in range(201)} | {k: 900 for k in (900, 950, 1000)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def vectors_with_groups(seed=1):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((40, 32))
    rows = [*base, *[base[k // 5] + 0.12 * rng.standard_normal(32) for k in range(60)], *[2.5 * base[1]] * 4]
    return [(k, [float(x) for x in np.float32(v)]) for k, v in enumerate(rows)]


@pytest.mark.parametrize("limit", [4096, 7])
def test_vectors_equal_brute_force(spark, limit):
    rows = vectors_with_groups()
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    want = components(range(len(rows)), [(a, b) for a in range(len(rows)) for b in range(a) if near[a, b]])
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicate_vectors(table, limit=limit).collect()}
    assert got == {k: (int(near[k].sum()) - 1, want[k], want[k] == k) for k in range(len(rows))}


def test_isolated_pairs_near_the_threshold_meet(spark):
    """Pairs at cosine 0.900 to 0.93, each without other links: recall 0.99 and more."""
    rng = np.random.default_rng(11)
    rows, pairs = [], 600
    for k in range(pairs):
        a, b = rng.standard_normal((2, 128))
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        c = 0.9 + 1e-6 + 0.03 * k / pairs
        rows += [(2 * k, a.tolist()), (2 * k + 1, (c * a + math.sqrt(1 - c * c) * b / np.linalg.norm(b)).tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicate_vectors(table).collect()}
    met = [k for k in range(pairs) if got[2 * k + 1] == (1, 2 * k, False) and got[2 * k] == (1, 2 * k, True)]
    assert len(met) >= 0.99 * pairs


def test_unusable_vectors_link_with_nothing(spark):
    rows = [(0, None), (1, []), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [1.0, float("nan")]), (5, [1.0, float("inf")]), (6, [1.0, 2.0]), (6, [1.0, 2.0]), (7, [2.0, 4.0]), (8, [1.0, 2.0, 0.0]), (None, [1.0, 2.0]), (9, [1e300, 2e300]), (10, [1e-300, 2e-300])]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, node long, payload string")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicate_vectors(table).collect()), key=repr)
    alone = [(k, 0, k, True) for k in (0, 1, 2, 3, 4, 5, 8)]
    assert got == sorted([*alone, (6, 4, 6, True), (6, 4, 6, True), *[(k, 4, 6, False) for k in (7, 9, 10)], (None, 0, None, True)], key=repr)
    assert embedding_dedup.near_duplicate_vectors(table.limit(0)).count() == 0


def test_forest_keeps_rows_that_share_a_prefix(spark):
    """Sorted neighbours against counts of prefixes; rows kept beyond those are the ends of partitions, which the count of regions drops."""
    rng = np.random.default_rng(5)
    values = rng.integers(0, 3, (300, minhash.ORDERS * minhash.STEP)).astype(">u2")
    rows = [(k, 10, bytearray(v.tobytes())) for k, v in enumerate(values)]
    classes = spark.createDataFrame(rows, "node long, weight long, signature binary")
    for thin, depth in ((10**9, minhash.SHALLOW), (0, minhash.STEP)):
        got = {(r.t, r.node) for r in minhash.forest_regions(classes, thin).collect()}
        want = set()
        for t, path in enumerate(minhash._PATHS):
            prefixes = [v[path[:depth]].tobytes() for v in values]
            want |= {(t, k) for k, p in enumerate(prefixes) if prefixes.count(p) > 1}
        assert got == want and want


def test_orders_start_with_values_of_their_own():
    assert len(set(minhash._PATHS[:, : minhash.STEP].ravel().tolist())) == minhash.ORDERS * minhash.STEP
    assert all(len(set(p)) == minhash.DEPTH for p in minhash._PATHS.tolist())


def test_isolated_pairs_at_the_threshold_are_found(spark):
    """500 planted pairs of similarity 0.85 to 0.88, each without other links: none is lost."""
    rnd = random.Random(9)
    docs, pairs = {}, 0
    while pairs < 500:
        words = [f"w{rnd.randrange(10**6)}" for _ in range(130)]
        other = list(words)
        for at in rnd.sample(range(0, 130, 6), 2):
            other[at] = f"x{rnd.randrange(10**6)}"
        a, b = shingle_set(" ".join(words)), shingle_set(" ".join(other))
        if 85 * len(a | b) <= 100 * len(a & b) < 88 * len(a | b):
            docs[2 * pairs], docs[2 * pairs + 1] = " ".join(words), " ".join(other)
            pairs += 1
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), percent=85).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(pairs)) == pairs


def test_one_id_for_all_rows_fetches_each_text_once(spark):
    """Texts of one id meet only their own sets: as many sets are made as there are texts, and links are those of distinct ids."""
    texts = [f"group {k // 2} has words " + " ".join(f"w{k // 2}x{j}" for j in range(40)) + (" tail" if k % 2 else "") for k in range(300)]
    fetched = spark.sparkContext.accumulator(0)
    own = minhash._full_sets

    def counted(width):
        run = own(width)

        def count(batches):
            for batch in batches:
                fetched.add(batch.num_rows)
                yield from run(iter([batch]))

        return count

    schema = "doc_id long, text string"
    minhash._full_sets = counted
    try:
        got = minhash.near_duplicates(spark.createDataFrame([(5, t) for t in texts], schema), percent=80).collect()
    finally:
        minhash._full_sets = own
    assert len(got) == 300 and {r.component_id for r in got} == {5} and fetched.value == 300
