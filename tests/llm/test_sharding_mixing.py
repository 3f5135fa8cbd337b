import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import no_documents, odd_documents
from tidemark.llm import mixing, queries, sharding


def test_shards_are_gapless_and_growth_moves_rows_only_into_the_new_shard(spark, sf_dir):
    rows = queries.op2_sharding(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
        assert r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.law == "key"
    assert len(rows) == len(texts) and all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(8))


def test_tree_descends_by_weights(spark):
    tree = {"a": {"k": {0: 3.0, 1: 1.0}}, "b": {"k": {2: 4.0}}}
    heavier = {"a": {"k": {0: 3.0, 1: 3.0}}, "b": {"k": {2: 4.0}}}
    key = F.col("id").cast("string")
    rows = spark.range(20_000).select(sharding.shard_of(key, tree).alias("s"), sharding.shard_of(key, heavier).alias("t")).collect()
    share = Counter(r.s for r in rows)
    assert all(abs(share[s] / 20_000 - w / 8) < 0.02 for s, w in ((0, 3), (1, 1), (2, 4)))
    assert all(not (r.s == 1 and r.t == 2) and not (r.s == 0 and r.t == 2) for r in rows)  # nothing leaves the subtree that gained weight


def test_sharding_on_odd_rows(spark):
    docs = odd_documents(spark)
    rows = sharding.assign_shards(docs, sharding.shard_tree(3)).collect()
    assert len(rows) == docs.count() and all(r.grown_shard is None for r in rows)
    assert {r.size for r in rows if r.text_crc32 == 0} == {1}
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign_shards(no_documents(spark), sharding.shard_tree(8)).count() == 0


def test_copies_unfold_in_runs(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 3)
    same = spark.range(10).select(F.lit(5).alias("doc_id"), F.lit("same").alias("text"))
    assert sorted(r.slot for r in sharding.assign_shards(same, sharding.shard_tree(8)).collect()) == list(range(10))


def water_filled(sizes: dict, most=3.0):
    """Targets by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, full = float(sum(sizes.values())), {}
    while True:
        left, w = total - sum(full.values()), sum(weight[s] for s in sizes if s not in full)
        over = [s for s in sizes if s not in full and left * weight[s] / w > most * sizes[s] + 1e-9]
        if not over:
            return full | {s: left * weight[s] / w for s in sizes if s not in full}
        full |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 1000, "b": 10, "c": 1, "d": 5000}, {"a": 1, "b": 2, None: 900, "c": 3}, {"x": 7}, {"a": 100, "b": 100, "c": 100}])
def test_targets_equal_repeated_resharing(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    want = water_filled(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], rel_tol=1e-9) for s in want)


def test_index_maps_are_permutations(spark):
    for n in (1, 2, 7, 1000, 4096):
        got = [r.p for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(12345).cast("long")).alias("p")).collect()]
        assert sorted(got) == list(range(n))


def test_mix_meets_targets_and_limits(spark, sf_dir):
    rows = queries.op8_mixing(spark, sf_dir).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for i, d in docs.items()}
    sizes = Counter()
    for i, d in docs.items():
        sizes[d.source] += size[i]
    want, taken = water_filled(sizes), Counter()
    for r in rows:
        source = docs[r.doc_id].source
        assert r.size == size[r.doc_id] and r.source_size == sizes[source] and math.isclose(r.target, want[source], rel_tol=1e-9) and 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
    assert len(rows) == len(docs) and all(abs(taken[s] - want[s]) <= 2 * mixing.BLOCK for s in want)
    assert sorted(rows) == sorted(queries.op8_mixing(spark, sf_dir).collect())


def test_mix_on_odd_rows(spark):
    docs = odd_documents(spark)
    rows = mixing.taken_words(*mixing.mix(docs, block=8))
    assert rows.count() == docs.count()
    assert {r.taken for r in rows.where("size = 0").collect()} == {0}
    assert mixing.taken_words(*mixing.mix(no_documents(spark))).count() == 0


def test_slots_are_dealt_to_shards_without_gaps(spark):
    sized = spark.createDataFrame([("a", 5000), ("b", 300), (None, 70)], "source string, size long")
    slots = mixing.drawn_slots(mixing.source_targets(sized), block=16, shard_slots=50).collect()
    assert sorted((s.out_shard * 50 + s.position) for s in slots) == list(range(len(slots)))
    per = mixing.shard_counts(spark.createDataFrame(slots)).collect()
    assert sum(r.slots for r in per) == len(slots) and len({r.out_shard for r in per}) == -(-len(slots) // 50)
    used = Counter((s.source, s.block) for s in slots)
    assert max(used.values()) <= 3


def test_mixed_documents_hold_the_taken_words(spark):
    docs = odd_documents(spark)
    taken = Counter()
    for r in mixing.taken_words(*mixing.mix(docs, block=8)).collect():
        taken[r.doc_id] += r.taken
    out = mixing.mixed_documents(docs, block=8)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert words == Counter({k: v for k, v in taken.items() if v})


def plain_shard(key, tree):
    """The hash tree in plain Python: least -ln(u) / weight at each level, u from the md5 of node and key."""

    def weight(below):
        return sum(map(weight, below.values())) if isinstance(below, dict) else below

    node, below = "", tree
    while isinstance(below, dict):
        live = {name: child for name, child in below.items() if weight(child) > 0}
        draws = {name: -math.log((int(hashlib.md5(f"{node}/{name}|{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / weight(child) for name, child in live.items()}
        chosen = min(draws, key=draws.get) if len(live) > 1 else next(iter(live))
        below, node = live[chosen], f"{node}/{chosen}" if node else str(chosen)
    return chosen


def test_shards_equal_a_plain_hash_tree(spark, sf_dir):
    eight, nine = sharding.shard_tree(8), sharding.shard_tree(9)
    for r in queries.op2_sharding(spark, sf_dir).collect():
        assert (r.shard, r.grown_shard) == (plain_shard(str(r.doc_id), eight), plain_shard(str(r.doc_id), nine))


def test_drained_shards_take_nothing(spark):
    tree = {"a": {"k": {0: 1.0, 1: 0.0}, "l": {2: 0.0}}, "b": {"k": {3: 0.0}}, "c": {"k": {4: 2.0}}}
    got = [(r.id, r.s) for r in spark.range(500).select("id", sharding.shard_of(F.col("id").cast("string"), tree).alias("s")).collect()]
    assert {s for _, s in got} == {0, 4} and all(s == plain_shard(str(i), tree) for i, s in got)
    with pytest.raises(ValueError, match="weight"):
        sharding.shard_of(F.col("id"), {"a": {"k": {0: 0.0}}})


@pytest.mark.parametrize("sizes", [(5, 2, 1), (1, 1), (30, 1)])
@pytest.mark.parametrize("slots", [20_000, 65_536, 65_544, 100_003, 300_000])
def test_source_counts_of_shards_vary_as_drawn_ones(spark, sizes, slots):
    """Counts of 200-slot shards: mean and variance of draws without replacement, and no trend from shard to shard."""
    shard, edges = 200, np.cumsum([0, *(slots * w // sum(sizes) for w in sizes[:-1])]).tolist() + [slots]
    place = mixing.permuted(F.col("id"), F.lit(slots).cast("long"), F.xxhash64(F.lit(7)))
    rows = spark.range(slots).select("id", place.alias("place")).toPandas()
    assert len(set(rows.place)) == slots and rows.place.min() == 0 and rows.place.max() == slots - 1
    whole = slots // shard
    for lo, hi in zip(edges[:-1], edges[1:]):
        mine = rows[(rows.id >= lo) & (rows.id < hi)].place // shard
        counts = np.bincount(mine, minlength=whole + 1)[:whole]
        p = (hi - lo) / slots
        wanted = shard * p * (1 - p) * (slots - shard) / (slots - 1)
        assert abs(counts.mean() - shard * p) < 0.5
        assert 0.65 < counts.var() / wanted < 1.45
        assert abs(np.corrcoef(counts[1:], counts[:-1])[0, 1]) < 0.35


def test_permutations_hold_beyond_32_bits(spark):
    n = 3_000_000_000_019
    got = [r.p for r in spark.range(2000).select(mixing.permuted(F.col("id") + 2_999_999_990_000, F.lit(n), F.lit(3).cast("long")).alias("p")).collect()]
    assert len(set(got)) == 2000 and 0 <= min(got) and max(got) < n
    assert np.std(got) / n == pytest.approx(12**-0.5, rel=0.05)


def test_documents_know_their_shards(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for r in mixing.taken_words(*mixing.mix(docs, shard_slots=16)).collect():
        assert (r.first_shard is None) == (r.taken == 0) and (r.taken == 0 or 0 <= r.first_shard <= r.last_shard)


def test_rows_that_share_id_and_text_come_back_as_they_are(spark):
    """Equal id and text under other sources and languages: every row keeps its own columns, in every round."""
    text = " ".join(f"w{k}" for k in range(400))
    rows = [(1, text, "en", "s1", {"k": "a"}), (1, text, "de", "s2", None), (1, text, None, "s3", {"k": "b"}), (1, text, "en", "s1", {"k": "a"}), (None, text, "fr", None, None), (2, None, "en", "s1", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, extra map<string,string>")
    out = mixing.mixed_documents(docs).collect()
    assert {(r.doc_id, r.lang, r.source, str(r.extra)) for r in out} == {(r[0], r[2], r[3], str(r[4])) for r in rows[:5]}
    words = {}
    for r in out:
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    targets, pieces, slots = mixing.mix(docs)
    for t in targets.collect():
        assert abs(words.get(t.source, 0) - t.target) <= 2


def test_small_sources_come_near_their_targets(spark):
    rows = [(k, " ".join(f"x{k}" for k in range(100)), s) for k, s in enumerate("abc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.target, r.taken) for r in mixing.taken_words(*mixing.mix(docs)).collect()}
    assert got == {0: (187.5, 188), 1: (75.0, 75), 2: (37.5, 38)}
