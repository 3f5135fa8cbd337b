"""The filter audit, line dedup and importance resampling against plain Python over odd rows and hot groups."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from tests.llm.helpers import no_documents, odd_documents
from tidemark.llm import filter_audit, importance, line_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    """Documents (id, text, lang) with a column that clashes with inner names."""
    return spark.createDataFrame([(i, t, p, "x", 1) for i, t, p in rows], "doc_id long, text string, lang string, h string, first long")


def audit_labels(spark):
    rows = [(0, 1, 0), (1, 0, 1), (1, 1, 0), (2, None, 1), (None, 1, 1), (9, 1, 1), (99, 1, 1), (11, 1, None)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, quality int, toxic int, id string")


def audit_by_hand(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    docs = []
    for i, t, part in rows:
        t = t or ""
        words = WORD.findall(t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i}
        docs.append((part or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        shapley = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                removed = [d for d in left if f in d[1]]
                redundant = sum(f in d[1] for d in gone)
                left = [d for d in left if f not in d[1]]
                gone += removed
                shapley[f] += len(removed)
                unique = sum(d[0] == part and d[1] == {f} for d in docs)
                out[part, "".join(order), step] = [len(left), len(removed), redundant, unique, sum(d[2] for d in removed), sum(d[3] for d in removed), f]
        for (p, _, _), v in out.items():
            if p == part:
                v.append(shapley[v[6]])
    return {k: tuple(v) for k, v in out.items()}


def audit(spark, docs):
    found = filter_audit.filter_audit(docs, audit_labels(spark)).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r["filter"], r.shapley) for r in found}
    assert len(got) == len(found)
    return got


def test_audit_equals_a_replay_by_hand(spark):
    docs = odd_documents(spark)
    more = [(20 + k, " ".join(f"Word{(k * j) % 90}" for j in range(101 + k)) + ("#" if k % 3 else ""), None) for k in range(8)]
    hot = [(100 + k, "one hot text", "en") for k in range(300)] + [(7, "ONE hot", "hot")] * 3 + [(6, "ONE hot", "")]
    both = table(spark, [(r.doc_id, r.text, r.lang) for r in docs.collect()] + more + hot)
    rows = [(r.doc_id, r.text, r.lang) for r in both.collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in audit_labels(spark).collect()]
    assert audit(spark, both) == audit_by_hand(rows, labels)


def test_audit_of_nothing_and_of_more_filters(spark):
    assert filter_audit.filter_audit(no_documents(spark), audit_labels(spark)).count() == 0
    flags = spark.createDataFrame([("p", 5, True, False), ("p", 0, False, True)], "part string, fails int, good boolean, toxic boolean")
    three = filter_audit.replayed(flags, ["x", "y", "z"]).where("filter_order = 'zyx'").orderBy("step").collect()
    assert [(r.kept, r.removed, r.redundant) for r in three] == [(1, 1, 0), (1, 0, 0), (1, 0, 1)]
    with pytest.raises(ValueError, match="too many"):
        filter_audit.replayed(flags, list("abcdefgh"))


def lines_by_hand(rows, min_docs, min_chars):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))

    texts = [(i, (t or "").split("\n")) for i, t in rows]
    docs = collections.Counter(k for _, lines in texts for k in {key(x) for x in lines})
    out = []
    for i, lines in texts:
        left = [x for x in lines if len(key(x)) < min_chars or docs[key(x)] < min_docs]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=repr)


def removed(docs, **options):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.lines_removed(docs, **options).collect()), key=repr)


def test_lines_equal_a_count_by_hand(spark):
    random.seed(5)
    lines = ["Alpha line", " alpha LINE\t", "", "  ", "É ligne", "é ligne", "rare %d", "x", "Hot line", "hot line \r"]
    rows = [(k, "\n".join((random.choice(lines).replace("%d", str(k)) for _ in range(random.randint(1, 12)))), "en") for k in range(120)]
    rows += [(r.doc_id, r.text, r.lang) for r in odd_documents(spark).collect()] + [(500, "\n\n\n", "en"), (501, "a\n" * 50 + "b", "en"), (None, "Hot line\nown", "en"), (502, "Hot line\nown", "en"), (502, "Hot line\nother", "en")]
    rows += [(600, "copied row\nwith Hot line", "en")] * 40
    docs = table(spark, rows)
    for min_docs, min_chars in ((10, 1), (2, 1), (10, 0), (3, 6), (1, 1), (10**6, 1)):
        assert removed(docs, min_docs=min_docs, min_chars=min_chars) == lines_by_hand([r[:2] for r in rows], min_docs, min_chars)


def test_lines_that_are_not_hot_are_joined(spark, monkeypatch):
    rows = [(k, "shared by all\nshared by some %d\nown %d" % (k % 3, k), "en") for k in range(60)]
    for hot in (1, 3, 10_000):
        monkeypatch.setattr(line_dedup, "HOT", hot)
        assert removed(table(spark, rows)) == lines_by_hand([r[:2] for r in rows], 10, 1)


def test_lines_of_nothing_and_of_a_long_text(spark):
    assert removed(no_documents(spark)) == []
    long = "\n".join(f"line {k % 50_000}" for k in range(200_000))
    rows = [(1, long, "en"), (2, "line 7\nline x", "en")]
    assert removed(table(spark, rows), min_docs=2) == lines_by_hand([r[:2] for r in rows], 2, 1)


TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_by_hand(text):
    return TOKEN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features_by_hand(text, longest, buckets):
    words = words_by_hand(text)
    return [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def importance_by_hand(rows, target, longest=2, buckets=10_000, percent=25, min_words=20, seed=7):
    s, t = collections.Counter(), collections.Counter()
    for _, text in rows:
        s.update(features_by_hand(text, longest, buckets))
    for text in target:
        t.update(features_by_hand(text, longest, buckets))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        found = features_by_hand(text, longest, buckets)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words_by_hand(text)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    entered = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = collections.defaultdict(list)
    for rank, r in enumerate(entered, 1):
        ranks[tuple(r)].append(rank if rank <= percent * len(entered) // 100 else None)
    return sorted(((*r, ranks[tuple(r)].pop() if ranks[tuple(r)] else None) for r in out), key=repr)


def scores(docs, target, **options):
    found = importance.importance_scores(docs, target, **options).collect()
    return sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in found), key=repr)


def test_importance_equals_a_count_by_hand(spark, sf_dir):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(30 + k, " ".join(f"w{(k * j * j) % 37} İé" for j in range(5 + k))) for k in range(80)] + [(77, " ".join(f"copy{j}" for j in range(30)))] * 50 + [(200, "A-B_c\x00d 9é\x7fz" * 9)]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()] + [None, "", "w1 w2 w3"]
    wanted = spark.createDataFrame([(t, "x") for t in target], "text string, id string")
    have = table(spark, [(i, t, "en") for i, t in rows])
    assert scores(have, wanted) == importance_by_hand(rows, target)
    other = {"longest": 3, "buckets": 70_000, "percent": 60, "min_words": 5, "seed": 3}
    assert scores(have, wanted, **other) == importance_by_hand(rows, target, **other)
    nothing = wanted.limit(0)
    assert scores(have, nothing) == importance_by_hand(rows, [])
    assert scores(no_documents(spark), wanted) == []


def test_drawn_documents_keep_their_columns(spark):
    rows = [(k, " ".join(f"w{(k * j) % 50}" for j in range(25)), "en") for k in range(40)]
    docs, target = table(spark, rows), spark.createDataFrame([("w1 w2 w3",)], "text string")
    drawn = {r.doc_id for r in importance.importance_scores(docs, target).where("rank is not null").collect()}
    got = importance.resampled(docs, target)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == drawn and len(drawn) == 10


@pytest.mark.parametrize("longest", [1, 2, 3, 5])
def test_blocks_cut_texts_without_loss(monkeypatch, longest):
    """Texts far longer than a block and pieces of a few bytes give the features of the whole text."""
    monkeypatch.setattr(importance, "BLOCK", 7)
    monkeypatch.setattr(importance, "PIECE", 11)
    random.seed(longest)
    texts = [" ".join(random.choice(["a", "bb", "Cc", "dé", "e" * 40]) for _ in range(n)) for n in (0, 1, 6, 7, 8, 13, 14, 15, 50, 200, 3, 2)] + [None, "", "  ", "z"]
    blocks = importance._Blocks(longest, 1000)
    got = [x for k, t in enumerate(texts) for x in blocks.add(k, 0, None if t is None else t.encode())] + list(blocks.flush())
    assert [g[0] for g in got] == list(range(len(texts)))
    for (_, _, n_words, n, ids), text in zip(got, texts, strict=True):
        want = features_by_hand(text, longest, 1000)
        assert n_words == len(words_by_hand(text)) and n == len(want)
        assert sorted(np.frombuffer(ids, "<u2").tolist()) == sorted(want)


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 7])
def test_suffixes_are_sorted_to_their_depth(depth):
    ids = np.random.default_rng(depth).integers(0, 3, 300)
    order = importance.suffix_order(ids, depth)
    heads = [tuple((ids[p : p + depth] + 1).tolist()) for p in order]
    assert sorted(order.tolist()) == list(range(300)) and heads == sorted(heads)
