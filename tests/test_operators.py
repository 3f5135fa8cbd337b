import datetime as dt
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from tidemark.operators import articles as A
from tidemark.operators import graph, merge, messages, rank, series
from tidemark.plans.registry import QUERIES


def greedy(rows):
    by_url, by_title, kept = {}, {}, {}
    for at, u, t in rows:
        found = by_url.get(u) if u else None
        if found is None and t:
            found = by_title.get(t)
        if found is None:
            found = at
            if u:
                by_url[u] = at
            if t:
                by_title[t] = at
        kept[at] = found
    return kept


def test_greedy_dedupe_equals_the_scan(spark):
    rnd = random.Random(1)
    rows = [(k, "c" + str(k % 2), rnd.choice(["", *"abcdefgh"]), rnd.choice(["", *"stuvwxyz"])) for k in range(120)]
    table = spark.createDataFrame(rows, "position long, company string, url string, title string")
    got = {r.position: r.kept_position for r in A.greedy_deduplicated(table, "company", "url", "title", "position").collect()}
    want = {}
    for c in ("c0", "c1"):
        want |= greedy([(p, u, t) for p, g, u, t in rows if g == c])
    assert got == want


def test_greedy_dedupe_of_chains_and_stars(spark):
    """Chains far longer than the rounds and a task's limit, one key that most rows share, nulls, copies, and equal positions of two groups."""
    chain = [(k, "c0", f"u{(k + 1) // 2}", f"t{k // 2}") for k in range(900)]
    backward = [(k, "c1", f"u{(900 - k + 1) // 2}", f"t{(900 - k) // 2}") for k in range(900)]
    star = [(k, "c2", "hot", f"t{k % 700}") for k in range(2_000)] + [(5_000 + k, "c2", None if k % 2 else "", f"t{k}") for k in range(900)]
    rows = chain + backward + star
    table = spark.createDataFrame(rows, "position long, company string, url string, title string")
    found = A.greedy_deduplicated(table, "company", "url", "title", "position", rounds=3, limit=400).collect()
    assert len(found) == len(rows)
    for c in ("c0", "c1", "c2"):
        want = greedy([(p, u, t) for p, g, u, t in sorted(rows, key=lambda r: r[0]) if g == c])
        assert {r.position: r.kept_position for r in found if r.company == c} == want
    assert A.greedy_deduplicated(table.limit(0), "company", "url", "title", "position").count() == 0


def test_articles_of_companies_never_merge_with_each_other(spark):
    """Positions are times and ids, so equal ones of two companies don't meet; undated articles come first."""
    from tidemark.plans import flows

    def article(i, code, url, title, at, tier="other", provider="naver"):
        return (i, code, url, title, at, tier, provider)

    rows = [article("a", "036542", "https://x/1", "t", None), article("a", "330998", "https://x/1", "t", None), article("b", "036542", "https://x/1", "u", "2024-01-01 00:00:00", "official", "gdelt"), article("b", "330998", "https://x/2", "u", "2024-01-01 00:00:00")]
    raw = spark.createDataFrame(rows, "article_id string, stock_code string, canonical_url string, normalized_title string, at string, source_tier string, provider string")
    full = raw.select(
        "article_id", "stock_code", "canonical_url", "normalized_title", F.to_timestamp("at").alias("published_at"), "source_tier", "provider", F.array("provider").alias("providers"), F.array(F.lit("k")).alias("event_keywords"), F.array(F.lit("c")).alias("categories"),
        F.concat("canonical_url", F.lit("/"), "article_id").alias("url"), F.lit("d").alias("source_domain"), F.lit("n").alias("source_name"), F.lit(False).alias("official_source"),
    )
    got = {(r.stock_code, r.article_id): (r.provider, r.url) for r in flows.deduplicated(full).collect()}
    assert got == {("036542", "a"): ("both", "https://x/1/b"), ("330998", "a"): ("naver", "https://x/1/a"), ("330998", "b"): ("naver", "https://x/2/b")}


def test_budget_gate_equals_a_scan_in_any_split(spark):
    rnd = random.Random(3)
    rows = [(k, "hot" if k % 5 else f"p{k % 3}", rnd.randint(0, 6), rnd.randint(0, 8), k // 97) for k in range(3_000)]
    table = spark.createDataFrame(rows, "k int, who string, budget int, actual int, day int").repartition(7)
    for limit, daily_limit in ((900, 30), (60, 10**9), (10**9, 10**9), (0, 5)):
        got = {r.k: r.allowed for r in messages.budget_gate(table, "who", "k", "budget", "actual", limit, "day", daily_limit).collect()}
        used, today, want = {}, {}, {}
        for k, who, budget, actual, day in rows:
            want[k] = used.get(who, 0) + budget <= limit and today.get((who, day), 0) + budget <= daily_limit
            if want[k]:
                used[who], today[who, day] = used.get(who, 0) + actual, today.get((who, day), 0) + actual
        assert got == want


def test_greedy_query_equals_the_scan(spark, sf_dir):
    docs = sorted((r.source, r.doc_id, f"{r.lang}-{r.n_chars}", r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    want = {}
    for source in {d[0] for d in docs}:
        want |= greedy([(i, u, t) for s, i, u, t in docs if s == source])
    assert {r.doc_id: r.kept_position for r in QUERIES["two_key_dedupe_greedy"](spark, sf_dir).collect()} == want


def test_ratio_pairs_equal_all_pairs(spark, sf_dir):
    from tidemark.plans.articles import articles

    rows = [(r.page_id, r.company, r.published, r.norm) for r in articles(spark, sf_dir).collect()]
    want = {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[2] < b[2] and (b[2] - a[2]) <= dt.timedelta(hours=72) and SequenceMatcher(None, a[3], b[3]).ratio() >= 0.82}
    assert {(r.a, r.b) for r in QUERIES["similarity_ratio_pairs"](spark, sf_dir).collect()} == want


def test_ratio_is_not_symmetric(spark):
    row = spark.createDataFrame([("tide", "diet")], "a string, b string").select(A.sequence_ratio("a", "b").alias("x"), A.sequence_ratio("b", "a").alias("y")).first()
    assert (row.x, row.y) == (0.25, 0.5)


def test_budget_gate_counts_actual_use(spark, sf_dir):
    rows = sorted((r.c_nationkey, r.c_custkey, r.budget, r.actual, r.allowed) for r in QUERIES["budget_gate_exact"](spark, sf_dir).collect())
    used = {}
    for nation, _, budget, actual, allowed in rows:
        assert allowed == (used.get(nation, 0) + budget <= 50)
        used[nation] = used.get(nation, 0) + (actual if allowed else 0)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5)], "src long, dst long")
    assert {r.node: r.component for r in graph.least_labels(edges).collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}


def test_components_of_a_long_sorted_chain_take_few_rounds(spark, monkeypatch):
    rounds = []
    own = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name="table": rounds.append(name) or own(df, name))
    chain = spark.range(100_000).selectExpr("id as src", "id + 1 as dst")
    labels = graph.least_labels(chain)
    assert labels.where("component <> 0").count() == 0 and labels.count() == 100_001
    assert rounds.count("parents") < 25
    assert graph.least_labels(chain.limit(0)).count() == 0


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = merge.upserted(old, new, ["k"])
    want = {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in merge.upserted(once, new, ["k"]).collect()}


def test_retention_limits(spark):
    now = dt.datetime(2026, 7, 17)
    rows = [("c", f"e{k}", now - dt.timedelta(days=k), "material") for k in range(40)] + [("c", "future", now + dt.timedelta(days=5), "low"), ("c", "never", None, "low"), ("c", "e0", now - dt.timedelta(days=90), "low")]
    events = spark.createDataFrame(rows, "code string, id string, t timestamp, level string")
    kept = rank.retained(events, F.lit(now), group="code", key="id", time="t", bucket="level", limits={"material": (30, 10), "low": (7, 2)}).collect()
    assert {r.id for r in kept} == {*(f"e{k}" for k in range(10)), "future"}


def test_gaps_are_no_previous_quarters(spark):
    rows = spark.createDataFrame([("c", 10, 1), ("c", 12, 2), ("c", 13, 4)], "k string, qi int, v long")
    got = {r.qi: r.base for r in series.shifted(rows, "k", "qi", "v", {"base": 1}).collect()}
    assert got == {10: None, 12: None, 13: 2}


def test_final_beats_newer_provisional_and_unknown_is_not_final(spark):
    rows = [("q1", False, 1, "final"), ("q1", True, 2, "newer"), ("q2", None, 1, "unknown"), ("q2", True, 2, "provisional")]
    table = spark.createDataFrame(rows, "q string, p boolean, t int, name string")
    got = {r.q: (r.name, r.status) for r in series.final_wins(table, ["q"], "p", [F.col("t").desc()]).collect()}
    assert got == {"q1": ("final", "final"), "q2": ("provisional", "provisional")}


def test_corrected_versions_and_conflicts(spark):
    rows = [("a", True, 1, 5), ("a", False, 2, 6), ("b", False, 1, 5), ("b", False, 1, 6), ("c", False, None, 5), ("c", False, 1, 6), ("d", False, 1, 1), ("d", False, 2, 2)]
    table = spark.createDataFrame(rows, "q string, corrected boolean, t int, v int")
    got = {r.q: (r.v, r.conflict) for r in series.corrected_latest(table, ["q"], "corrected", "t", ["v"], [F.col("v").desc()]).collect()}
    assert got == {"a": (5, None), "b": (6, "same_time_values_differ"), "c": (6, "unknown_time_values_differ"), "d": (2, None)}


def test_collection_windows_and_cursors(spark):
    now = dt.datetime(2026, 7, 17, 12)
    rows = spark.createDataFrame([(1, None), (2, now - dt.timedelta(hours=1)), (3, now - dt.timedelta(hours=40))], "k int, last timestamp")
    got = {r.k: r.s for r in rows.select("k", messages.collection_start(F.lit(now), F.col("last")).alias("s")).collect()}
    assert got == {1: now - dt.timedelta(days=7), 2: now - dt.timedelta(hours=4), 3: now - dt.timedelta(hours=16)}
    cursors = spark.createDataFrame([("a", now, now, "old", 2), ("b", now, None, None, 1), ("c", now, now, None, 0)], "code string, last_successful_run timestamp, last_article_published_at timestamp, last_error string, consecutive_failures int")
    later = now + dt.timedelta(hours=12)
    outcomes = spark.createDataFrame([("a", True, later, None, None), ("b", False, later, None, "timeout"), ("d", False, later, None, "429")], "code string, ok boolean, run_at timestamp, newest_article timestamp, error string")
    after = {r.code: (r.last_successful_run, r.last_error, r.consecutive_failures) for r in messages.cursor_updated(cursors, outcomes, ["code"]).collect()}
    assert after == {"a": (later, None, 0), "b": (now, "timeout", 2), "c": (now, None, 0), "d": (None, "429", 1)}


def test_routing_matrix(spark):
    companies = spark.createDataFrame([("005930", ["삼성전자", "Samsung Electronics"], False), ("000660", ["하이닉스"], False), ("111111", ["강원랜드"], True)], "stock_code string, terms array<string>, requires_code boolean")
    texts = {1: "종목코드: 005930", 2: "종목코드: 999999", 3: "005930 와 000660", 4: "samsung electronics 공시", 5: "삼성전자 하이닉스", 6: "강원랜드 소식", 7: "아무 말", 8: "계약상대: 삼성전자\n하이닉스 수주"}
    rows = messages.routed(spark.createDataFrame(list(texts.items()), "id long, text string"), companies).collect()
    got = {r.id: (r.stock_code, r.status, r.reason) for r in rows}
    assert got == {
        1: ("005930", "assigned", None), 2: ("999999", "quarantine", "code_not_in_portfolio"), 3: (None, "quarantine", "ambiguous_explicit_codes"), 4: ("005930", "assigned", None), 5: (None, "quarantine", "ambiguous_alias_match"),
        6: ("111111", "quarantine", "target_requires_explicit_code"), 7: (None, "dropped", None), 8: ("000660", "assigned", None),
    }


def clusters_by_hand(rows, same):
    """rows: (id, company, seconds or None, title, items) in order; cluster of each by union-find over all pairs."""
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a[1] == b[1] and (a[2] is None or b[2] is None or abs(a[2] - b[2]) <= 259_200) and same(a, b):
                parent[max(find(a[0]), find(b[0]))] = min(find(a[0]), find(b[0]))
    return {r[0]: find(r[0]) for r in rows}


def same_title(a, b):
    if not a[3] or not b[3]:
        return False
    x, y = set(a[4]), set(b[4])
    jaccard = len(x & y) / len(x | y) if x | y else 0
    return SequenceMatcher(None, a[3], b[3]).ratio() >= 0.72 or jaccard >= 0.5 or (len(x & y) >= 3 and jaccard >= 0.25)


def same_event(a, b):
    return SequenceMatcher(None, a[3], b[3]).ratio() >= 0.82 or len(set(a[4]) & set(b[4])) >= 2


def test_clusters_equal_all_pairs(spark):
    from tidemark.operators import similar

    rnd = random.Random(11)
    words = ["chip", "plant", "hbm", "invest", "삼성", "전자", "공급", "계약", "a1", "results", "profit"]
    rows = []
    for k in range(220):
        title = " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 6)))
        if k % 4 == 0 and rows:
            base = rnd.choice(rows)[3]
            title = base[: max(0, len(base) - rnd.randint(0, 3))] + rnd.choice(["", "s", "계"])
        rows.append((k, rnd.choice("xy"), None if k % 17 == 0 else rnd.randint(0, 60) * 43_200, title, sorted(set(title.split()))))
    rows.sort(key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
    table = spark.createDataFrame([(*r[:2], None if r[2] is None else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=r[2]), *r[3:]) for r in rows], "k int, g string, t timestamp, title string, items array<string>")
    for edges, same in ((similar.title_edges, same_title), (similar.event_edges, same_event)):
        labels = {r.node: r.component for r in graph.least_labels(edges(table, "g", "k", "t", "title", "items")).collect()}
        assert {r[0]: labels.get(r[0], r[0]) for r in rows} == clusters_by_hand(rows, same)
    assert similar.event_edges(table.limit(0), "g", "k", "t", "title", "items").count() == 0


def test_cluster_queries_equal_all_pairs(spark, sf_dir):
    import hashlib

    from tidemark.plans.articles import _titles

    found = [(r.page_id, r.company, None if r.published is None else (r.published - dt.datetime(2024, 1, 1)).total_seconds(), r.norm, r.tokens, r.keywords) for r in _titles(spark, sf_dir).collect()]
    found.sort(key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
    for name, same, item in (("title_clusters", same_title, 4), ("event_clusters", same_event, 5)):
        rows = [(*r[:4], r[item]) for r in found]
        group = clusters_by_hand(rows, same)
        anchor = {g: min(r[3] for r in rows if group[r[0]] == g) for g in set(group.values())}
        want = {r[0]: hashlib.sha256(f"{r[1]}|{anchor[group[r[0]]]}".encode()).hexdigest()[:16] for r in rows}
        assert {r.page_id: r.cluster_id for r in QUERIES[name](spark, sf_dir).collect()} == want


def test_alike_edges_are_few_and_the_same_in_any_blocks(spark):
    """Copies and rows without a time give as many edges as rows (all pairs before), and small blocks link what large ones do."""
    from tidemark.operators import similar

    copies = spark.range(600).selectExpr("id AS k", "'x' AS g", "IF(id % 3 = 0, NULL, timestamp'2024-01-01' + make_dt_interval(0, int(id % 40))) AS t", "concat('the plant opens ', id % 20) AS title", "array('plant', 'opens') AS items")
    for edges in (similar.title_edges(copies, "g", "k", "t", "title", "items"), similar.event_edges(copies, "g", "k", "t", "title", "items", block=8)):
        edges = graph.stored(edges, "few")
        assert edges.count() < 3 * 600
        assert graph.least_labels(edges).select("component").distinct().count() == 1
    rnd = random.Random(5)
    long = "".join(rnd.choice("abcd ") for _ in range(150))
    rows = []
    for k in range(90):
        at = rnd.randint(0, 150)
        title = None if k % 15 == 0 else long[:at] + long[at + rnd.randint(0, 80) :] if k % 2 else "".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, 9)))
        rows.append((k, "xy"[k % 2], None if k % 11 == 0 else rnd.randint(0, 40) * 43_200, title, sorted(set(rnd.choices("pqrstuvw", k=rnd.randint(0, 2))))))
    rows.sort(key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
    table = spark.createDataFrame([(*r[:2], None if r[2] is None else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=r[2]), *r[3:]) for r in rows], "k int, g string, t timestamp, title string, items array<string>")
    same = lambda a, b: len(set(a[4]) & set(b[4])) >= 2 or (a[3] is not None and b[3] is not None and SequenceMatcher(None, a[3], b[3]).ratio() >= 0.82)
    labels = {r.node: r.component for r in graph.least_labels(similar.event_edges(table, "g", "k", "t", "title", "items", block=3)).collect()}
    assert {r[0]: labels.get(r[0], r[0]) for r in rows} == clusters_by_hand(rows, same)


def test_cells_without_pairs_are_not_dealt(spark):
    """Companies with an article in most bands at most: no cell of one node is handed to a task (each was, as side 0 and as side 1)."""
    from tidemark.operators import similar

    one = spark.range(300).selectExpr("id AS first_key", "id AS g", "id % 7 AS cell", "0 AS side", "concat('title ', id) AS title", "array('a') AS items", "0D AS lo", "0D AS hi", "0L AS first_time", "0L AS last_time", "id AS last_key")
    near = one.where("g < 3").selectExpr("first_key + 300 AS first_key", "g", "cell", "1 AS side", "title", "items", "lo", "hi", "first_time", "last_time", "last_key")
    later = one.selectExpr("first_key", "g", "cell - 1 AS cell", "1 AS side", "title", "items", "lo", "hi", "first_time", "last_time", "last_key")
    dealt = similar._cells(one.unionByName(near).unionByName(later), ["g", "cell"], 1_000).select("g", "first_key", "role").collect()
    assert sorted(map(tuple, dealt)) == [(k, key, role) for k in range(3) for key, role in ((k, 0), (k + 300, 1))]
