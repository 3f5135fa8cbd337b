import json

from pyspark.sql import functions as F

from tidemark.functions import codes, fiscal
from tidemark.functions import text as T
from tidemark.operators import articles as A
from tidemark.operators import companies as C
from tidemark.operators import messages as M
from tidemark.sources import files
from tidemark.streaming import streams


def test_names_are_routed_by_field_particle_and_punctuation(spark):
    companies = spark.createDataFrame([("000001", ["삼성전자", "Alpha"], False), ("000002", ["Beta", "AT&T"], False), ("000003", ["테스"], True)], "stock_code string, terms array<string>, requires_code boolean")
    messages = {
        "삼성전자는 실적을 발표했다": ("000001", "assigned", None), "기업명: Alpha\nBeta in the body": ("000001", "assigned", None), "AT&T wins contract": ("000002", "assigned", None), "AT T wins": (None, "dropped", None),
        "Alpha and Beta": (None, "quarantine", "ambiguous_alias_match"), "테스의 소식": ("000003", "quarantine", "target_requires_explicit_code"), "삼성전자주 하락": (None, "dropped", None), "거래상대: Alpha": (None, "dropped", None),
        "alphabet": (None, "dropped", None), "see https://alpha.example/Alpha": (None, "dropped", None), "ALPHA!": ("000001", "assigned", None),
    }
    rows = spark.createDataFrame(list(enumerate(messages)) + [(99, None)], "id long, text string")
    got = {r.id: (r.stock_code, r.status, r.reason) for r in M.routed(rows, companies).collect()}
    assert got == {k: v for k, v in enumerate(messages.values())} | {99: (None, "dropped", None)}


def test_context_stands_round_the_term(spark):
    term = F.lit("회사")
    text = F.lit("a" * 50 + " 회사 " + "b" * 80)
    got = spark.range(1).select(T.context_of(text, term, codes.term_pattern(term)).alias("c"), T.context_of(F.lit("mail a@b.co")).alias("d"), T.context_of(F.lit(None).cast("string")).alias("e")).first()
    assert got.c == "a" * 29 + " 회사 " + "b" * 27 and got.d == "mail [EMAIL]" and got.e == ""


def test_first_quarter_of_a_text_counts(spark):
    texts = ["1Q26 vs 2025 Q4", "2025.4Q and 1Q26", "2026 Q2", "none", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", fiscal.normalize_quarter(F.col("t")).alias("q")).collect()
    assert [r.q for r in sorted(rows)] == ["2026 Q1", "2025 Q4", "2026 Q2", None, None]


def test_undated_rows_pair_with_all_of_their_group(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "a", "2024-01-01 00:00:00"), (4, "a", "2024-03-01 00:00:00"), (5, "b", None)], "k int, g string, t string").withColumn("t", F.col("t").cast("timestamp"))
    got = {frozenset((r.a_k, r.b_k)) for r in A.pairs_within(rows, "g", "k", "t", 259_200, []).collect()}
    assert got == {frozenset(p) for p in ((1, 2), (1, 3), (1, 4), (2, 3), (2, 4))}


def test_budget_gate_counts_days(spark):
    rows = spark.createDataFrame([(k, "p" if k < 6 else "q", 2, 2, k // 3) for k in range(8)], "k int, who string, budget int, actual int, day int")
    got = {r.k: r.allowed for r in M.budget_gate(rows, "who", "k", "budget", "actual", 8, "day", 4).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 5: False, 6: True, 7: True}


def test_channel_goes_on_after_a_restart(spark, tmp_path):
    files.register(spark)
    fixture = tmp_path / "c.jsonl"
    fixture.write_text("".join(json.dumps({"id": k, "date": None, "text": f"m{k}"}) + "\n" for k in range(1, 13)))
    seen = []

    def run():
        stream = spark.readStream.format("tidemark_channel").option("fixture", str(fixture)).option("batch", "3").load()
        query = stream.writeStream.foreachBatch(lambda df, _: seen.extend(r.id for r in df.collect())).option("checkpointLocation", str(tmp_path / "ck")).start()
        query.processAllAvailable()
        query.stop()

    run()
    assert seen == list(range(1, 13))
    with fixture.open("a") as f:
        f.write("".join(json.dumps({"id": k, "date": None, "text": "x"}) + "\n" for k in (13, 14)))
    run()
    run()
    assert seen == list(range(1, 15))


def test_fresh_rows_drop_repeats_and_late_ones(spark, tmp_path):
    out = []
    for n, rows in enumerate(([(1, "2024-01-01 10:00:00"), (2, "2024-01-01 12:00:00")], [(1, "2024-01-01 10:30:00"), (3, "2024-01-01 20:00:00")], [(5, "2024-01-01 19:00:00")], [(4, "2024-01-01 10:00:00"), (6, "2024-01-01 20:00:00"), (7, "2024-01-01 08:00:00")])):
        spark.createDataFrame(rows, "id int, t string").selectExpr("id", "cast(t as timestamp) as t").coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
    stream = spark.readStream.schema("id int, t timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    fresh = streams.fresh_rows(stream, ["id"], "t", now=F.lit("2024-01-02 01:00:00").cast("timestamp"))
    query = fresh.writeStream.foreachBatch(lambda df, _: out.extend(r.id for r in df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    # id 1 comes once, id 4 is later than the overlap of three hours
    assert sorted(out) == [1, 2, 3, 5, 6]


def test_quarantine_is_a_side_output_and_batches_repeat(spark, tmp_path):
    sink = streams.quarantine_sink(str(tmp_path / "q"), F.col("id") > 1)
    batch = spark.createDataFrame([(1,), (2,), (None,)], "id int")
    for _ in range(2):
        sink(batch, 0)
    assert [r.id for r in spark.read.parquet(str(tmp_path / "q" / "good")).collect()] == [2]
    assert sorted((r.id for r in spark.read.parquet(str(tmp_path / "q" / "quarantine")).collect()), key=str) == [1, None]


def test_upserts_keep_the_newest_folder_of_each_bucket(spark, tmp_path):
    target = str(tmp_path / "u")
    sink = streams.upsert_sink(target, ["k"], "v")
    for n in range(6):
        sink(spark.createDataFrame([(k, n) for k in range(n, n + 3)], "k int, v int"), n)
    want = sorted((k, min(k, 5)) for k in range(8))
    assert sorted((r.k, r.v) for r in streams.read_upserted(spark, target).collect()) == want
    assert len(streams.read_upserted(spark, target).inputFiles()) <= 8
    assert streams.compacted(spark, target) > 0
    assert sorted((r.k, r.v) for r in streams.read_upserted(spark, target).collect()) == want


def test_defaults_keep_given_nulls(spark):
    given, defaults = (F.from_json(F.lit(j), "map<string,string>") for j in ('{"a":null,"b":"x"}', '{"a":"1","c":"2"}'))
    assert spark.range(1).select(C.with_defaults(given, defaults).alias("m")).first().m == {"a": None, "b": "x", "c": "2"}
