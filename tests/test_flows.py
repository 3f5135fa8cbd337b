import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import parser
from tidemark.plans import flows, news
from tidemark.sources import files, sinks

REPORT = (
    "기업명: 삼성전자(시가총액: 400조)\n종목코드: A005930\n보고서명: 연결재무제표기준영업(잠정)실적(2026.06)\n잠정실적: Y\n매출액 : 1,000억(예상치: 900억)\n영업익 100억 (90억)\n누적 영업익 999억\n순이익 (50억)\n"
    "2026 Q1 900억 80억 40억\n2025.4Q 800억 70억 -30억\n2026 Q1 1억 1억 1억\n공시일시: 2026.07.17 15:30\nhttps://dart.fss.or.kr/x?rcpNo=20260717000001"
)


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame([(1, "2026-07-17", REPORT), (2, "2026-07-18", "정정공시 기업명: 없는회사 999999"), (3, "2026-07-18", "삼성전자 공시 보고서"), (4, "2026-07-18", "아무 말"), (5, "2026-07-19", None)], "id long, date string, text string")


def won(amount):
    return None if amount is None else amount.value_won


def test_parsed_report(messages):
    row = parser.parsed_messages(messages).where("id = 1").first()
    assert (row.classification, row.company_name, row.stock_code, row.company_code_source, row.report_period, row.disclosure_datetime, row.provisional, row.dart_receipt_number) == ("earnings", "삼성전자", "005930", "labeled_stock_code", "2026.06", "2026-07-17 15:30:00", True, "20260717000001")
    assert [won(row[k]) for k in ("revenue_actual", "revenue_consensus", "operating_profit_actual", "operating_profit_consensus", "net_income_actual", "net_income_consensus")] == [10**11, 9 * 10**10, 10**10, 9 * 10**9, -5 * 10**9, None]
    assert [(r.fiscal_quarter, won(r.revenue), won(r.net_income)) for r in row.recent_earnings] == [("2026 Q1", 9 * 10**10, 4 * 10**9), ("2025 Q4", 8 * 10**10, -3 * 10**9)]
    assert row.has_earnings_data and not parser.parsed_messages(messages).where("id = 5").first().has_earnings_data


def test_forecast_goes_to_the_only_matching_quarter(spark):
    text = "매출액 10억(예상 9억)\n영업이익 5억\n2026 Q1 10억 5억 1억\n2025 Q4 8억 5억 1억"
    rows = parser.candidates(parser.parsed_messages(spark.createDataFrame([(1, "d", text)], "id long, date string, text string"))).collect()
    assert {r.fiscal_quarter: r.revenue_consensus for r in rows} == {"2026 Q1": 900_000_000, "2025 Q4": None}


def test_message_flow(spark, messages):
    companies = spark.createDataFrame([("005930", ["삼성전자"], False)], "stock_code string, terms array<string>, requires_code boolean")
    out = flows.message_flow(messages, companies)
    quarters = {r.fiscal_quarter: (r.revenue, r.status, r.conflict) for r in out["quarters"].collect()}
    assert quarters == {"2026 Q2": (10**11, "provisional", False), "2026 Q1": (9 * 10**10, "provisional", False), "2025 Q4": (8 * 10**10, "provisional", False)}
    assert {(r.identity, r.label) for r in out["disclosures"].collect()} == {("r:20260717000001", "실적")}
    # message 3 is found by its name but states no code, so nothing of it is merged
    assert sorted((r.id, r.target, r.parsed_code, r.reason, r.stage) for r in out["quarantine"].collect()) == [(2, None, "999999", "code_not_in_portfolio", "distribution"), (3, "005930", None, "parsed_code_missing", "pre_merge_validation")]
    assert out["companies"].first().asDict() == {"stock_code": "005930", "matched": 2, "parsed": 1, "failures": 0, "new_quarters": 3, "warnings": 0, "new_disclosures": 1}
    totals = out["totals"].first()
    assert (totals.messages_processed, totals.unique_matched, totals.companies_with_matches, totals.quarantine_count, totals.end_cursor) == (5, 2, 1, 2, 5)


def test_news_flow(spark):
    companies = spark.createDataFrame([("005930", "삼성전자", ["삼성전자"], ["Samsung"], ["HBM", "investment"], ["samsung.com"], ["reuters.com"])], "stock_code string, company_name string, aliases array<string>, english_aliases array<string>, important_keywords array<string>, official_sources array<string>, major_source_domains array<string>")
    items = [("Samsung to expand <b>HBM</b> capacity investment", "http://www.reuters.com/a/?utm_source=x&b=2&a=1", "2026-07-17T02:00:00Z"), ("Samsung to expand HBM capacity investment plan", "http://samsung.com/b", "2026-07-17T11:30:00+09:00"), ("Samsung profit", "https://x.kr/c#f", "20260710T000000Z"), ("Samsung profit", "https://x.kr/d", "Sat, 11 Jul 2026 00:00:00 +0000")]
    raw = spark.createDataFrame([("005930", t, "", u, p, "English") for t, u, p in items], "stock_code string, title string, description string, url string, published_at string, language string")
    now = F.lit("2026-07-17 10:00:00").cast("timestamp")
    unique = flows.deduplicated(flows.normalized_articles(raw, companies, "gdelt", "2026-07-18"))
    assert unique.count() == 3
    events = flows.news_events(unique, companies, now)
    by = {r.article_count: r for r in events.collect()}
    assert by[2].importance_score == 95 and by[2].importance_level == "critical" and by[2].representative_url == "https://samsung.com/b" and by[2].source_domains == ["reuters.com", "samsung.com"]
    assert by[1].importance_level == "low" and by[1].domestic_article_count == 1
    sinks.assert_public(events)
    merged = flows.merged_events(events, events, now)
    assert merged.count() == 2
    assert flows.event_index(companies, merged).first().event_count == 2


def test_earnings_flow(spark):
    both = "기업명: 가\n메시지 ID: 1\n매출액 1억\n2026 Q1 1억 1억 1억\n기업명: 나\n메시지 ID: 2\n매출액 2억\n2026 Q1 2억 2억 2억"
    table = spark.createDataFrame([("/a/005930/x.txt", "005930", REPORT, True), ("/a/000660/y.txt", "000660", both, True), ("/a/000660/z.txt", "000660", both, False)], "path string, folder_code string, text string, first_copy boolean")
    got = {(r.folder_code, r.fiscal_quarter): (r.revenue, r.conflict) for r in flows.earnings_flow(table).collect()}
    assert got[("005930", "2026 Q2")] == (10**11, None) and got[("000660", "2026 Q1")][1] == "unknown_time_values_differ"
    assert parser.split_files(table.where("folder_code = '000660' and first_copy")).count() == 2


def test_messages_are_parsed_within_their_rows(messages):
    """Lines were exploded, grouped and joined again by message, so texts were shuffled with every branch of the parse."""
    found = parser.candidates(parser.parsed_messages(messages))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString() and found.where("id = 1").count() == 3


def test_earnings_run_of_several_messages_in_a_file(spark):
    """Parts are read where each has earnings, else the whole; a run builds the tables that are asked for."""
    from tidemark.plans import earnings

    part = "기업명: {0}\n메시지 ID: {1}\n매출액 {1}억\n2026 Q{1} 1억 1억 1억"
    both, half = part.format("가", 1) + "\n" + part.format("가", 2), part.format("나", 1) + "\n기업명: 나\n메시지 ID: 2\n누적 소식"
    texts = {"1/a": both, "1/b": both, "2/a": half, "2/b": " \n", "3/a": part.format("다", 1), "2/c": part.format("가", 3)}
    files = spark.createDataFrame([(p, p[0], t, "utf-8-sig", str(hash(t))) for p, t in texts.items()], "path string, folder_code string, text string, encoding string, digest string")
    companies = spark.createDataFrame([("1", "가", ["가"]), ("2", "나", ["나"])], "stock_code string, company_name string, terms array<string>")
    done = earnings.earnings_run(files, companies, ["files"])
    assert set(done) == {"files"}
    got = {r.path: (r.match, r.messages, r.uncertain, r.rows, r.cumulative, r.parse_status, ";".join(r.warnings)) for r in done["files"].collect()}
    assert got == {
        "1/a": ("folder_only_match", 2, False, 2, False, "success", ""), "1/b": ("unknown_company", 0, False, 0, False, "skipped_duplicate", "duplicate_file_hash"), "2/a": ("folder_only_match", 1, True, 1, True, "success", "message_split_uncertain"),
        "2/b": ("unknown_company", 0, False, 0, False, "failed", "unreadable_or_empty"), "3/a": ("unknown_company", 1, False, 0, False, "failed", ""), "2/c": ("company_mismatch", 1, False, 0, False, "failed", "company_mismatch:1"),
    }
    quarters = earnings.earnings_run(files, companies, ["quarters"])["quarters"].collect()
    assert sorted((r.folder_code, r.fiscal_quarter) for r in quarters) == [("1", "2026 Q1"), ("1", "2026 Q2"), ("2", "2026 Q1")]


def test_names_are_grouped_after_one_shuffle(spark):
    """Hits were shuffled to be distinct, by company and by message; particles were cut off by a pattern for every place and length."""
    from tidemark.operators import messages as M
    from tidemark.operators import names

    words = ["삼성은", "은", "은은", "a가", "가", "-", "삼성", "도도", "x"]
    bare = spark.createDataFrame([(w,) for w in words], "w string").select("w", names._without_particle(F.col("w")).alias("b")).collect()
    assert {r.w: r.b for r in bare} == {"삼성은": "삼성", "은": None, "은은": "은", "a가": "a", "가": None, "-": None, "삼성": None, "도도": "도", "x": None}
    companies = spark.createDataFrame([("000001", ["삼성", "Alpha"], False), ("000002", ["Beta"], True)], "stock_code string, terms array<string>, requires_code boolean")
    rows = spark.createDataFrame([(1, "삼성은 삼성과 Alpha"), (2, "Beta 삼성"), (3, "x")], "id long, text string")
    found = M.routed(rows, companies)
    assert {(r.id, r.stock_code, r.status, r.term) for r in found.collect()} == {(1, "000001", "assigned", None), (2, "000002", "quarantine", "Beta"), (2, "000001", "assigned", None), (3, None, "dropped", None)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [id") == 1 and "Aggregate [id#" in plan


def test_earnings_run_parses_what_its_tables_need(spark, monkeypatch):
    """Names, codes, links and reports of all messages were parsed and written for totals and published quarters that hold none of them."""
    from tidemark.plans import earnings

    written, stored = {}, earnings.stored
    monkeypatch.setattr(earnings, "stored", lambda df, name="table": (written.setdefault(name, set(df.columns)), stored(df, name))[1])
    text = "기업명: 가 (000001)\n보고서명: 분기보고서 (2026.06)\n공시시각: 2026.07.17 10:30\nhttps://dart.fss.or.kr/x?rcpNo=20260717000001\n매출액: 3억\n2026.1Q 2억 / 1억 / 1억"
    files = spark.createDataFrame([("1/a", "1", text, "utf-8-sig", "a")], "path string, folder_code string, text string, encoding string, digest string")
    companies = spark.createDataFrame([("1", "가 (000001)", ["가"])], "stock_code string, company_name string, terms array<string>")
    unneeded = {"company_name", "stock_code", "market_cap_text", "report_name", "dart_url", "dart_receipt_number", "standard"}
    totals = earnings.earnings_run(files, companies, ["totals"])["totals"].first()
    assert (totals.parsed_files, totals.quarter_records, totals.partial_1_to_4q) == (1, 2, 1) and not written["pieces"] & unneeded
    written.clear()
    rows = earnings.earnings_run(files, companies, ["published"], ["fiscal_quarter", "revenue", "revenue_qoq"])["published"].collect()
    assert sorted((r.folder_code, r.fiscal_quarter, r.revenue, r.revenue_qoq) for r in rows) == [("1", "2026 Q1", 2 * 10**8, None), ("1", "2026 Q2", 3 * 10**8, 50.0)]
    assert not (written["pieces"] | written["selected"]) & unneeded
    whole = earnings.earnings_run(files, companies, ["published"])["published"].where("revenue_qoq = 50").first()
    assert (whole.report_name, whole.dart_receipt_number, whole.standard) == ("분기보고서 (2026.06)", "20260717000001", None)


def test_earnings_files_are_dealt_over_all_cores(spark, tmp_path):
    """A table of one row group has many splits, of which one holds all rows: one task parsed them all."""
    from tidemark.plans import earnings

    orders = spark.range(4000).selectExpr("id AS o_orderkey", "id % 50 AS o_custkey", "rand(1) * 1e5 AS o_totalprice", "timestamp_ntz '1995-01-01 00:00:00' AS o_orderdate", "uuid() AS filler")
    orders.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k, v in zip(old, ("16384", "1"), strict=True):
            spark.conf.set(k, v)
        tasks = [r["count"] for r in earnings.order_files(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(tasks) == 4000 and max(tasks) < 4000 / spark.sparkContext.defaultParallelism


def test_edges_of_cheap_tests_before_patterns(spark):
    """Rare line ends, links and blanks are treated as the patterns alone treat them."""
    unit = {"2026 Q1 1 2 3": True, "2026 Q1 1억 2 3": False, "억\u20282026 q1 1 2 3": True, "2026 Q1 1\u00852 3 4": False, "https://x.y/2026Q1?1,2,3,4 5 6 7": False, "억\r\n1Q26 1 2 3": True, "2026 1 2 3": False, None: None}
    texts = [" \t가\x0b나 \n\x0c", "가 \u2028", " \x1f가\x1f ", " \n "]
    rows = spark.createDataFrame([(t,) for t in unit], "text string").select("text", parser.unit_uncertain(F.col("text")).alias("u"), parser.cumulative_suspected(F.col("text")).alias("c")).collect()
    assert {r.text: r.u for r in rows} == unit and {r.c for r in rows} == {False, None}
    files = spark.createDataFrame(list(enumerate(texts)), "path long, text string")
    assert {r.path: r.text for r in parser.file_pieces(files).collect()} == {0: "가\x0b나", 1: "가\u2028", 2: "\x1f가\x1f", 3: ""}
    times = ["2026.07.17 15:30", "2026.07.17 15:30:05", "2026년 7월 17일", "2026.13.01", "내일"]
    got = spark.createDataFrame([(t,) for t in times], "t string").select(parser.disclosure_datetime(F.col("t")).cast("string").alias("d")).collect()
    assert [r.d for r in got] == ["2026-07-17 15:30:00", "2026-07-17 15:30:05", "2026-07-17 00:00:00", None, None]


def test_sources(spark, tmp_path):
    (tmp_path / "tree/005930").mkdir(parents=True)
    (tmp_path / "tree/005930/a.txt").write_bytes("가나".encode("cp949"))
    (tmp_path / "tree/005930/b.txt").write_bytes(b"\xef\xbb\xbfx")
    (tmp_path / "tree/005930/d.txt").write_bytes(b"\xef\xbb\xbfx")
    got = {r.path[-5:]: (r.folder_code, r.text, r.encoding, r.first_copy) for r in files.text_tree(spark, str(tmp_path / "tree")).collect()}
    assert got == {"a.txt": ("005930", "가나", "cp949", True), "b.txt": ("005930", "x", "utf-8-sig", True), "d.txt": ("005930", "x", "utf-8-sig", False)}
    (tmp_path / "x.json").write_text(json.dumps([{"code": "0008Z0", "n": 1}]))
    assert files.read_json(spark, [str(tmp_path / "none.json"), str(tmp_path / "x.json")], "code string, n long").first().code == "0008Z0"
    assert files.read_json(spark, str(tmp_path / "none.json"), "code string").count() == 0
    (tmp_path / "by").mkdir()
    (tmp_path / "by/005930.json").write_text(json.dumps({"items": [{"id": "a"}, {"id": "b"}]}))
    assert sorted((r.file_code, r.id) for r in files.read_envelopes(spark, str(tmp_path / "by"), "items", "id string").collect()) == [("005930", "a"), ("005930", "b")]
    cells = "".join(f"<td>{k}</td>" for k in range(10))
    (tmp_path / "list.xls").write_bytes(f"<table><tr>{'<th>h</th>' * 10}</tr><tr>{cells}</tr><tr><td>short</td></tr><tr>{cells.replace('9', '나')}</tr></table>".encode("euc-kr"))
    assert [(r.code, r.cells[9]) for r in files.html_listing(spark, str(tmp_path / "list.xls")).collect()] == [("2", "나")]
    (tmp_path / "env").write_text("# c\n\nA=1=2\n B = x \n")
    assert {(r.key, r.value) for r in files.env_pairs(spark, str(tmp_path / "env")).collect()} == {("A", "1=2"), ("B", "x")}
    assert [r.monitoring_tier for r in files.synthetic_companies(spark, 10).orderBy("stock_code").collect()] == ["core"] + ["watch"] * 4 + ["background"] * 5
    budgets = spark.createDataFrame([("a", 2), ("b", 9), ("c", 0)], "stock_code string, budget int")
    assert files.mock_provider(spark, budgets, 3, "2026-01-01").count() == 5


def test_data_sources(spark, tmp_path):
    files.register(spark)
    lines = [{"stock_code": "005930", "provider": "x", "title": f"t{k}", "url": "u", "published_at": f"2026-01-{k + 1:02d}"} for k in range(9)]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nbroken")
    rows = spark.read.format("tidemark_search").option("fixture", str(tmp_path / "s.jsonl")).option("start", "2026-01-03").option("end", "2026-01-05").load()
    assert sorted(r.title for r in rows.collect()) == ["t2", "t3", "t4"]
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps({"id": k, "date": "d", "text": f"m{k}"}) for k in range(1, 24)))
    stream = spark.readStream.format("tidemark_channel").option("fixture", str(tmp_path / "c.jsonl")).option("batch", "10").load()
    query = stream.writeStream.format("memory").queryName("channel").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.id for r in spark.table("channel").collect()) == list(range(1, 24))


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "stock_code string, v int")
    sinks.write_if_changed(first, path)
    again = spark.createDataFrame([("a", 2), ("a", 1), ("b", 4)], "stock_code string, v int")
    assert {r.stock_code for r in sinks.changed_partitions(again, path).collect()} == {"b"}
    sinks.write_if_changed(again, path)
    read = spark.read.schema("v int, stock_code string").parquet(path)
    assert sorted((r.stock_code, r.v) for r in read.collect()) == [("a", 1), ("a", 2), ("b", 4)]
    with pytest.raises(ValueError):
        sinks.assert_public(first.withColumn("_description", F.lit("x")))
    with pytest.raises(ValueError):
        sinks.assert_public(spark.createDataFrame([(5930,)], "stock_code long"))
    staged = str(tmp_path / "staged")
    first.write.parquet(staged)
    assert not sinks.publish(spark, staged, path, first.limit(1)) and sinks.publish(spark, staged, path, first.limit(0))
    assert sorted((r.stock_code, r.v) for r in spark.read.schema("v int, stock_code string").parquet(path).collect()) == [("a", 1), ("a", 2), ("b", 3)]
    assert sinks.with_templates(spark.createDataFrame([("a",), ("z",)], "stock_code string"), first).count() == 4


def test_poll_state_stream(spark, tmp_path):
    from tidemark.streaming.streams import poll_states

    runs = [("a", True, "2026-01-01 00:00:00", None), ("a", False, "2026-01-02 00:00:00", "timeout"), ("a", False, "2026-01-03 00:00:00", "429"), ("b", False, "2026-01-01 00:00:00", "x"), ("b", True, "2026-01-02 00:00:00", None)]
    spark.createDataFrame(runs, "code string, ok boolean, run_at string, error string").select("code", "ok", F.to_timestamp("run_at").alias("run_at"), "error").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("code string, ok boolean, run_at timestamp, error string").parquet(str(tmp_path / "in"))
    query = poll_states(stream, ["code"]).writeStream.outputMode("update").format("memory").queryName("polls").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    got = {r.code: (r.last_successful_run, r.consecutive_failures, r.last_error) for r in spark.table("polls").collect()}
    assert got == {"a": ("2026-01-01T00:00:00", 2, "429"), "b": ("2026-01-02T00:00:00", 0, None)}


def test_flows_on_empty_tables(spark, tmp_path):
    """Every flow and stream gives its columns and no rows where there is nothing to read."""
    from tidemark.plans import earnings, news
    from tidemark.sources import versions
    from tidemark.streaming import streams

    companies = spark.createDataFrame([], "stock_code string, company_name string, terms array<string>, aliases array<string>, requires_code boolean")
    out = flows.message_flow(spark.createDataFrame([], "id long, date string, text string"), companies)
    assert [out[k].count() for k in ("quarters", "disclosures", "quarantine", "companies", "totals")] == [0, 0, 0, 0, 1]
    done = earnings.earnings_run(spark.createDataFrame([], "path string, folder_code string, text string, encoding string, digest string"), companies)
    assert [done[k].count() for k in ("files", "companies", "quarters", "published", "totals")] == [0, 0, 0, 0, 1]
    raw = spark.createDataFrame([], "provider string, stock_code string, title string, description string, url string, published_at string, language string")
    run = news.news_run(raw, companies, F.lit("2026-01-01").cast("timestamp"), "2026-01-01")
    assert [run[k].count() for k in ("rejected", "repeated", "events", "index")] == [0, 0, 0, 0]
    path = str(tmp_path / "events")
    spark.createDataFrame([], "event_id long, user_id long, event_type string, value double, ts timestamp").write.parquet(path)
    assert streams.run_daily(spark, path).count() == 0 and streams.run_distinct(spark, path, ["user_id"]).count() == 0 and streams.run_upsert(spark, path, ["user_id"], "event_id", ["value"]).count() == 0
    old = spark.createDataFrame([], "code long, v string")
    assert versions.change_set(old, old, ["code"], ["v"]).count() == 0


def test_version_reads_and_changes(spark, tmp_path):
    from tidemark.sources import versions

    path = str(tmp_path / "v")
    rows = lambda *r: spark.createDataFrame(list(r), "code long, v string, w int")
    versions.write_version(rows((1, "a", 1), (2, None, 2)), path, 1, "2024-01-01 00:00:00")
    versions.write_version(rows((2, "b", 2), (3, "c", None)), path, 2, "2024-02-01 00:00:00")
    versions.write_version(rows((2, None, 5), (3, "c", None)), path, 2, "2024-02-01 00:00:00")  # written again
    assert versions.at_version(spark, path, 9).count() == 0 and versions.at_time(spark, path, "2023-01-01 00:00:00").count() == 0
    changes = versions.change_set(versions.at_version(spark, path, 1), versions.at_time(spark, path, "2024-03-01 00:00:00"), ["code"], ["v", "w"])
    assert sorted(tuple(r) for r in changes.collect()) == [(1, "removed", None, None, None), (2, "changed", "w", "2", "5"), (3, "added", None, None, None)]
    facts = spark.createDataFrame([(2, "2023-12-01 00:00:00"), (2, "2024-01-01 00:00:00"), (2, "2025-01-01 00:00:00"), (None, "2025-01-01 00:00:00")], "code long, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    got = versions.as_of(facts, versions.all_versions(spark, path), "code", "at", "committed_at", ["w"]).collect()
    assert sorted((str(r.at)[:4], r.w) for r in got if r.code) == [("2023", None), ("2024", 2), ("2025", 5)]
    kept, removed = versions.without_assignments(rows((1, "a", 1), (1, "b", 1), (2, "a", 1)), rows((1, "a", 0), (3, "a", 0)), "code", "v")
    assert sorted((r.code, r.v) for r in kept.collect()) == [(1, "b"), (2, "a")] and sorted(tuple(r) for r in removed.collect()) == [(1, 1), (3, 0)]


def test_names_stand_by_themselves_in_any_script(spark):
    """Against the pattern of each term, over texts of all scripts, particles, punctuation and case."""
    import re

    from tidemark.functions import codes
    from tidemark.operators.names import name_hits

    terms = ["東京電力", "Яндекс", "삼성전자", "AT&T", "A", "테스 코", "é", "삼성(주)", "K-Pop!", "電", "가", "a b c", "C++"]
    texts = [
        "新東京電力株", "X東京電力", "東京電力x", "東京電力 株", "яндекс", "Яндекса", "«ЯНДЕКС»", "яндекс1", "삼성전자는", "삼성전자은 삼성전자", "삼성전자주", "at&t!", "at&ta", "테스 코의 말", "테스  코", "É", "xé", "é", "삼성(주)는", "삼성(주)가나", "삼성(주)", "k-pop!!", "k-pop!x", "電力", "가는", "가 는", "나가",
        "a b c", "a b cd", "za b c", "", " ", "c++", "c++x", "xc++", "a\nb c", "A의", "가의", "가의나",
    ]
    lines = spark.createDataFrame(list(enumerate(texts)), "id int, line string")
    index = spark.createDataFrame([(t,) for t in [*terms, ""]], "term string")
    got = {(r.id, r.term) for r in name_hits(lines, index).collect()}

    def pattern(term):
        edge = "[^가-힣A-Za-z0-9]"
        behind = rf"(?=$|{edge}|(?:{'|'.join(codes.PARTICLES)})(?=$|{edge}))" if re.search("[가-힣]", term) else "(?![가-힣A-Za-z0-9])"
        return re.compile(rf"(?<![가-힣A-Za-z0-9]){re.escape(term)}{behind}", re.IGNORECASE)

    assert got == {(k, t) for k, text in enumerate(texts) for t in terms if pattern(t).search(text)}
    assert name_hits(lines, index.limit(0)).count() == 0


def test_legacy_clusters_on_known_rows(spark):
    """Official source, four keywords, three media, fresh: 100; far titles and far times apart; reasons and ids as published."""
    import hashlib

    from tidemark.plans import legacy

    companies = spark.createDataFrame([("000660", "SK하이닉스", ["SK하이닉스"], ["SK hynix"], ["skhynix.com"], ["reuters.com"], ["HBM", "DRAM", "투자", "공급"], ["추천"])], "stock_code string, company_name string, aliases array<string>, english_aliases array<string>, official_sources array<string>, major_source_domains array<string>, important_keywords array<string>, excluded_keywords array<string>")
    items = [
        ("SK하이닉스 HBM DRAM 투자 공급 확대", "https://news.skhynix.com/a?utm_source=x", "20260717T020000Z", None), ("SK하이닉스 HBM DRAM 투자 공급 확대 발표", "https://www.reuters.com/b", "20260717T010000Z", "English"), ("SK하이닉스 HBM DRAM 투자 공급 확대!", "https://c.example/c", "20260716T010000Z", "Korean"),
        ("SK하이닉스 HBM DRAM 투자 공급 확대", "https://d.example/d", "20260601T000000Z", ""), ("SK hynix quarterly profit", "https://e.example/e", "bad", None),
    ]
    raw = spark.createDataFrame([("000660", *r) for r in items], "stock_code string, title string, url string, seendate string, language string")
    articles = legacy.legacy_articles(raw, companies, "2026-07-18")
    assert articles.columns == ["title", "url", "source_domain", "published_at", "language", "matched_alias", "company_name", "stock_code", "source_type", "collected_at"]
    found = {r.representative_url: r for r in legacy.public_clusters(articles, companies, F.lit("2026-07-17 10:00:00").cast("timestamp")).collect()}
    assert set(found) == {"https://news.skhynix.com/a", "https://d.example/d", "https://e.example/e"}
    best = found["https://news.skhynix.com/a"]
    assert (best.importance_score, best.importance_level, best.source_count, best.published_at, best.language) == (100, "critical", 3, "2026-07-17T02:00:00Z", "Unknown")
    assert best.scoring_reasons == ["공식 기업·기관 출처 +40", "회사명이 제목에 정확히 등장 +15", "핵심 키워드 4개 +20", "서로 다른 3개 이상 매체 보도 +15", "최근 24시간 기사 +10"]
    assert best.cluster_id == hashlib.sha256("000660|sk하이닉스 hbm dram 투자 공급 확대".encode()).hexdigest()[:16]
    assert found["https://e.example/e"].published_at is None and found["https://e.example/e"].importance_score == 15


def test_roots_settings_and_private_samples(spark, tmp_path):
    new, old = str(tmp_path / "new"), str(tmp_path / "old")
    assert files.input_root(spark, new, old) == new
    (tmp_path / "old/notes").mkdir(parents=True)
    assert files.input_root(spark, new, old) == new
    (tmp_path / "old/0008Z0").mkdir()
    assert files.input_root(spark, new, old) == old
    (tmp_path / "new").mkdir()
    assert files.input_root(spark, new, old) == new
    (tmp_path / "c.json").write_text('{"retention":\n {"low": 5}, "x": null}')
    assert files.read_config(spark, str(tmp_path / "c.json"), {"retention": {"low": 14, "material": 90}, "x": 1, "y": 2}) == {"retention": {"low": 5, "material": 90}, "x": None, "y": 2}
    path = str(tmp_path / "private")
    rows = lambda *r: spark.createDataFrame(list(r), "stock_code string, id long, text string")
    sinks.write_private_samples(rows(("005930", 1, "a\nb\n"), ("005930", 2, None), ("0008Z0", 3, "c")), path)
    sinks.write_private_samples(rows(("005930", 2, "again")), path)
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    try:
        assert sorted((r.stock_code, r.id, r.text) for r in sinks.read_private_samples(spark, path).collect()) == [("0008Z0", "3", "c"), ("005930", "1", "a\nb\n"), ("005930", "2", "again")]
    finally:
        spark.conf.unset("spark.sql.sources.partitionColumnTypeInference.enabled")


def test_message_flow_builds_the_named_tables_only(spark, sf_dir):
    from tidemark.plans import portfolio

    whole = portfolio.run_results(spark, sf_dir)
    for name in ("quarters", "disclosures"):
        one = portfolio.run_results(spark, sf_dir, name)
        assert list(one) == [name]
        assert sorted(map(tuple, one[name].collect()), key=repr) == sorted(map(tuple, whole[name].collect()), key=repr)


def test_rejects_of_a_news_run_write_no_articles(spark, sf_dir, monkeypatch):
    """What only the index needs is left out where the rejects are asked for, and the other way round."""
    written = []
    monkeypatch.setattr(news, "stored", lambda df, name="table", store=news.stored: (written.append(name), store(df, name))[1])
    assert news.news_rejects(spark, sf_dir).count() > 0
    assert written == ["companies"]


def test_counts_of_a_message_run_pick_no_versions(spark, sf_dir, monkeypatch):
    """Counts of companies alone are those of a whole run, without versions, histories, labels or texts (all were made and written)."""
    from tidemark.plans import portfolio

    whole = sorted(map(tuple, portfolio.run_results(spark, sf_dir)["companies"].collect()))
    kept = []
    monkeypatch.setattr(flows, "final_quarters", None)
    monkeypatch.setattr(flows, "stored", lambda df, name="table", write=flows.stored: kept.append((name, df)) or write(df, name))
    assert sorted(map(tuple, portfolio.run_results(spark, sf_dir, "companies")["companies"].collect())) == whole
    assert [name for name, _ in kept] == ["routes", "judged"]
    assert "regexp_replace(url" not in kept[1][1]._jdf.queryExecution().optimizedPlan().toString()


def test_conflicts_are_those_of_final_quarters(spark):
    """A value beside none is a conflict, equal values and none beside none are not."""
    amount = lambda v: None if v is None else (str(v), v)
    won = "struct<raw:string,value_won:bigint>"
    cases = {1: [(5, None), (5, None)], 2: [(5, None), (None, None)], 3: [(None, None), (None, None)], 4: [(5, 7), (5, 8)], 5: [(5, 7)], 6: [(0, None), (-5, None), (0, None)]}
    rows = [(10 * quarter + k, f"c{code}", f"{2010 + quarter}.03", amount(a), amount(b)) for code in (1, 2) for quarter, values in [*cases.items(), *[(q, [(1, 1)]) for q in range(7, 7 + 3 * code)]] for k, (a, b) in enumerate(values)]
    parsed = spark.createDataFrame(rows, f"id long, stock_code string, report_period string, revenue_actual {won}, revenue_consensus {won}")
    nothing = {f"{m}_{k}": F.lit(None).cast(won) for m in ("operating_profit", "net_income") for k in ("actual", "consensus")}
    recent = F.lit(None).cast(f"array<struct<pos:int,fiscal_quarter:string,revenue:{won},operating_profit:{won},net_income:{won}>>")
    text = {c: F.lit(None).cast("string") for c in ("report_name", "dart_url", "dart_receipt_number", "disclosure_datetime")}
    parsed = parsed.withColumns({**nothing, **text, "provisional": F.lit(False), "classification": F.lit("earnings"), "has_earnings_data": F.lit(True), "recent_earnings": recent})
    want = sorted((r.stock_code, r.fiscal_quarter, r.conflict) for r in flows.final_quarters(parsed).collect())
    assert sorted(map(tuple, flows.quarter_conflicts(parsed).select("stock_code", "fiscal_quarter", "conflict").collect())) == want
    assert {w[2] for w in want} == {True, False} and len(want) == 16


def test_blanks_are_not_looked_up_as_names(spark):
    """Only places of a length that names begin with are looked up; blanks of all texts met in one task."""
    from tidemark.operators import names

    lines = spark.createDataFrame([(1, "ab  cd, abc 가나는 x abcd e-fg"), (2, " , . ")], "id int, line string")
    assert sorted(r.w[0] for r in names._places(lines, ["id"], 2, 2, 2).collect()) == ["ab", "abc", "cd", "fg", "가나는"]
    terms = spark.createDataFrame([("cd",), ("가나",), ("cd, abc",), ("e-fg",), ("b",)], "term string")
    assert sorted(map(tuple, names.name_hits(lines, terms).collect())) == [(1, "cd"), (1, "cd, abc"), (1, "e-fg"), (1, "가나")]
