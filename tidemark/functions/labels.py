"""Report categories and short labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any

# Report name rules in order.
EARNINGS = "earnings"
EARNINGS_NAMES = ["연결재무제표기준영업(잠정)실적", "영업(잠정)실적", "연결재무제표기준영업실적", "매출액또는손익구조30%", "잠정실적", "실적공시", "분기실적", "연간실적"]
FINANCIAL_REPORTS = ["사업보고서", "분기보고서", "반기보고서"]
CATEGORIES = [
    (EARNINGS, EARNINGS_NAMES),
    ("시설투자", ["시설", "투자"]),
    ("공급계약", ["공급", "계약"]),
    ("자사주·배당", ["자사주", "배당", "자기주식"]),
    ("증자·사채", ["증자", "사채", "전환사채", "신주"]),
    ("지분", ["지분", "주식등의대량보유", "임원ㆍ주요주주"]),
]
LATEST = [
    ("실적", ["연결재무제표기준영업잠정실적", "영업잠정실적", "연결재무제표기준영업실적", "잠정실적", "실적공시", "분기실적", "연간실적"]),
    ("공급계약", ["단일판매공급계약체결", "공급계약체결"]),
    ("수주", ["수주계약", "수주"]),
    ("시설투자", ["신규시설투자", "시설투자"]),
    ("자사주매입", ["자기주식취득", "자기주식취득신탁계약"]),
    ("자사주처분", ["자기주식처분"]),
    ("배당", ["배당"]),
    ("유상증자", ["유상증자결정"]),
    ("무상증자", ["무상증자결정"]),
    ("CB발행", ["전환사채권발행결정"]),
    ("BW발행", ["신주인수권부사채권발행결정"]),
    ("EB발행", ["교환사채권발행결정"]),
    ("지분매각", ["타법인주식및출자증권처분결정"]),
    ("지분투자", ["타법인주식및출자증권취득결정"]),
    ("영업양수도", ["영업양수", "영업양도"]),
    ("M&A", ["합병", "분할"]),
    ("최대주주변경", ["최대주주변경"]),
    ("소송", ["소송등의제기", "소송"]),
]
# report names by which the fixture's part types stand for reports
ANALOG = {"STANDARD": "분기실적", "SMALL": "공급계약체결", "MEDIUM": "신규 시설투자", "LARGE": "자기주식취득", "ECONOMY": "유상증자결정", "PROMO": "합병"}


def analog(value: Column) -> Column:
    for word, name in ANALOG.items():
        value = F.replace(value, F.lit(word), F.lit(name))
    return value


def analog_sql(column: str) -> str:
    for word, name in ANALOG.items():
        column = f"replace({column}, '{word}', '{name}')"
    return column


def disclosure_category(name: Column, has_earnings: Column) -> Column:
    """Category of a report name; periodic reports are results only where earnings were found."""
    tight = F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", "")
    out = F.when(contains_any(tight, EARNINGS_NAMES) | (has_earnings & contains_any(tight, FINANCIAL_REPORTS)), EARNINGS)
    for label, terms in CATEGORIES[1:]:
        out = out.when(contains_any(F.coalesce(name, F.lit("")), terms), label)
    return out.otherwise("기타")


def latest_type(name: Column) -> Column:
    """Short label of a report title; null for blank titles."""
    tight = F.lower(F.regexp_replace(name, "[^0-9A-Za-z가-힣]", ""))
    out = F.when(F.trim(F.coalesce(name, F.lit(""))) == "", F.lit(None).cast("string"))
    for label, terms in LATEST:
        out = out.when(contains_any(tight, terms), label)
    return out.otherwise("기타")
