"""Stock codes in messages: extraction by priority and routing."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import URL_PATTERN

# How codes are written in messages.
CODE = r"(?i)(?<![A-Z0-9])A?((?=[A-Z0-9]{0,5}\d)[A-Z0-9]{6})(?![A-Z0-9])"
LABELED_CODE = r"(?im)^\s*(?:종목코드|종목\s*코드)\s*[:：]\s*A?((?=[A-Z0-9]{0,5}\d)[A-Z0-9]{6})(?![A-Z0-9])"
COMPANY_FIELD = r"(?im)^\s*(?:기업명|회사명|종목명)\s*[:：]\s*([^\n]+)"
URL_CODE = r"(?i)[?&](?:code|stock_code|stockcode)=A?((?=[A-Z0-9]{0,5}\d)[A-Z0-9]{6})(?![A-Z0-9])"
BLOCKED_LINE = r"계약\s*상대|거래\s*상대|원고(?:이름|명)?|피고(?:이름|명)?|비교기업|경쟁사|연구원|기관명"
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
PARTICLES = ["은", "는", "이", "가", "와", "과", "을", "를", "의", "도", "에"]
CORRECTION = "정정(?:공시|보고서|신고서)?"
EARNINGS_MARKERS = [r"매출\s*액?", r"영업\s*(?:익|이익)", r"순\s*(?:익|이익)", r"최근\s*실적\s*추이", r"잠정\s*실적"]
DISCLOSURE = r"(?i)공시|보고서|신고서|DART|dart\.fss\.or\.kr"


def _distinct(found: Column) -> Column:
    return F.array_distinct(F.transform(found, lambda c: F.upper(c)))


def holds(text: Column, *words: str) -> Column:
    """Whether a text has one of some words: cheap to ask before a pattern that needs one of them."""
    return reduce(or_, [F.contains(text, F.lit(w)) for w in words])


def codes_by_level(text: Column) -> Column:
    """Struct (source, codes) of the first level with a code: labelled, company line, URL query, standalone."""
    value = F.coalesce(text, F.lit(""))
    every = lambda where, pattern, *words: _distinct(F.regexp_extract_all(F.when(holds(value, *words), where).otherwise("") if words else where, F.lit(pattern), F.lit(1)))
    fields = F.array_join(F.regexp_extract_all(value, F.lit(COMPANY_FIELD), F.lit(1)), "\n")
    urls = F.array_join(F.regexp_extract_all(value, F.lit(URL_PATTERN), F.lit(0)), "\n")
    outside = F.when(holds(value, "://"), F.regexp_replace(value, URL_PATTERN, " ")).otherwise(value)
    found = {
        "labeled_stock_code": every(value, LABELED_CODE, "종목"), "company_name_field": every(fields, CODE, "기업명", "회사명", "종목명"),
        "url_query_code": every(urls, URL_CODE, "://"), "standalone_code": every(outside, CODE),
    }
    none = F.struct(F.lit(None).cast("string").alias("source"), F.array().cast("array<string>").alias("codes"))
    # a level is looked at only where those before it have no code, and patterns where a word they need is there
    level = lambda name, codes: F.get(F.transform(F.array(codes), lambda c: F.when(F.size(c) > 0, F.struct(F.lit(name).alias("source"), c.alias("codes")))), F.lit(0))
    return F.coalesce(*[level(*f) for f in found.items()], none)


def searchable_text(text: Column) -> Column:
    """Without URLs and mail addresses, runs of blanks as one."""
    value = F.coalesce(text, F.lit(""))
    linkless = F.when(holds(value, "://"), F.regexp_replace(value, URL_PATTERN, " ")).otherwise(value)
    bare = F.when(holds(value, "@"), F.regexp_replace(linkless, r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", " ")).otherwise(linkless)
    return F.regexp_replace(bare, r"[ \t]+", " ")


def company_fields(text: Column) -> Column:
    """What stands in each company field."""
    return F.regexp_extract_all(searchable_text(text), F.lit(COMPANY_FIELD), F.lit(1))


def fallback_lines(text: Column) -> Column:
    """Lines that name no counter-party, without URLs and mail addresses."""
    return F.filter(F.split(searchable_text(text), LINE_END), lambda line: ~F.rlike(line, F.lit(BLOCKED_LINE)))


def term_pattern(term: Column) -> Column:
    """Pattern of a name standing by itself; a Korean name may have a particle behind it."""
    edge = "[^가-힣A-Za-z0-9]"
    particle = F.lit(rf"(?=$|{edge}|(?:{'|'.join(PARTICLES)})(?=$|{edge}))")
    behind = F.when(F.rlike(term, F.lit("[가-힣]")), particle).otherwise(F.lit("(?![가-힣A-Za-z0-9])"))
    return F.concat(F.lit(r"(?iu)(?<![가-힣A-Za-z0-9])\Q"), term, F.lit(r"\E"), behind)


def message_kind(text: Column) -> Column:
    """correction, earnings (two markers, or trend or provisional), disclosure or unknown."""
    value = F.coalesce(text, F.lit(""))  # line ends are blanks to these patterns, however they are written
    marked = [holds(value, p[:2].rstrip("\\")) & F.rlike(value, F.lit(p)) for p in EARNINGS_MARKERS]  # each begins with a word
    markers = sum((m.cast("int") for m in marked), F.lit(0))
    return (
        F.when(holds(value, CORRECTION[:2]) & F.rlike(value, F.lit(CORRECTION)), "correction")
        .when((markers >= 2) | marked[3] | marked[4], "earnings")
        .when(holds(value, *DISCLOSURE[4:].split("|")[:3]) | F.rlike(value, F.lit(DISCLOSURE)), "disclosure")
        .otherwise("unknown")
    )
