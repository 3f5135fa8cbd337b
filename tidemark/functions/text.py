"""URL, title and text columns: canonical forms, tokens, keyword rules, redaction."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the news rules.
TRACKING_KEYS = ["fbclid", "gclid", "mc_cid", "mc_eid", "ref", "source", "campaign"]
AMBIGUOUS_ALIASES = ["sk", "hynix"]
STOPWORDS = ["the", "and", "for", "with", "from", "that", "this", "into", "amid", "says", "will", "sk", "hynix", "하이닉스", "대한", "관련", "통해"]
MARKET_ROUNDUP_TERMS = ["증시", "코스피", "코스닥", "마감", "장중", "종목 추천", "급등주", "top stocks", "stocks to watch", "stock picks", "market roundup", "price target", "목표주가", "레버리지 상품", "외국인 순매수", "외국인 순매도", "거래소 외국인", "관련주 상승", "테마주"]
STOCK_NOISE_TERMS = ["주가", "주식", "급등락", "변동성", "목표주가", "투자자", "보유", "팔지 말고", "shares down", "shares up", "plunges", "bullish signal", "stock market", "price target", "stock picks", "stocks to buy", "would be worth", "investors", "prediction", "leveraged etf", "bull 2x etf", "adr volatility"]
OTHER_COMPANY_MARKERS = ["samsung", "tsmc", "nvidia", "apple", "meta", "alphabet", "spacex"]
CATEGORY_RULES = [
    ("실적", ["실적", "earnings", "profit", "revenue", "매출", "영업이익"]),
    ("투자·생산", ["투자", "investment", "capex", "fab", "공장", "생산", "capacity"]),
    ("기술·제품", ["hbm", "dram", "nand", "memory", "메모리", "제품", "chip"]),
    ("공급·규제", ["공급", "계약", "수출", "규제", "export", "supply", "contract", "regulation"]),
    ("인사·M&A", ["인사", "대표", "ceo", "appoint", "acquisition", "인수", "합병"]),
    ("주가·투자의견", ["주가", "목표주가", "stock", "shares", "price target", "etf"]),
]
TITLE_CATEGORY_RULES = [
    ("실적", ["실적", "earnings", "profit", "revenue"]),
    ("투자·생산", ["투자", "fab", "공장", "생산", "capacity"]),
    ("기술·제품", ["hbm", "dram", "nand", "memory", "메모리", "제품"]),
    ("공급망·규제", ["수출", "규제", "export", "supply", "공급"]),
    ("인사·M&A", ["인수", "합병", "ceo", "appoint", "acquisition"]),
    ("주가·투자판단", ["주가", "목표주가", "stock", "shares", "price target"]),
]
SIGNAL_GROUPS = {
    "investment": ["투자", "investment", "capex", "시설투자"],
    "production": ["생산", "mass production", "양산", "capacity", "fab", "공장"],
    "supply": ["공급", "supply", "contract", "계약", "납품"],
    "regulation": ["규제", "regulation", "export control", "수출 통제", "법안", "lawsuit"],
    "earnings": ["실적", "earnings", "revenue", "profit", "매출", "영업이익"],
    "personnel": ["인사", "대표이사 선임", "appoint", "appointed", "nomination", "취임"],
    "executive": ["ceo", "회장", "chairman", "chief", "최태원", "chey tae won", "chey tae-won"],
    "shareholder_message": ["팔지 말고", "갖고 있어라", "갖고 있으면", "보유", "사서 가만히", "hold onto your shares", "hold your shares", "keep your shares"],
    "hbm": ["hbm", "고대역폭메모리"],
    "dram": ["dram", "디램"],
    "nand": ["nand", "낸드"],
    "ai_memory": ["ai memory", "ai 메모리", "memory as a service"],
    "m_and_a": ["인수", "합병", "acquisition", "merger", "m&a"],
}
SIGNAL_AMOUNT = r"(?:usd|krw|\$|₩)?\s?\d+(?:\.\d+)?\s?(?:억|조|million|billion|%|gb|tb)"
SIGNAL_PERIOD = r"\b(?:20\d{2}|q[1-4]|hbm\d+)\b"
MATERIAL_SIGNALS = ["investment", "production", "supply", "regulation", "earnings", "personnel", "m_and_a"]
STOCK_NOISE = ["주가", "목표주가", "종목 추천", "급등", "shares up", "shares down", "price target", "stock picks", "etf"]
URL_PATTERN = r"(?i)https?://[^\s<>()]+"
EMAIL_PATTERN = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
PHONE_PATTERN = r"(?<!\d)(?:\+82[- ]?10|010)[- ]\d{3,4}[- ]\d{4}(?!\d)"


@F.pandas_udf(StringType())
def unescaped_nfkc(values: pd.Series) -> pd.Series:
    """HTML entities resolved, then NFKC: neither is a built-in function."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", html.unescape(v)))


@F.pandas_udf(StringType())
def unescaped(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else html.unescape(v))


def text_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def canonical_domain(value: Column) -> Column:
    """Trimmed, lower case, cut at the first colon, without a leading www."""
    return F.regexp_replace(F.split_part(F.lower(F.trim(F.coalesce(value, F.lit("")))), F.lit(":"), F.lit(1)), r"^www\.", "")


def domain_in(domain: Column, candidates: Column) -> Column:
    """The domain is a candidate or below one."""
    own = canonical_domain(domain)
    return F.exists(candidates, lambda c: (own == canonical_domain(c)) | F.endswith(own, F.concat(F.lit("."), canonical_domain(c))))


def normalize_url(value: Column) -> Column:
    """https URL without tracking keys, fragment, port and double or closing slashes, its query sorted; '' if not http(s)."""
    text = F.trim(F.coalesce(value, F.lit("")))
    plain = F.split_part(text, F.lit("#"), F.lit(1))
    base = F.split_part(plain, F.lit("?"), F.lit(1))
    host = F.regexp_extract(base, r"^(?i:https?)://([^/]+)", 1)
    path = F.regexp_replace(F.regexp_replace(base, r"^(?i:https?)://[^/]+", ""), "/{2,}", "/")
    path = F.when(path.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(path, "/+$", ""))
    query = F.when(F.locate("?", plain) > 0, F.substring(plain, F.locate("?", plain) + 1, F.length(plain))).otherwise(F.lit(""))

    def kept(part: Column) -> Column:
        key = F.lower(F.split_part(part, F.lit("="), F.lit(1)))
        return (part != "") & ~F.startswith(key, F.lit("utm_")) & ~key.isin(TRACKING_KEYS)

    pairs = F.transform(F.filter(F.split(query, "&"), kept), lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("k"), F.when(F.locate("=", p) > 0, F.substring(p, F.locate("=", p) + 1, F.length(p))).otherwise(F.lit("")).alias("v")))
    # percent codes and plus signs are read and written anew
    code = lambda x: F.replace(F.url_encode(F.coalesce(F.try_url_decode(x), x)), F.lit("*"), F.lit("%2A"))
    sorted_pairs = F.array_sort(F.transform(pairs, lambda s: F.struct(F.coalesce(F.try_url_decode(s["k"]), s["k"]).alias("k"), F.coalesce(F.try_url_decode(s["v"]), s["v"]).alias("v"))))
    encoded = F.array_join(F.transform(sorted_pairs, lambda s: F.concat(code(s["k"]), F.lit("="), code(s["v"]))), "&")
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.lit("https://"), canonical_domain(host), path, F.when(encoded == "", F.lit("")).otherwise(F.concat(F.lit("?"), encoded))))


def normalize_title(value: Column, resolved: Callable[[Column], Column] = unescaped_nfkc) -> Column:
    """Entities and NFKC resolved, lower case, without a closing publisher, only 0-9 a-z and Hangul."""
    text = F.trim(F.lower(resolved(F.coalesce(value, F.lit("")))))
    text = F.regexp_replace(text, r"\s+[|\-–—]\s+[^|\-–—]{2,40}$", "")
    return F.trim(F.regexp_replace(text, "[^0-9a-z가-힣]+", " "))


def title_tokens(normalized: Column) -> Column:
    """Distinct tokens of two and more characters that are no stop words, in order of appearance."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(normalized, F.lit("[a-z0-9]{2,}|[가-힣]{2,}"), F.lit(0))), text_array(STOPWORDS))


def valid_aliases(aliases: Column) -> Column:
    return F.filter(F.transform(aliases, lambda a: F.trim(a)), lambda a: (a != "") & ~F.lower(a).isin(AMBIGUOUS_ALIASES))


def alias_in_title(title: Column, alias: Column) -> Column:
    """A Hangul alias as it is, another one between no letters or digits, in any case."""
    quoted = F.concat(F.lit(r"(?i)(?<![A-Za-z0-9])\Q"), alias, F.lit(r"\E(?![A-Za-z0-9])"))
    return (alias != "") & F.when(F.rlike(alias, F.lit("[가-힣]")), F.contains(title, alias)).otherwise(F.rlike(title, quoted))


def longest_alias(title: Column, aliases: Column) -> Column:
    """The longest alias in the title, the first of equals; null if none."""
    found = F.filter(valid_aliases(aliases), lambda a: alias_in_title(title, a))
    return F.aggregate(found, F.lit(None).cast("string"), lambda best, a: F.when(best.isNull() | (F.length(a) > F.length(best)), a).otherwise(best))


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    out = F.lit(False)
    for term in terms:
        out = out | F.contains(text, F.lit(term))
    return out


def ruled_categories(normalized: Column, rules: Sequence[tuple[str, Sequence[str]]] = CATEGORY_RULES, default: str = "기타") -> Column:
    """Labels of all rules with a term in the text, or the default."""
    labels = F.filter(F.array(*[F.when(contains_any(normalized, terms), F.lit(label)) for label, terms in rules]), lambda x: x.isNotNull())
    return F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit(default)))


def _plain(term: str) -> str:
    return term.replace("&", " ").replace("-", " ")


def event_signals(normalized: Column) -> Column:
    """Sorted names of keyword groups, amounts and periods in a normalised title."""
    groups = F.array(*[F.when(contains_any(normalized, [_plain(t) for t in terms]), F.lit(name)) for name, terms in SIGNAL_GROUPS.items()])
    found = F.concat(F.filter(groups, lambda x: x.isNotNull()), F.regexp_extract_all(normalized, F.lit(SIGNAL_AMOUNT), F.lit(0)), F.regexp_extract_all(normalized, F.lit(SIGNAL_PERIOD), F.lit(0)))
    return F.array_sort(F.array_distinct(found))


def closed_entities(value: Column, entities: dict[str, str]) -> Column:
    """The named entities resolved one after the other, those only that end in a semicolon: others, and what is cut off, are text."""
    for name, character in entities.items():
        value = F.replace(value, F.lit(f"&{name};"), F.lit(character))
    return value


def clean_markup(value: Column, resolved: Callable[[Column], Column] = unescaped) -> Column:
    """Entities resolved (all that HTML knows, as the source does), tags to spaces, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(resolved(F.coalesce(value, F.lit(""))), "<[^>]+>", " "), r"\s+", " "))


def redacted(text: Column) -> Column:
    """URLs, mail addresses and phone numbers replaced by tags, white space collapsed."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, URL_PATTERN, "[URL]"), EMAIL_PATTERN, "[EMAIL]"), PHONE_PATTERN, "[PHONE]")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def context_of(text: Column, term: Column | None = None, pattern: Column | None = None) -> Column:
    """60 characters of the redacted text: from its start, or from 30 before the term where its pattern is found."""
    clean = redacted(F.coalesce(text, F.lit("")))
    if term is None:
        return F.substring(clean, 1, 60)
    at = F.regexp_instr(clean, pattern)
    start = F.greatest(at - 30, F.lit(1))
    around = F.substr(clean, start, at + F.length(term) + 30 - start)
    return F.substring(F.when(at > 0, around).otherwise(clean), 1, 60)


def context_round(text: Column, term: Column) -> Column:
    """60 characters of the redacted text from 30 before the first place of the term, in any case; from its start where it is not there."""
    clean = redacted(F.coalesce(text, F.lit("")))
    return F.substr(clean, F.greatest(F.instr(F.lower(clean), F.lower(term)) - 30, F.lit(1)), F.lit(60))


def article_id(provider: Column, url: Column, title: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("None")) for c in (provider, url, title)]), 256), 1, 20)


def importance_level(score: Column) -> Column:
    return F.when(score >= 80, "critical").when(score >= 60, "important").when(score >= 40, "watch").otherwise("low")
