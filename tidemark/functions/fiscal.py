"""Fiscal quarters, money and growth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The units of money texts, and growth labels.
UNITS = {"조": 10**12, "억": 10**8, "백만": 10**6, "천": 10**3}
TURNED_POSITIVE, TURNED_NEGATIVE, LOSS_SMALLER, LOSS_LARGER, LOSS_EQUAL, NO_CHANGE = "흑자전환", "적자전환", "적자축소", "적자확대", "적자지속", "변동 없음"


def quarter_index(year: Column, quarter: Column) -> Column:
    return (year * 4 + quarter - 1).cast("int")


def quarter_label(index: Column) -> Column:
    return F.concat(F.floor(index / 4).cast("string"), F.lit(" Q"), (F.pmod(index, F.lit(4)) + 1).cast("string"))


def quarter_of(first: Column) -> Column:
    """'2026 Q1' of a quarter text as it stands, null of an empty one."""
    long = F.concat(F.substring(first, 1, 4), F.lit(" Q"), F.regexp_extract(F.substring(first, 5, 20), "([1-4])", 1))
    short = F.concat(F.lit("20"), F.regexp_extract(first, r"(\d{2})$", 1), F.lit(" Q"), F.substring(first, 1, 1))
    return F.when(F.rlike(first, F.lit(r"^20\d{2}")), long).when(first != "", short)


def normalize_quarter(text: Column) -> Column:
    """'2026.1Q', '2026 Q1' and '1Q26' as '2026 Q1': the first of any form; null if none."""
    return quarter_of(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)20\d{2}\s*[./ -]?\s*(?:[1-4]\s*Q|Q\s*[1-4])|[1-4]\s*Q\s*\d{2}", 0))


def label_index(label: Column) -> Column:
    """Ordinal of '2026 Q1', -1 if it is none."""
    quarter = normalize_quarter(label)
    return F.coalesce(F.substring(quarter, 1, 4).cast("int") * 4 + F.substring(quarter, 7, 1).cast("int") - 1, F.lit(-1))


def month_quarter(month: Column) -> Column:
    return F.floor((month - 1) / 3) + 1


def compact_amount(raw: Column) -> Column:
    return F.upper(F.regexp_replace(raw, r"\s+", ""))


def parse_amount(raw: Column, negative_parentheses: bool = True) -> Column:
    """Won (bigint) of a money text; parentheses are a minus sign, or nothing in forecasts; null if unreadable."""
    return compact_value(compact_amount(raw), negative_parentheses)


def compact_value(compact: Column, negative_parentheses: bool = True) -> Column:
    """Won of a money text without blanks (``compact_amount``)."""
    wrapped = F.startswith(compact, F.lit("(")) & F.endswith(compact, F.lit(")"))
    inner = F.when(wrapped, F.substring(compact, F.lit(2), F.length(compact) - 2)).otherwise(compact)
    pattern = r"^([+-]?[\d,]+(?:\.\d+)?)(조|억|백만|천)원?$"
    number = F.nullif(F.replace(F.regexp_extract(inner, pattern, 1), F.lit(","), F.lit("")), F.lit("")).try_cast("decimal(28,10)")
    if negative_parentheses:
        number = F.when(wrapped, -F.abs(number)).otherwise(number)
    scales = F.create_map(*[v for name, factor in UNITS.items() for v in (F.lit(name), F.lit(factor).cast("decimal(14,0)"))])
    return (number * F.try_element_at(scales, F.regexp_extract(inner, pattern, 2))).try_cast("bigint")


def growth_label(current: Column, previous: Column) -> Column:
    """Label of a sign change, 'percentage' where a percentage applies, null without a base."""
    return (
        F.when(current.isNull() | previous.isNull() | (previous == 0), F.lit(None).cast("string"))
        .when((previous < 0) & (current > 0), TURNED_POSITIVE)
        .when((previous > 0) & (current < 0), TURNED_NEGATIVE)
        .when((previous < 0) & (current < 0) & (current > previous), LOSS_SMALLER)
        .when((previous < 0) & (current < 0) & (current < previous), LOSS_LARGER)
        .when((previous < 0) & (current < 0), LOSS_EQUAL)
        .otherwise("percentage")
    )


def growth_percentage(current: Column, previous: Column) -> Column:
    return F.when(growth_label(current, previous) == "percentage", (current - previous) * 100.0 / F.abs(previous))


def display_label(current: Column, previous: Column) -> Column:
    """The dashboard's rule: a zero base is a turn as well."""
    return (
        F.when(current.isNull() | previous.isNull(), "-")
        .when(previous == 0, F.when(current > 0, TURNED_POSITIVE).when(current < 0, TURNED_NEGATIVE).otherwise(NO_CHANGE))
        .when((previous < 0) & (current > 0), TURNED_POSITIVE)
        .when((previous > 0) & (current < 0), TURNED_NEGATIVE)
        .when((previous < 0) & (current < 0), F.when(current > previous, LOSS_SMALLER).when(current < previous, LOSS_LARGER).otherwise(LOSS_EQUAL))
        .otherwise("percentage")
    )


def to_eok(won: Column) -> Column:
    """Won in units of 100 million."""
    return won / F.lit(100_000_000)
