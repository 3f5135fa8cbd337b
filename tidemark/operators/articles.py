"""Articles: relevance ladder, de-duplication, event clusters, scores."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as T
from .graph import least_labels, stored


def reject_reason(*, title: Column, normalized: Column, url: Column, aliases: Column, excluded: Column, ambiguous: Column, context: Column, spread: bool = True) -> Column:
    """First reason of the relevance ladder that holds, null for relevant articles.

    ``excluded``: longer terms of other companies, taken out of the title one after the other, in any case and, where they may be
    ``spread``, with any white space between their characters, before aliases are looked for; ``context``: whether an ambiguous company has its code, a keyword or an official source.
    """
    quoted = lambda e: F.concat(F.lit(r"\Q"), e, F.lit(r"\E"))
    spaced = lambda e: F.array_join(F.transform(F.filter(F.split(e, ""), lambda c: c != ""), quoted), r"\s*") if spread else quoted(e)
    stripped = F.aggregate(F.filter(excluded, lambda e: e != ""), title, lambda text, e: F.regexp_replace(text, F.concat(F.lit("(?iu)"), spaced(e)), F.lit(" ")))
    alias = T.longest_alias(stripped, aliases)
    others = sum((F.contains(normalized, F.lit(m)).cast("int") for m in T.OTHER_COMPANY_MARKERS), F.lit(0))
    return (
        F.when(F.trim(F.coalesce(title, F.lit(""))) == "", "missing_title")
        .when(T.normalize_url(url) == "", "invalid_url")
        .when(alias.isNull() & (stripped != title), "other_portfolio_company_in_title")
        .when(alias.isNull(), "company_alias_not_in_title")
        .when(ambiguous & ~context, "ambiguous_company_without_context")
        .when(T.contains_any(normalized, T.MARKET_ROUNDUP_TERMS), "market_roundup_or_stock_list")
        .when(F.contains(normalized, F.lit("in the news")) | ((others >= 2) & T.contains_any(normalized, T.STOCK_NOISE_TERMS)), "multi_company_market_article")
        .when((others >= 1) & F.rlike(normalized, F.lit(r"\bblames?\b.*\bfor\b")), "other_company_is_main_topic")
    )


def first_match_deduplicated(articles: DataFrame, group: str, url: str, title: str, order: list[Column]) -> DataFrame:
    """Declarative two-key de-duplication: a row stays if it is the first of its URL and of its title."""
    by = lambda c: F.row_number().over(Window.partitionBy(group, c).orderBy(*order))
    ranked = articles.withColumn("url_rank", F.when(F.col(url) == "", F.lit(1)).otherwise(by(url))).withColumn("title_rank", F.when(F.col(title) == "", F.lit(1)).otherwise(by(title)))
    return ranked.where("url_rank = 1 and title_rank = 1").drop("url_rank", "title_rank")


def greedy_deduplicated(articles: DataFrame, group: str, url: str, title: str, position: str, *, rounds: int = 6, limit: int = 200_000) -> DataFrame:
    """Exact greedy two-key de-duplication by scan order: adds ``kept_position``, the row that each row merges into.

    A row merges into the kept row that has registered its URL before it, else into the one of its title; else it is kept and
    registers its keys.  A merged row registers none, so the result depends on the order.  A row is kept exactly if no earlier
    kept row of its group holds one of its keys, which rounds of joins decide: the first undecided row of all its keys is kept,
    rows that meet a key of a kept one are done.  Rounds settle whatever many rows share; what is left after ``rounds`` of them
    are long chains, and of each linked set of those the first ``limit`` rows are scanned in a task, set by set, until none is
    left.  ``position`` is of any type with an order and needs to tell rows of one group apart only; null and empty keys are none.
    """
    key = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = articles.select(F.col(group).alias("g"), key(url).alias("u"), key(title).alias("t"), F.col(position).alias("p"))
    # of rows with equal keys the first one takes part
    left = stored(rows.where("u <> '' or t <> ''").groupBy("g", "u", "t").agg(F.min("p").alias("p")))
    kept = None
    done = 0
    while not left.isEmpty():
        if done < rounds:
            least = lambda c: left.where(F.col(c) != "").groupBy("g", c).agg(F.min("p").alias(f"first_{c}"))  # noqa: B023, E731
            met = left.join(least("u"), ["g", "u"], "left").join(least("t"), ["g", "t"], "left")
            won = stored(met.where("(first_u is null or p = first_u) and (first_t is null or p = first_t)").select("g", "u", "t", "p"))
        else:
            left = left if "component" in left.columns else stored(_linked(left))
            placed = F.row_number().over(Window.partitionBy("component").orderBy("p"))
            heads = stored(left.withColumn("place", placed).where(F.col("place") <= limit))
            won = stored(_scanned(heads).join(heads, ["g", "u", "t"]).select("g", "u", "t", "p"))
            left = left.join(heads.select("g", "u", "t"), ["g", "u", "t"], "left_anti")
        for c in ("u", "t"):
            left = left.join(won.where(F.col(c) != "").select("g", c), ["g", c], "left_anti")
        left = stored(left)
        kept = won if kept is None else kept.unionByName(won)
        done += 1
    own = F.col(position)
    if kept is None:
        return articles.withColumn("kept_position", own)
    out = articles
    for c, column in (("u", url), ("t", title)):
        holders = kept.where(F.col(c) != "").select(F.col("g").alias(f"g_{c}"), F.col(c).alias(f"key_{c}"), F.col("p").alias(f"by_{c}"))
        out = out.join(holders, (F.col(group) == F.col(f"g_{c}")) & (F.col(column) == F.col(f"key_{c}")), "left").drop(f"g_{c}", f"key_{c}")
    merged = F.when(F.col("by_u") <= own, F.col("by_u")).when(F.col("by_t") <= own, F.col("by_t")).otherwise(own)
    return out.withColumn("kept_position", merged).drop("by_u", "by_t")


def _linked(left: DataFrame) -> DataFrame:
    """Adds ``component``: the first row (g, p) of those that keys link with a row."""
    node = F.struct("g", "p")
    keys = left.select("g", node.alias("node"), "p", F.explode(F.array(F.concat(F.lit("u"), "u"), F.concat(F.lit("t"), "t"))).alias("key")).where("length(key) > 1")
    first = keys.groupBy("g", "key").agg(F.min("p").alias("first"))
    edges = keys.join(first, ["g", "key"]).where("p <> first").select(F.col("node").alias("src"), F.struct("g", F.col("first").alias("p")).alias("dst"))
    return left.withColumn("node", node).join(least_labels(edges), "node").drop("node")


def _scanned(heads: DataFrame) -> DataFrame:
    """(g, u, t) of the rows that a scan of each component keeps."""

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        urls: set = set()
        titles: set = set()
        kept = []
        for u, t in zip(pdf["u"], pdf["t"], strict=True):
            new = not (u and u in urls) and not (t and t in titles)
            kept.append(new)
            if new:
                urls.add(u)
                titles.add(t)
        return pdf.loc[kept, ["g", "u", "t"]]

    schema = f"g {heads.schema['g'].dataType.simpleString()}, u string, t string"
    return heads.select("g", "u", "t", "place", "component").groupBy("component").applyInPandas(lambda pdf: scan(pdf), schema)


@F.pandas_udf(DoubleType())
def sequence_ratio(first: pd.Series, second: pd.Series) -> pd.Series:
    """Longest-matching-blocks ratio of two titles (order matters): no built-in function has it."""
    return pd.Series([SequenceMatcher(None, a or "", b or "").ratio() for a, b in zip(first, second, strict=True)])


def time_bands(df: DataFrame, time: str, seconds: int) -> DataFrame:
    """Adds band numbers so that an equi-join on ``band`` brings all pairs within ``seconds`` together once.

    Every row stands in its own band as the earlier one and in its own and the band before as the later one.
    """
    return df.withColumn("band", F.floor(F.unix_timestamp(F.col(time).cast("timestamp")) / seconds))


def pairs_within(df: DataFrame, group: str, key: str, time: str, seconds: int, columns: list[str]) -> DataFrame:
    """Pairs (a before b by time, then key) of a group at most ``seconds`` apart: a band equi-join, not a cross join.

    Rows without a time are near all of their group; they are a, or b of another such row with a smaller key.
    """
    banded = time_bands(df, time, seconds)
    a = banded.select(group, "band", *[F.col(c).alias(f"a_{c}") for c in [key, time, *columns]])
    b = banded.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") - 1))).select(group, "band", *[F.col(c).alias(f"b_{c}") for c in [key, time, *columns]])
    earlier = (F.col(f"a_{time}") < F.col(f"b_{time}")) | ((F.col(f"a_{time}") == F.col(f"b_{time}")) & (F.col(f"a_{key}") < F.col(f"b_{key}")))
    near = F.unix_timestamp(F.col(f"b_{time}").cast("timestamp")) - F.unix_timestamp(F.col(f"a_{time}").cast("timestamp")) <= seconds
    dated = a.join(b, [group, "band"]).where(earlier & near).drop("band")
    named = lambda p, rows: rows.select(group, *[F.col(c).alias(f"{p}_{c}") for c in [key, time, *columns]])
    undated = named("a", df.where(F.col(time).isNull()))
    other = F.col(f"b_{time}").isNotNull() | (F.col(f"a_{key}") < F.col(f"b_{key}"))
    return dated.unionByName(undated.join(named("b", df), group).where(other))


def score_event(*, official: Column, tier1: Column, alias: Column, keyword_hits: Column, both_regions: Column, trusted_domains: Column, recent: Column, material: Column, noise: Column) -> Column:
    """Importance 0-100 of an event."""
    total = (
        F.when(official, 35).otherwise(0) + F.when(tier1, 20).otherwise(0) + F.when(alias, 10).otherwise(0) + F.least(keyword_hits * 5, F.lit(20)) + F.when(both_regions, 10).otherwise(0)
        + F.when(trusted_domains >= 3, 10).otherwise(0) + F.when(recent, 5).otherwise(0) + F.when(material, 15).otherwise(0) - F.when(noise, 25).otherwise(0)
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), total))


def score_cluster(*, official: Column, major: Column, alias: Column, keyword_hits: Column, domains: Column, recent: Column, noise: Column, roundup: Column) -> Column:
    """Importance 0-100 by the older rule: official excludes major."""
    total = (
        F.when(official, 40).when(major, 25).otherwise(0) + F.when(alias, 15).otherwise(0) + F.least(keyword_hits * 5, F.lit(20)) + F.when(domains >= 3, 15).otherwise(0)
        + F.when(recent, 10).otherwise(0) - F.when(noise, 25).otherwise(0) - F.when(roundup, 20).otherwise(0)
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), total))
