"""Names in texts: an index of terms by their words, met in one pass over the words of each text.

A text is a row of tokens: runs of Hangul, Latin letters and digits, and every other character by itself, in any script.
A term stands in a text where its tokens do, with two freedoms at its edges: before and behind it no letter or digit of
those scripts may follow on, and a term with Hangul may have a particle behind it.  Because runs are whole, the edges are
tested on the tokens beside, without a pattern for each term.

Terms are keyed by their tokens, by the first ``PREFIX`` where they have more (names that share a beginning must not all meet
wherever it stands); every place of a text looks up the keys of the lengths that terms have.  The lookup is an equi-join, so an
index of any size is partitioned by key; only places and keys of a length that terms have are looked up (blanks, which most texts
are full of, have none and would all meet in one task).  A place carries no more tokens than the longest term has, so lines of any length
stay small rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes

#: Of lower-cased text: the scripts whose runs are words, and what stands alone.
_WORD = "[가-힣a-z0-9]"
_TOKEN = f"{_WORD}+|[^가-힣a-z0-9]"
_SEPARATOR = "\x01"
#: Tokens of a key at most.
PREFIX = 6


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0))


def _is_word(token: Column) -> Column:
    return F.rlike(token, F.lit(f"^{_WORD}"))


def term_index(terms: DataFrame) -> DataFrame:
    """Adds to terms (term, ...) their tokens, key and what their edges need; terms without a character are left out."""
    cut_up = terms.where("term <> ''").withColumn("t", tokens(F.col("term")))
    first, last = F.get("t", F.lit(0)), F.element_at("t", -1)
    return cut_up.withColumns({
        "key": F.array_join(F.slice("t", F.lit(1), F.lit(PREFIX)), _SEPARATOR), "keyed": F.least(F.size("t"), F.lit(PREFIX)), "first": first, "opens": _is_word(first), "closes": _is_word(last), "hangul": F.rlike("term", F.lit("[가-힣]")),
    })


def _places(lines: DataFrame, columns: list[str], longest: int, least: int, most: int) -> DataFrame:
    """One row a token of a line that may begin a term, by its length: the token before it, the next ``longest`` + 1 tokens from it on,
    and these without a particle at their ends (null where there is none)."""
    cut_up = lines.select(*columns, tokens(F.col("line")).alias("w")).where("size(w) > 0")
    begins = lambda i: F.length(F.get("w", i - 1)).between(least, most + 1)  # noqa: E731  a particle is one more
    place = lambda i: F.struct(F.get("w", i - 2).alias("before"), F.slice("w", i, longest + 1).alias("w"), F.transform(F.slice("w", i, longest), _without_particle).alias("bare"))
    return cut_up.select(*columns, F.inline(F.transform(F.filter(F.sequence(F.lit(1), F.size("w")), begins), place)))


def _without_particle(token: Column) -> Column:
    """The word before a particle at the token's end; null where there is none."""
    # particles are single characters, and a token of several characters is a word
    return F.when((F.length(token) > 1) & F.right(token, F.lit(1)).isin(codes.PARTICLES), F.substr(token, F.lit(1), F.length(token) - 1))


def name_hits(lines: DataFrame, terms: DataFrame) -> DataFrame:
    """Distinct (columns of ``lines`` but ``line``, columns of ``terms``): the terms that stand in the lines."""
    return name_places(lines, terms).distinct()


def name_places(lines: DataFrame, terms: DataFrame) -> DataFrame:
    """``name_hits`` with a row for each place: for those who group them anyway."""
    columns = [c for c in lines.columns if c != "line"]
    index = term_index(terms)
    # PREFIX rows at most: of the keys of so many tokens the least and the largest length, of them and of their first tokens, and the longest term
    spans = {r["keyed"]: r for r in index.groupBy("keyed").agg(*[f(F.length(c)).alias(f"{c}_{k}") for c in ("key", "first") for k, f in (("least", F.min), ("most", F.max))], F.max(F.size("t")).alias("longest")).collect()}
    of = lambda name, pick: pick((r[name] for r in spans.values()), default=0)
    places = _places(lines, columns, of("longest", max), of("first_least", min), of("first_most", max))

    def keys_of(n: int) -> list[Column]:
        head, last = F.slice("w", F.lit(1), F.lit(n - 1)), F.get("w", F.lit(n - 1))
        joined = lambda end: F.when(end.isNotNull(), F.array_join(F.concat(head, F.array(end)), _SEPARATOR))
        possible = lambda key: F.transform(F.array(key), lambda k: F.when(F.length(k).between(spans[n]["key_least"], spans[n]["key_most"]), k))
        return [F.get(possible(joined(end)), F.lit(0)) for end in (last, F.get("bare", F.lit(n - 1)))]

    keys = F.array(*[k for n in sorted(spans) for k in keys_of(n)]) if spans else F.array().cast("array<string>")
    looked_up = places.withColumn("key", F.explode(F.filter(keys, lambda k: k.isNotNull())))
    n = F.size("t")
    last, own, behind = F.get("w", n - 1), F.element_at("t", -1), F.get("w", n)
    with_particle = F.col("hangul") & F.startswith(last, own) & F.substr(last, F.length(own) + 1).isin(codes.PARTICLES)
    ends = F.when(F.col("closes"), (last == own) | with_particle).otherwise((last == own) & (behind.isNull() | ~_is_word(behind) | (F.col("hangul") & behind.isin(codes.PARTICLES))))
    starts = F.col("opens") | F.col("before").isNull() | ~_is_word(F.col("before"))
    same = F.slice("w", F.lit(1), n - 1) == F.slice("t", F.lit(1), n - 1)
    met = looked_up.join(index.drop("keyed", "first"), "key").where(same & ends & starts)
    return met.select(*columns, *terms.columns)
