"""Inputs shared by the operator tests: odd rows, and brute-force groups."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size long, key long, component string, label long, bits double"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(start: int, n: int, step: int = 1) -> str:
    return " ".join(WORDS[(start + step * k * k + k) % len(WORDS)] + str((start * 7 + k) % 13) for k in range(n))


def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns that clash with inner names."""
    extra = ("x", 1, 2, "c", 3, 0.5)
    rows = [
        (0, sentence(0, 60), "en", "a"), (1, sentence(0, 60), "en", "a"), (2, sentence(0, 59) + " other9", "en", "b"), (3, None, "en", "a"), (4, "", "en", None), (5, "   \n\t ", None, "b"),
        (6, "one", "de", "b"), (7, "one two three four", "de", "c"), (8, "ONE two three FOUR", "de", "c"), (None, sentence(3, 30), "fr", "c"), (None, None, None, None), (9, sentence(5, 40), "fr", "a"), (9, sentence(5, 40), "fr", "a"),
        (10, "é ü 日本語 テキスト <|endoftext|> it's I'LL  two  spaces\n\nlines\n\nlines 😀", "fr", "d"), (11, " ".join(sentence(k, 50) for k in range(400)), "en", "a"), (12, "x" * 5000, "en", "e"), (13, "a, b. c! <|startoftext|>", "es", "e"),
    ]
    return spark.createDataFrame([(*r, len(r[1]) if r[1] else None, *extra) for r in rows], SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def components(nodes, links):
    """Smallest node reachable, by plain union-find."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
