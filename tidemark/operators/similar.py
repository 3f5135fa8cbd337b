"""Pairs of articles of one company and time that are alike, for clusters.

Articles of one title, items (words of the title, event keywords) and band of time are alike and near, so they are one node.
Nodes that may be near share a cell (company and band); a cell is dealt out in blocks, and a task compares two blocks.  Before
the sequence ratio of two titles is computed, their longest common subsequence bounds it, 64 characters at a time in words of
64 bits.  Of the edges of two blocks as many come back as keep linked what they link: clusters need no more.

Rows without a time are near all of their company: their cell holds them and each dated title once.
"""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import stored

SPAN = 259_200
BLOCK = 1_000

#: Characters of a title that the bound looks at; the others count as common.
_BOUNDED = 512
#: Items that are counted in one product.
_ITEMS = 4_096


def common_characters(titles: list[str]) -> Callable[[int, np.ndarray], np.ndarray]:
    """A function of a title's place and those of others: no less than the length of the longest common subsequence with each."""
    short = [t[:_BOUNDED] for t in titles]
    width = max(map(len, short), default=0)
    text = np.array(short, dtype=f"<U{max(width, 1)}").view(np.uint32).reshape(len(short), -1)
    values, codes = np.unique(text, return_inverse=True)
    lengths = np.array([len(t) for t in short], dtype=np.int64)
    codes = np.where(np.arange(text.shape[1]) < lengths[:, None], codes.reshape(text.shape), len(values)).T.copy()  # the last code is in no title
    beyond = np.array([len(t) for t in titles], dtype=np.int64) - lengths

    def bound(k: int, others: np.ndarray) -> np.ndarray:
        total = beyond[k] + beyond[others]
        columns = codes[: lengths[others].max(initial=0), others]
        for start in range(0, int(lengths[k]), 64):
            part = codes[start : min(start + 64, int(lengths[k])), k]
            places = np.zeros(len(values) + 1, dtype=np.uint64)
            for at, code in enumerate(part):
                places[code] |= np.uint64(1 << at)
            row = np.full(len(others), 2**64 - 1, dtype=np.uint64)
            for mask in places[columns]:
                hit = row & mask
                row = (row + hit) | (row - hit)
            total = total + np.bitwise_count(~row & np.uint64((1 << len(part)) - 1))
        return total

    return bound


def common_items(first: list, second: list) -> np.ndarray:
    """Numbers of common items of each of ``first`` with each of ``second``."""
    shared = sorted({i for items in first for i in items} & {i for items in second for i in items})
    place = {item: k for k, item in enumerate(shared)}
    common = np.zeros((len(first), len(second)), dtype=np.float32)
    for start in range(0, len(shared), _ITEMS):
        marked = []
        for side in (first, second):
            marks = np.zeros((len(side), min(_ITEMS, len(shared) - start)), dtype=np.float32)
            for k, items in enumerate(side):
                at = [place[i] - start for i in items if i in place and start <= place[i] < start + _ITEMS]
                marks[k, at] = 1
            marked.append(marks)
        common += marked[0] @ marked[1].T
    return common


def linked(cell: pd.DataFrame, ratio: float, seconds: int, by_items: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Places of nodes that are alike, as a forest: of two blocks (``role``), or of the first one with itself as well (``own``)."""
    cell = cell.reset_index(drop=True)
    n = len(cell)
    x, y = np.flatnonzero(cell["role"] == 0), np.flatnonzero(cell["role"] == 1)
    others = np.concatenate([x, y]) if bool(cell["own"].iloc[0]) else y
    if not len(x) or not len(others):
        return []
    titled = cell["title"].notna().to_numpy()
    titles = cell["title"].fillna("").tolist()
    items = [list(i) for i in cell["items"]]
    size = np.array([len(i) for i in items])
    length = np.array([len(t) for t in titles])
    lo, hi = cell["lo"].to_numpy(dtype=float), cell["hi"].to_numpy(dtype=float)
    near = (lo[others] - hi[x][:, None] <= seconds) & (lo[x][:, None] - hi[others] <= seconds) & (x[:, None] != others)
    common = common_items([items[k] for k in x], [items[k] for k in others])
    alike = near & by_items(common, size[x][:, None] + size[others] - common)
    label = np.arange(n)
    edges = []

    def join(a: int, b: int) -> None:
        label[label == label[b]] = label[a]
        edges.append((a, b))

    for row, a in enumerate(x):
        found = others[alike[row]]
        for b in found[label[found] != label[a]]:
            if label[a] != label[b]:
                join(a, b)
    first, last = list(zip(cell["first_time"], cell["first_key"], strict=True)), list(zip(cell["last_time"], cell["last_key"], strict=True))
    bound = common_characters(titles)
    for row, a in enumerate(x):
        both = length[a] + length[others]
        left = near[row] & titled[a] & titled[others] & (label[others] != label[a]) & (2 * np.minimum(length[a], length[others]) >= ratio * both - 1e-9)
        if len(others) > len(y):
            left[: row + 1] = False  # pairs of one block come once
        left = others[left]
        if not len(left):
            continue
        for b in left[2 * bound(a, left) >= ratio * (length[a] + length[left]) - 1e-9]:
            if label[a] == label[b]:
                continue
            if (first[a] < last[b] and SequenceMatcher(None, titles[a], titles[b]).ratio() >= ratio) or (first[b] < last[a] and SequenceMatcher(None, titles[b], titles[a]).ratio() >= ratio):
                join(a, b)
    return edges


def _cells(nodes: DataFrame, cell: list[str], block: int) -> DataFrame:
    """Nodes with ``side`` 0 or 1 by the pairs of blocks in which they are compared: side 0 with itself and with side 1.

    Cells that hold no pair, which are most where companies have few articles, are left out before anything is dealt.
    """
    counted = nodes.groupBy(*cell).agg(*[F.count_if(F.col("side") == s).alias(f"c{s}") for s in (0, 1)]).where("c0 > 0 and c0 + c1 > 1")
    sizes = counted.select(*cell, *[F.greatest(F.ceil(F.col(f"c{s}") / block), F.lit(1)).cast("int").alias(f"n{s}") for s in (0, 1)])
    dealt = nodes.join(sizes, cell)
    spread = F.xxhash64("title", "items", "first_key")
    place = F.pmod(spread, F.when(F.col("side") == 0, F.col("n0")).otherwise(F.col("n1"))).cast("int")
    to = lambda kind, i, j, role: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), F.lit(role).alias("role"))
    p = F.col("place")
    within = F.transform(F.sequence(F.lit(0), F.col("n0") - 1), lambda k: F.when(k > p, to(0, p, k, 0)).when(k < p, to(0, k, p, 1)))
    across = F.transform(F.sequence(F.lit(0), F.col("n1") - 1), lambda k: to(1, p, k, 0))
    pairs = F.when(F.col("side") == 0, F.concat(F.filter(within, lambda s: s.isNotNull()), across)).otherwise(F.transform(F.sequence(F.lit(0), F.col("n0") - 1), lambda k: to(1, k, p, 1)))
    out = dealt.withColumn("place", place).select("*", F.explode(pairs).alias("to")).select(*cell, "to.*", *NODE)
    return out.withColumn("own", (F.col("kind") == 1) & (F.col("j") == 0))


#: Columns of a node: its title and items, seconds of its first and last row (without bounds for rows without a time), and these rows in order.
NODE = ["title", "items", "lo", "hi", "first_time", "first_key", "last_time", "last_key"]


def _compared(nodes: DataFrame, cell: list[str], ratio: float, seconds: int, by_items: Callable, block: int) -> DataFrame:
    """(src, dst): first keys of nodes that are alike."""
    kind = nodes.schema["first_key"].dataType.simpleString()

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("role", kind="stable").reset_index(drop=True)
        edges = linked(pdf, ratio, seconds, by_items)
        keys = pdf["first_key"]
        return pd.DataFrame({"src": keys.iloc[[a for a, _ in edges]].to_numpy(), "dst": keys.iloc[[b for _, b in edges]].to_numpy()})

    return _cells(nodes, cell, block).groupBy(*cell, "kind", "i", "j").applyInPandas(lambda pdf: compare(pdf), f"src {kind}, dst {kind}")


def alike_edges(rows: DataFrame, group: str, key: str, time: str, title: str, items: str, *, ratio: float, by_items: Callable[[np.ndarray, np.ndarray], np.ndarray], seconds: int = SPAN, block: int = BLOCK) -> DataFrame:
    """(src, dst) that link what pairs of one group link which are at most ``seconds`` apart and alike: by the ratio of their titles
    (the earlier first, rows without a time before all, then by key) or by the numbers of common and of united items.

    ``items`` are distinct; equal titles have a ratio of 1.
    """
    at = F.unix_timestamp(F.col(time).cast("timestamp"))
    alone = F.when(F.col(title).isNull(), F.col(key)).alias("alone")  # rows without a title are alike by their items only
    what = F.struct(F.col(title).alias("title"), F.array_sort(F.coalesce(F.col(items), F.array().cast("array<string>"))).alias("items"), alone)
    own = rows.where(F.col(group).isNotNull() & F.col(key).isNotNull()).select(
        F.col(group).alias("g"), what.alias("what"), F.struct(F.floor(at / seconds).alias("band")).alias("b"), F.col(key).alias("key"), at.alias("at"), F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(-(2**63)).cast("long")).alias("t")
    )  # nulls in a struct are equal
    row = F.struct("t", "key")
    grouped = own.groupBy("g", "what", "b").agg(F.min(row).alias("first"), F.max(row).alias("last"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    open_ends = [F.coalesce(F.col("lo").cast("double"), F.lit(float("-inf"))).alias("lo"), F.coalesce(F.col("hi").cast("double"), F.lit(float("inf"))).alias("hi")]
    ends = [F.col(f"{end}.{part}").alias(f"{end}_{name}") for end in ("first", "last") for part, name in (("t", "time"), ("key", "key"))]
    nodes = stored(grouped.select("g", "what", "what.title", "what.items", "b", "b.band", *ends, *open_ends), "nodes")
    copies = own.join(nodes.select("g", "what", "b", F.col("first_key").alias("dst")), ["g", "what", "b"]).where("key <> dst").select(F.col("key").alias("src"), "dst")

    dated, undated = nodes.where("band is not null"), nodes.where("band is null").withColumn("side", F.lit(0))
    sides = F.explode(F.array(F.struct(F.col("band").alias("cell"), F.lit(0).alias("side")), F.struct((F.col("band") - 1).alias("cell"), F.lit(1).alias("side"))))
    in_bands = _compared(dated.withColumn("s", sides).select("g", "s.cell", "s.side", *NODE), ["g", "cell"], ratio, seconds, by_items, block)

    # a dated title stands once in the cell without a time, with all its rows behind it where it is alike with one of those
    first, last = F.min(F.struct("first_time", "first_key")).alias("first"), F.max(F.struct("last_time", "last_key")).alias("last")
    once = dated.groupBy("g", "what").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), first, last).select("g", "what", "what.title", "what.items", "lo", "hi", "first.*", "last.*", F.lit(1).alias("side"))
    met = undated.select("g").distinct()
    without = stored(_compared(undated.select("g", "side", *NODE).unionByName(once.select("g", "side", *NODE).join(met, "g", "left_semi")), ["g"], ratio, seconds, by_items, block), "undated")
    found = without.select(F.explode(F.array("src", "dst")).alias("first_key")).distinct()
    named = once.join(found, "first_key", "left_semi").select("g", "what", F.col("first_key").alias("src"))
    behind = dated.select("g", "what", F.col("first_key").alias("dst")).join(named, ["g", "what"]).where("src <> dst").select("src", "dst")
    return copies.unionByName(in_bands).unionByName(without).unionByName(behind)


def title_edges(rows: DataFrame, group: str, key: str, time: str, title: str, tokens: str, *, ratio: float = 0.72, block: int = BLOCK) -> DataFrame:
    """(src, dst): articles of one event by their titles alone: ratio, Jaccard 0.5, or three common tokens and Jaccard 0.25.

    ``tokens`` are distinct words.
    """
    return alike_edges(rows.where(F.col(title) != ""), group, key, time, title, tokens, ratio=ratio, block=block, by_items=lambda common, united: (common > 0) & ((2 * common >= united) | ((common >= 3) & (4 * common >= united))))


def event_edges(rows: DataFrame, group: str, key: str, time: str, title: str, keywords: str, *, ratio: float = 0.82, block: int = BLOCK) -> DataFrame:
    """(src, dst): articles of one event by two common keywords (distinct ones) or the ratio of their titles."""
    return alike_edges(rows, group, key, time, title, keywords, ratio=ratio, block=block, by_items=lambda common, united: common >= 2)


def cluster_id(group: Column, anchor: Column) -> Column:
    """Id of a cluster by its company and its first title in order."""
    return F.substring(F.sha2(F.concat_ws("|", group, anchor), 256), 1, 16)
