"""Linking inside candidate regions: shared by the near-duplicate operators.

A region is a set of nodes that a hash table or a sorted order puts together.  Only components are
wanted, so a region needs no list of pairs: its nodes are tested against each other until all are
in one component or every pair between different components has been tested.  Nodes that earlier
tables have already joined are not tested again, and a region that is one component is skipped.

Regions are bounded by weight.  What is larger goes down to deeper keys for the rounds; the pairs
that this leaves out are tested at the end: every node outside a large region's most frequent
component is tested against the whole region, in blocks of bounded weight.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import relabelled
from .storage import stored

#: A linker gets the payloads of a group and a node's place in it; it tells which places link with it.
Linker = Callable[[list[bytes]], Callable[[int], np.ndarray]]

_LINKS = "src long, dst long"


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of equal keys from batches sorted by them; one group is held at a time."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [table.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(len(table), bool)
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [*np.flatnonzero(change).tolist(), len(table)]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            last = key
            held.append(table.slice(a, b - a))
    if held:
        yield pa.concat_tables(held)


def join_components(nodes: np.ndarray, labels: np.ndarray, neighbours: Callable[[int], np.ndarray]) -> list[tuple[int, int]]:
    """Links between different labels that join what any pair of nodes links; (label, label) pairs."""
    _, comp = np.unique(labels, return_inverse=True)
    first = labels.copy()
    size = np.bincount(comp)
    done = np.zeros(len(nodes), bool)
    links: list[tuple[int, int]] = []
    while True:
        biggest = int(size.argmax())
        if size[biggest] == len(nodes):
            break
        # pairs within the largest component need no test, all others have an end outside it
        left = np.flatnonzero(~done & (comp != biggest))
        if not len(left):
            break
        x = int(left[0])
        done[x] = True
        near = neighbours(x)
        for c in np.unique(comp[near & (comp != comp[x])]).tolist():
            y = int(np.flatnonzero(comp == c)[0])
            links.append((int(first[x]), int(first[y])))
            size[comp[x]] += size[c]
            size[c] = 0
            comp[comp == c] = comp[x]
    return links


def _link(keys: list[str], linker: Linker):
    def run(batches):
        src, dst = [], []
        for group in sorted_groups(batches, keys):
            labels = group.column("label").to_numpy()
            if labels.min() == labels.max():
                continue
            neighbours = linker(group.column("payload").to_pylist())
            for a, b in join_components(group.column("node").to_numpy(), labels, neighbours):
                src.append(a)
                dst.append(b)
            if len(src) > 100_000:
                yield pa.RecordBatch.from_pydict({"src": src, "dst": dst})
                src, dst = [], []
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return run


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("label", F.col("node"))
    return members.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")


def _mixed(members: DataFrame, keys: list[str]) -> DataFrame:
    """Members of regions that hold several labels; of regions with the same nodes one stays."""
    whole = members.groupBy(*keys).agg(F.min("label").alias("low"), F.max("label").alias("high"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("same"), F.count("*").alias("n"))
    one = whole.where("low <> high").groupBy("same", "n").agg(F.min(F.struct(*keys)).alias("k"))
    return members.join(one.select(*[F.col(f"k.{k}").alias(k) for k in keys]), keys, "left_semi")


def _tested(members: DataFrame, payload: DataFrame, keys: list[str], linker: Linker) -> DataFrame:
    """Links (src, dst) between labels found in the groups of ``keys``."""
    full = members.join(payload, "node").select(*keys, "node", "label", "payload")
    dealt = full.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(_link(keys, linker), _LINKS)


def regions_with_company(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose region holds at least two of them, with ``held``: the region's weight."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("weight").alias("held")).where("n > 1").drop("n")
    return rows.join(counts, keys)


def components_by_regions(regions: DataFrame, payload: DataFrame, rounds: list[list[int]], linker: Linker, limit: int) -> DataFrame | None:
    """Components (node, component) of the links inside regions, None where no region has company.

    regions: t, k1, k2, k3 (keys of growing depth), node, weight, held.  payload: node, payload.
    """
    labels = None
    large = F.col("held") > limit
    for tables in rounds:
        members = regions.where(F.col("t").isin(tables))
        # adaptive depth: a region above the limit goes down a level, and again
        deeper = members.where(large)
        held2 = deeper.groupBy("t", "k1", "k2").agg(F.sum("weight").alias("held2"))
        down = deeper.join(held2, ["t", "k1", "k2"]).withColumn("k3", F.when(F.col("held2") > limit, F.col("k3")).otherwise(F.lit(0)))
        held3 = down.groupBy("t", "k1", "k2", "k3").agg(F.sum("weight").alias("held3"))
        down = down.join(held3, ["t", "k1", "k2", "k3"])
        # the same nodes to the last level: any division serves, the rest is tested at the end
        down = down.withColumn("part", F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.ceil(F.col("held3") / limit))))
        keys = ["t", "k1", "k2", "k3", "part"]
        shallow = members.where(~large).select("t", "k1", F.lit(0).cast("long").alias("k2"), F.lit(0).cast("long").alias("k3"), F.lit(0).cast("long").alias("part"), "node")
        chosen = shallow.unionByName(down.select(*keys, "node"))
        mixed = _mixed(stored(_labelled(chosen, labels), "members"), keys)
        links = stored(_tested(mixed, payload, keys, linker), "links")
        if not links.isEmpty():
            labels = relabelled(labels, links)
    whole = regions.where(large).select("t", "k1", "node", "weight", "held")
    if whole.isEmpty():
        return labels
    members = _mixed(stored(_labelled(whole, labels), "large"), ["t", "k1"])
    sizes = members.groupBy("t", "k1", "label").agg(F.count("*").alias("n"))
    most = sizes.groupBy("t", "k1").agg(F.max_by("label", F.struct("n", "label")).alias("most"))
    members = members.join(most, ["t", "k1"])
    outside = members.where("label <> most")
    rest = outside.groupBy("t", "k1").agg(F.sum("weight").alias("rest"))
    blocks = F.ceil(F.col("held") / limit)
    in_block = F.pmod(F.xxhash64("node"), blocks)
    rows = F.ceil(F.col("rest") / limit)
    in_row = F.pmod(F.xxhash64("node", F.lit(1)), rows)
    both = members.join(rest, ["t", "k1"])
    as_block = both.select("t", "k1", "node", "label", in_block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), rows - 1)).alias("row"))
    as_row = both.where("label <> most").select("t", "k1", "node", "label", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), in_row.alias("row"))
    grid = as_block.unionByName(as_row.select("t", "k1", "node", "label", "block", "row")).distinct()
    links = stored(_tested(grid, payload, ["t", "k1", "block", "row"], linker), "links")
    return labels if links.isEmpty() else relabelled(labels, links)


def block_grid(members: DataFrame, group: str, limit: int) -> DataFrame:
    """Each group's members dealt to pairs of blocks: adds lo, hi and mine (the member's own block)."""
    held = members.groupBy(group).agg(F.sum("weight").alias("held"))
    dealt = members.join(held, group).withColumn("blocks", F.ceil(F.col("held") / limit)).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return other.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other")).drop("held", "blocks", "other")


__all__ = ["block_grid", "components_by_regions", "join_components", "regions_with_company", "sorted_groups"]
