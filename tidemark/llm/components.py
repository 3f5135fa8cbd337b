"""Connected components of an edge table by contraction.

Each round gives every node the least of itself and its neighbours as parent, shortens parent
chains, and replaces the edges by the edges between different parents.  Edge tables shrink fast, no
neighbourhood is gathered in one row, and each round is a written table, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored


def _jump(parents: DataFrame) -> DataFrame:
    above = parents.select(F.col("node").alias("a_node"), F.col("parent").alias("a_parent"))
    return parents.join(above, F.col("parent") == F.col("a_node"), "left").select("node", F.coalesce("a_parent", "parent").alias("parent"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (src, dst): component is the least node reachable."""
    edges = stored(edges.select("src", "dst").where("src <> dst"), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("least"))
        parents = stored(_jump(_jump(least.select("node", F.least("node", "least").alias("parent")))), "parents")
        if labels is None:
            labels = parents.select("node", F.col("parent").alias("component"))
        else:
            up = parents.select(F.col("node").alias("p_node"), "parent")
            labels = stored(labels.join(up, F.col("component") == F.col("p_node"), "left").select("node", F.coalesce("parent", "component").alias("component")), "labels")
        a = parents.select(F.col("node").alias("src"), F.col("parent").alias("a"))
        b = parents.select(F.col("node").alias("dst"), F.col("parent").alias("b"))
        moved = edges.join(a, "src").join(b, "dst").where("a <> b")
        edges = stored(moved.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "edges")
    if labels is None:
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return labels


def relabelled(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (node, component) after links (src, dst) between components; nodes without a row are their own."""
    found = connected_components(links)
    if labels is None:
        return found
    up = found.select(F.col("node").alias("f_node"), F.col("component").alias("f_component"))
    old = labels.join(up, F.col("component") == F.col("f_node"), "left").select("node", F.coalesce("f_component", "component").alias("component"))
    new = found.join(labels, "node", "left_anti")
    return stored(old.unionByName(new), "labels")
