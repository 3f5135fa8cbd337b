"""Sharding by a hierarchical weighted hash tree.

Method: a tree of regions, racks and shards.  At each level a document draws a hash for every
child and takes the child with the least ``-ln(u) / weight`` (weighted rendezvous), where a child
weighs what the shards below it weigh.  A change of weights moves documents only between the
children whose weights changed relative to each other, and only inside that subtree; a new region
takes documents only into itself.

Law ``key``: the id and the tree decide the shard, and nothing else.  A tree for n shards has one
fixed block of 8 (2 regions x 2 racks x 2 shards) and a region of its own for every later shard,
so one more shard takes rows only into itself.

Everything is built from SQL functions.  Slots within a shard are numbered without bringing a
shard together: rows are dealt to (shard, bucket) groups, group sizes are summed up to bases, and
each group numbers its own rows.  Equal rows are pre-aggregated, so copies never form a hot group.

Defined cases: null text has size 1 and crc 0; null ids share one draw (the id "null"); repeated
rows get the same shard and a slot each; a shard of weight 0 is drained and takes nothing, and a tree
without any weight is an error; very long texts add their bytes and nothing else; extra columns,
whatever their names, are ignored; an empty table is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: tree: {region: {rack: {shard number: weight}}}
Tree = dict[str, dict[str, dict[int, float]]]

#: Groups a shard is cut into for numbering at least, rows of a group beyond that.
BUCKETS, GROUP_ROWS = 1024, 65_536
#: Slots that one row unfolds into at a time.
RUN = 65_536


def shard_tree(shards: int) -> Tree:
    """The tree of the law ``key`` for so many shards, each of weight 1."""
    tree: Tree = {}
    for s in range(min(shards, 8)):
        tree.setdefault(f"r{s // 4}", {}).setdefault(f"k{s // 2 % 2}", {})[s] = 1.0
    for s in range(8, shards):
        tree[f"r{s - 6}"] = {"k0": {s: 1.0}}
    return tree


def _draw(key: Column, node: str, weight: float) -> Column:
    """-ln(u) / weight for the child's hash u in (0, 1): 52 bits of an md5 of node and key."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(node + "|"), key)), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 52))) / F.lit(float(weight))


def _descend(key: Column, node: str, children: list[tuple[str, float, Column]]) -> Column:
    """The result of the child with the least draw; children without weight take no part."""
    children = [c for c in children if c[1] > 0]
    if not children:
        raise ValueError(f"no shard below {node or 'the root'} has a weight")
    if len(children) == 1:
        return children[0][2]
    draws = F.array(*[_draw(key, f"{node}/{name}", weight) for name, weight, _ in children])
    place = F.array_position(draws, F.array_min(draws))
    out = children[-1][2]
    for k in range(len(children) - 2, -1, -1):
        out = F.when(place == k + 1, children[k][2]).otherwise(out)
    return out


def shard_of(key: Column, tree: Tree) -> Column:
    """Shard number (int) of a string key: region, then rack, then shard."""

    def weight(below) -> float:
        return sum(map(weight, below.values())) if isinstance(below, dict) else float(below)

    regions = []
    for region, racks in tree.items():
        inner = []
        for rack, shards in racks.items():
            leaves = [(str(s), w, F.lit(int(s))) for s, w in shards.items()]
            if weight(shards) > 0:
                inner.append((rack, weight(shards), _descend(key, f"{region}/{rack}", leaves)))
        if inner:
            regions.append((region, weight(racks), _descend(key, region, inner)))
    return _descend(key, "", regions)


def assign_shards(docs: DataFrame, tree: Tree, grown: Tree | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, size, text_crc32, law, shard, slot, grown_shard (null without ``grown``)."""
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    buckets = max(BUCKETS, -(-docs.count() // GROUP_ROWS))
    key = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    distinct = rows.groupBy("id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    placed = distinct.withColumns({
        "shard": shard_of(key, tree),
        "grown_shard": shard_of(key, grown) if grown else F.lit(None).cast("int"),
        "bucket": (F.conv(F.substring(F.md5(F.concat_ws("|", key, "size", "text_crc32")), 1, 8), 16, 10).cast("long") % buckets).cast("int"),
    })
    sizes = placed.groupBy("shard", "bucket").agg(F.sum("copies").alias("held"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("shard", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "bucket").orderBy(F.col("id").asc_nulls_first(), "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("within", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(bases, ["shard", "bucket"])
    first = numbered.withColumn("first", F.col("base") + F.col("within"))
    runs = first.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / RUN))))  # long runs of copies unfold in two steps
    start = F.col("first") + F.col("run") * RUN
    slots = F.sequence(start, F.least(start + RUN, F.col("first") + F.col("copies")) - 1)
    return runs.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", F.explode(slots).alias("slot"), "grown_shard")


def oracle(eight: Tree, nine: Tree) -> str:
    """DuckDB SQL for the shards of the table documents (less than 2^26 rows, whose buckets are ``BUCKETS``)."""

    def weight(below) -> float:
        return sum(map(weight, below.values())) if isinstance(below, dict) else float(below)

    def descend(node: str, below) -> str:
        if not isinstance(below, dict):
            return node.rpartition("/")[2]
        live = {name: child for name, child in below.items() if weight(child) > 0}
        inner = [descend(f"{node}/{name}" if node else str(name), child) for name, child in live.items()]
        if len(live) == 1:
            return inner[0]
        draws = [f"-ln((('0x' || substr(md5('{node}/{name}|' || key), 1, 13))::BIGINT + 0.5) / 4503599627370496) / {weight(child)}" for name, child in live.items()]
        cases = " ".join(f"WHEN d[{k + 1}] = list_min(d) THEN {x}" for k, x in enumerate(inner))
        return f"(SELECT CASE {cases} END FROM (SELECT [{', '.join(draws)}] AS d))"

    table = "[list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR n IN range(256)]"
    return f"""
    WITH b AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
    c AS (SELECT doc_id, key, size, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b, (SELECT {table} AS tab)),
    s AS (SELECT *, {descend("", eight)} AS shard, {descend("", nine)} AS grown_shard, ('0x' || substr(md5(key || '|' || size || '|' || text_crc32), 1, 8))::BIGINT % {BUCKETS} AS bucket FROM c)
    SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM s"""
