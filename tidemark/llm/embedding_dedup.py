"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Method: vectors are normalised; a table's bucket is the tuple of ``HASHES`` quantised random
projections ``floor((a . v + b) / CELL)`` with Gaussian a (2-stable).  ``TABLES`` tables are used.
The vectors of a bucket are tested by exact cosine in double precision until each pair between
different components has been tested (``regions.py``); then every component counts its links, all
pairs of its vectors in blocks of bounded size.  Equal vectors are one node with a count.

At cosine 0.9 (distance 0.447) a hash agrees with probability 0.82 and a pair meets in some table
with 0.996, at 0.91 with 0.998; every pair inside a component is found whichever way the component
came together.  Vectors of no relation agree with 0.49 a hash, 1e-5 a bucket; tables of 10^8
vectors and more want more hashes and tables (the parameters), as with any such index.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing, and so do vectors of different lengths with each other; a null id takes no part
(component null, kept true); repeated rows count as other vectors and get a result row each; extra
columns, whatever their names, are ignored; an empty table is empty.

Counting the links of a component of n vectors compares all its pairs, in blocks of ``STRIP x limit``
(16 MB of vectors of 128 numbers); its vectors are shuffled once for every block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .regions import block_grid, components_by_regions, regions_with_company, sorted_groups
from .storage import stored

TABLES, HASHES, CELL = 128, 16, 2.0
#: Vectors of a region or block that one task holds.
LIMIT = 4096
ROUNDS = [[*range(0, 4)], [*range(4, 16)], [*range(16, TABLES)]]
_ODD = np.random.default_rng(41).integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Blocks of the link count hold so many times ``limit``: each vector goes once to every block of its component.
STRIP = 4
#: Vectors hashed together.
ROWS = 1_000
_PLANES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _planes(dim: int) -> tuple[np.ndarray, np.ndarray]:
    if dim not in _PLANES:
        rng = np.random.default_rng(97 + dim)
        _PLANES[dim] = rng.standard_normal((dim, TABLES * HASHES)), rng.uniform(0, CELL, TABLES * HASHES)
    return _PLANES[dim]


def bucket_keys(vectors: np.ndarray) -> np.ndarray:
    """64-bit bucket keys, vectors x TABLES, of normalised vectors: hashes of the cells' numbers."""
    planes, shift = _planes(vectors.shape[1])
    cells = np.floor((vectors @ planes + shift) / CELL).astype(np.int64).view(np.uint64).reshape(len(vectors), TABLES, HASHES)
    mixed = (cells + np.uint64(0x9E3779B97F4A7C15)) * _ODD
    mixed ^= mixed >> np.uint64(29)
    keys = (mixed * _ODD[::-1]).sum(axis=2, dtype=np.uint64)
    return (keys ^ (keys >> np.uint64(32))).view(np.int64)


def _features(batches):
    # the cells of a vector take 48 KB and more, so a whole batch is never hashed at once
    for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
        vectors = batch.column(1).to_pylist()
        nodes: list = [None] * len(vectors)
        data: list = [None] * len(vectors)
        keys: list = [None] * len(vectors)
        by_dim: dict[int, list[int]] = {}
        for k, v in enumerate(vectors):
            if v and None not in v:
                by_dim.setdefault(len(v), []).append(k)
        for places in by_dim.values():
            x = np.array([vectors[k] for k in places], np.float64)
            with np.errstate(all="ignore"):
                norm = np.linalg.norm(x, axis=1)
                big = np.abs(x).max(axis=1)  # scaled first where squares would leave the range of doubles
                odd = ~np.isfinite(norm) | (norm == 0)
                scaled = x / np.where(odd & np.isfinite(big) & (big > 0), big, 1.0)[:, None]
                norm = np.linalg.norm(scaled, axis=1)
            good = np.isfinite(x).all(axis=1) & (norm > 0)
            places = [k for k, ok in zip(places, good, strict=True) if ok]
            unit = scaled[good] / norm[good][:, None] + 0.0  # no negative zeros
            for k, u, b in zip(places, unit, bucket_keys(unit), strict=True):
                data[k] = u.tobytes()
                nodes[k] = xxhash.xxh3_64_intdigest(data[k]) - (1 << 63)
                keys[k] = b
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(data, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "node", "payload", "keys"])


def cosine_linker(least: float):
    """Tests of one unit vector against a group's by cosine."""

    def linker(payloads: list[bytes]):
        lengths = np.array([len(p) for p in payloads])
        stacks = {n: np.frombuffer(b"".join([p for p in payloads if len(p) == n]), np.float64).reshape(-1, n // 8) for n in set(lengths.tolist())}
        place = np.array([np.count_nonzero(lengths[:k] == lengths[k]) for k in range(len(lengths))]) if len(stacks) > 1 else np.arange(len(lengths))

        def neighbours(x: int) -> np.ndarray:
            near = np.zeros(len(lengths), bool)
            own = stacks[lengths[x]]
            near[lengths == lengths[x]] = own @ own[place[x]] >= least
            return near

        return neighbours

    return linker


def _degrees(least: float):
    def run(batches):
        for group in sorted_groups(batches, ["component", "lo", "hi"]):
            mine, lo, hi = (group.column(k).to_numpy() for k in ("mine", "lo", "hi"))
            nodes, copies = group.column("node").to_numpy(), group.column("copies").to_numpy()
            payloads = group.column("payload").to_pylist()
            total = np.zeros(len(nodes), np.int64)
            lengths = np.array([len(p) for p in payloads])
            for n in np.unique(lengths):
                a = np.flatnonzero((mine == lo) & (lengths == n))
                b = np.flatnonzero((mine == hi) & (lengths == n))
                if not len(a) or not len(b):
                    continue
                va, vb = (np.frombuffer(b"".join([payloads[k] for k in w]), np.float64).reshape(-1, n // 8) for w in (a, b))
                for at in range(0, len(a), 1024):
                    near = va[at : at + 1024] @ vb.T >= least
                    near &= nodes[a[at : at + 1024], None] != nodes[b][None, :]
                    total[a[at : at + 1024]] += near @ copies[b]
                    if lo[0] != hi[0]:
                        total[b] += copies[a[at : at + 1024]] @ near
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(total)], ["node", "links"])

    return run


def near_duplicate_vectors(vectors: DataFrame, *, least: float = 0.9, limit: int = LIMIT, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: id_col, n_links, component_id, kept."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    features = stored(rows.mapInArrow(_features, "id long, node long, payload binary, keys array<long>"), "vectors")
    usable = features.where("node is not null and id is not null")
    classes = stored(usable.groupBy("node").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("keys").alias("keys"), F.first("payload").alias("payload")), "classes")
    tables = F.transform(F.sequence(F.lit(0), F.lit(TABLES - 1)), lambda t: F.struct(t.alias("t"), F.element_at("keys", t + 1).alias("k1"), F.element_at("keys", (t + 1) % TABLES + 1).alias("k2"), F.element_at("keys", (t + 2) % TABLES + 1).alias("k3")))
    exploded = classes.select("node", F.lit(1).cast("long").alias("weight"), F.inline(tables))
    regions = stored(regions_with_company(exploded, ["t", "k1"]), "buckets")
    labels = components_by_regions(regions, classes.select("node", "payload"), ROUNDS, cosine_linker(least), limit)
    if labels is None:
        named = classes.select("node", "rep", "copies", F.col("node").alias("component"), F.lit(0).cast("long").alias("links"))
    else:
        members = labels.join(classes.select("node", "copies", "payload"), "node").withColumn("weight", F.lit(1).cast("long"))
        keys = ["component", "lo", "hi"]
        dealt = block_grid(members.select("component", "node", "copies", "payload", "weight"), "component", STRIP * limit).repartition(*keys).sortWithinPartitions(*keys)
        links = dealt.select(*keys, "mine", "node", "copies", "payload").mapInArrow(_degrees(least), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
        named = classes.select("node", "rep", "copies").join(labels, "node", "left").join(links, "node", "left")
        named = named.select("node", "rep", "copies", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    named = stored(named, "named")
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_class = named.join(smallest, "component").select("node", "component_id", (F.col("links") + F.col("copies") - 1).alias("links"))
    out = features.select("id", F.when(F.col("id").isNotNull(), F.col("node")).alias("node")).join(by_class, "node", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def oracle(least: float) -> str:
    """DuckDB SQL for the table embeddings: all pairs, for tables of some thousand vectors."""
    return f"""
    WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, row_number() OVER () AS k FROM embeddings),
    u AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    p AS (SELECT a.k AS a, b.k AS b FROM u a JOIN u b ON a.k <> b.k AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {least}),
    r AS (SELECT k AS node, k AS seen FROM u UNION SELECT r.node, p.b FROM r JOIN p ON p.a = r.seen),
    c AS (SELECT node, min(vec_id) AS component_id FROM r JOIN v ON v.k = r.seen GROUP BY node), n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(vec_id = coalesce(component_id, vec_id), true) AS kept FROM v LEFT JOIN c ON c.node = v.k LEFT JOIN n ON n.a = v.k"""
