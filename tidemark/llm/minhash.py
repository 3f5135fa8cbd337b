"""Near-duplicate documents by a MinHash LSH forest.

Method: a document's set is its distinct five-word shingles.  Its MinHash signature is read in
``ORDERS`` orders, each a path of ``DEPTH`` values of its own (the first ``STEP`` of them in no other
order's first ``STEP``).  The paths of every order are sorted, and each node's longest common prefix
with its two neighbours tells how deep it has company; nodes without company at depth ``SHALLOW``
are done.  The depth of a region follows what stands there: thin ones, of at most ``thin`` shingles,
stay at ``SHALLOW``, others go down to ``STEP``, and what is larger than ``limit`` goes further, to
the end of the path.  Every region's documents are tested on their full sets until each pair between
different components has been tested (``regions.py``), so all links inside regions count, and a link
is never made without a test; pairs of a large region that its deeper levels part are tested at the
end.  Equal sets are one node, however many copies there are.

With 32 orders of 6 values a pair at the least similarity s shares no region with probability
(1 - s^6)^32 at most: 3e-7 at 0.85, 6e-5 at 0.8.  Shingles and equal sets are told apart by 64-bit
hashes, the values of a path by 16 bits (equal by chance once in 65,536, which adds tests and no link).

Defined cases: a document with fewer than ``width`` words is one shingle, the whole sequence; a
document without words (null and empty texts) has no set and links with nothing; a null id takes no
part (component null, kept true); rows that share an id but not a text are told apart by a hash of the
text, so one id for all rows costs what an id each does; repeated rows each get their own result row; texts are read whole, and a task that tests holds the sets of one
region; extra columns, whatever their names, are ignored; an empty table is empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .regions import components_by_regions, regions_with_company
from .storage import stored

ORDERS, STEP, WIDTH = 32, 6, 5
#: Values of a path, depth of thin regions.
DEPTH, SHALLOW = 12, 5
#: Shingles of a region that one task holds, and of a thin region.
LIMIT, THIN = 2_000_000, 20_000
ROUNDS = [[0, 1], [*range(2, 8)], [*range(8, ORDERS)]]
_rng = np.random.default_rng(20240817)
_A = _rng.integers(0, 1 << 63, ORDERS * STEP, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, ORDERS * STEP, dtype=np.uint64)
_C = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OWN = np.arange(ORDERS * STEP).reshape(ORDERS, STEP)
#: The signature's places that each order reads: its own, then some of the others'.
_PATHS = np.array([[*own, *_rng.permutation(np.setdiff1d(_OWN, own))[: DEPTH - STEP]] for own in _OWN])


class _WordHashes(dict):
    """64-bit hash of a word's bytes, kept for the frequent ones."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles: A-Z lower-cased, words between ASCII white space."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    total = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        total += h[k : len(h) - n + 1 + k] * _C[k]
    return np.unique(_mixed(total))


def signature(s: np.ndarray) -> np.ndarray:
    """The MinHash values of a set, 16 bits of each."""
    low = np.full(ORDERS * STEP, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 2048):
        part = s[at : at + 2048]
        np.minimum(low, (_A[:, None] * part[None, :] + _B[:, None]).min(axis=1), out=low)
    return (_mixed(low) >> np.uint64(48)).astype(">u2")


def _node(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def _features(width: int):
    def run(batches):
        for batch in batches:
            counts, sets, signatures = [], [], []
            for text in batch.column(2).to_pylist():
                s = shingles(text, width)
                counts.append(len(s))
                sets.append(_node(s.tobytes()) if len(s) else None)
                signatures.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(counts, pa.int64()), pa.array(sets, pa.int64()), pa.array(signatures, pa.binary())], ["id", "row", "n_shingles", "node", "signature"])

    return run


_LEVELS = ["k1", "k2", "k3"]


def _unfold(batches):
    """A row for each node and order; the path is three longs of four values each."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            values = np.frombuffer(b"".join(part.column(2).to_pylist()), ">u2").reshape(-1, ORDERS * STEP)
            paths = np.ascontiguousarray(values[:, _PATHS]).reshape(-1, DEPTH).view(">u8").astype(np.uint64).view(np.int64)
            each = lambda k, part=part: np.repeat(part.column(k).to_numpy(), ORDERS)
            order = np.tile(np.arange(ORDERS, dtype=np.int32), part.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (order, *np.ascontiguousarray(paths.T), each(0), each(1))], ["t", *_LEVELS, "node", "weight"])


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Values that each row of a sorted run has in common with the row before it, from the second row on."""
    values = np.ascontiguousarray(np.stack(levels, axis=1)).view(np.uint64).astype(">u8").view(">u2")
    same = np.logical_and.accumulate(values[1:] == values[:-1], axis=1).sum(axis=1)
    return np.where(order[1:] == order[:-1], same, 0)


def _with_company(batches):
    """Rows of sorted paths that share ``SHALLOW`` values or more with a neighbour.  The neighbours of a partition's first and
    last row stand in other partitions, so these two stay; regions are counted afterwards."""
    held: pa.Table | None = None
    before = DEPTH
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        columns = [rows.column(k).to_numpy() for k in ("t", *_LEVELS)]
        same = common_prefixes(columns[0], columns[1:])
        company = np.maximum(np.concatenate([[before], same])[:-1], same)
        yield from rows.slice(0, len(same)).filter(pa.array(company >= SHALLOW)).combine_chunks().to_batches()
        held, before = rows.slice(len(same)), int(same[-1]) if len(same) else before
    if held is not None:
        yield from held.combine_chunks().to_batches()


def forest_regions(classes: DataFrame, thin: int = THIN) -> DataFrame:
    """(t, k1, k2, k3, node, weight, held): regions with company of every order, and the keys of their deeper levels."""
    rows = "t int, k1 long, k2 long, k3 long, node long, weight long"
    paths = classes.select("node", "weight", "signature").mapInArrow(_unfold, rows)
    near = stored(paths.repartitionByRange("t", *_LEVELS).sortWithinPartitions("t", *_LEVELS).mapInArrow(_with_company, rows), "forest")
    shallow = [F.col("t"), F.col("k1"), F.shiftright("k2", 64 - 16 * (SHALLOW - 4)).alias("top")]
    sums = near.groupBy(*shallow).agg(F.sum("weight").alias("around"))
    each = near.withColumn("top", F.shiftright("k2", 64 - 16 * (SHALLOW - 4))).join(sums, ["t", "k1", "top"])
    region = F.when(F.col("around") <= thin, F.xxhash64("k1", "top", F.lit(SHALLOW))).otherwise(F.xxhash64("k1", F.shiftright("k2", 64 - 16 * (STEP - 4)), F.lit(STEP)))
    keys = each.select("t", region.alias("k1"), F.xxhash64("k1", "k2", F.shiftright("k3", 48)).alias("k2"), F.xxhash64("k1", "k2", "k3").alias("k3"), "node", "weight")
    return stored(regions_with_company(keys, ["t", "k1"]), "regions")


def _full_sets(width: int):
    def run(batches):
        for batch in batches:
            sets = [shingles(t, width).tobytes() for t in batch.column(1).to_pylist()]
            own = [_node(s) == node for s, node in zip(sets, batch.column(0).to_pylist(), strict=True)]  # rows that share an id may bring other sets
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "payload"]).filter(pa.array(own, pa.bool_()))

    return run


def jaccard_linker(percent: int):
    """Tests of one set against a group's sets: 100 * intersection >= percent * union."""

    def linker(payloads: list[bytes]):
        sets = [np.frombuffer(p, np.uint64) for p in payloads]
        sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        if len(sets) == 2:
            both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
            linked = 100 * both >= percent * (sizes.sum() - both)
            return lambda x: np.array([linked, linked])
        _, codes = np.unique(flat, return_inverse=True)
        mark = np.zeros(codes.max() + 1, np.int64)

        def neighbours(x: int) -> np.ndarray:
            own = codes[starts[x] : starts[x] + sizes[x]]
            mark[own] = 1
            both = np.add.reduceat(mark[codes], starts)
            mark[own] = 0
            return 100 * both >= percent * (sizes + sizes[x] - both)

        return neighbours

    return linker


def near_duplicates(docs: DataFrame, *, percent: int = 80, width: int = WIDTH, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_shingles, component_id, kept.

    Links documents whose sets have 100 * intersection >= percent * union.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    features = stored(rows.mapInArrow(_features(width), "id long, row long, n_shingles long, node long, signature binary"), "features")
    sets = features.where("node is not null and id is not null")
    classes = stored(sets.groupBy("node").agg(F.min(F.struct("id", "row")).alias("least"), F.first("signature").alias("signature"), F.first("n_shingles").alias("weight")).select("node", "signature", "weight", F.col("least.id").alias("rep"), F.col("least.row").alias("row")), "classes")
    regions = forest_regions(classes)
    wanted = classes.join(regions.select("node").distinct(), "node", "left_semi").select("node", F.col("rep").alias("id"), "row")
    # a text is fetched by its id and hash: many texts under one id meet no set but their own
    texts = rows.join(wanted, ["id", "row"]).select("node", "text")
    payload = stored(texts.mapInArrow(_full_sets(width), "node long, payload binary").groupBy("node").agg(F.first("payload").alias("payload")), "sets")
    labels = components_by_regions(regions, payload, ROUNDS, jaccard_linker(percent), limit)
    named = classes.select("node", "rep")
    if labels is None:
        named = named.withColumn("component", F.col("node"))
    else:
        named = named.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_class = named.join(least, "component").select("node", "component_id")
    out = features.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.col("node")).alias("node")).join(by_class, "node", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def oracle(percent: int, width: int = WIDTH) -> str:
    """DuckDB SQL for the table documents: pairs by shared shingles, for tables of some thousand documents."""
    return rf"""
    WITH RECURSIVE w AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
    s AS (SELECT doc_id, k, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {width} THEN [array_to_string(words, ' ')] ELSE list_distinct([array_to_string(words[i:i + {width - 1}], ' ') FOR i IN range(1, len(words) - {width - 2})]) END AS shingles FROM w),
    g AS (SELECT min(k) AS k, hash(list_sort(shingles)) AS h, min(len(shingles)) AS n, any_value(shingles) AS shingles FROM s WHERE doc_id IS NOT NULL AND len(shingles) > 0 GROUP BY list_sort(shingles)),
    x AS (SELECT k, n, unnest(shingles) AS shingle FROM g),
    p AS (SELECT a.k AS a, b.k AS b FROM x a JOIN x b ON a.shingle = b.shingle AND a.k <> b.k GROUP BY a.k, b.k HAVING 100 * count(*) >= {percent} * (min(a.n) + min(b.n) - count(*))),
    r AS (SELECT k AS node, k AS seen FROM g UNION SELECT r.node, p.b FROM r JOIN p ON p.a = r.seen),
    m AS (SELECT s.doc_id, s.k, g.k AS rep FROM s JOIN g ON g.h = hash(list_sort(s.shingles)) WHERE s.doc_id IS NOT NULL AND len(s.shingles) > 0),
    c AS (SELECT r.node, min(m.doc_id) AS component_id FROM r JOIN m ON m.rep = r.seen GROUP BY r.node)
    SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id, coalesce(s.doc_id = coalesce(c.component_id, s.doc_id), true) AS kept FROM s LEFT JOIN m ON m.k = s.k LEFT JOIN c ON c.node = m.rep"""
