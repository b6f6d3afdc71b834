"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Distinct vectors are normalised and quantised to int8, once, with a scale of their own.  They are grouped by their nearest
pivot; pairs of groups whose angle rules out the threshold are left out.  A group is cut into blocks, and only the codes, the
scales and the errors of a block travel to the pairs of blocks it is in.  There, tiles of codes are multiplied (products of
small integers, exact in the type used); each vector's exact quantisation error bounds how far off a cosine can be, and
what leaves is the vectors that may reach the threshold with any other of the pair.  The full vectors of these alone are
joined in, and their possible pairs are recomputed in double precision.

Inside a pair of blocks only counts and a spanning set of links leave the task, never all links of a dense group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import components, store

THRESHOLD = 0.9
TILE = 2048  # vectors on either side of one product
BLOCK = 8 * TILE  # vectors in a block, about
BLOCK_BYTES = 1 << 22  # codes in a block, about: long vectors make smaller blocks
PIVOTS = 16, 1024  # fewest and most vectors that group the others: one per block of the table in between
SLICE = 100_000  # pairs recomputed at once
SLACK = 1e-5  # float32 rounding of the scaled product
EXACT32 = 1040  # products of int8 codes up to this length are exact in float32; longer ones use float64


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision; the largest component goes first, against overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes, scale and the length of what the codes miss, per unit vector."""
    scale = np.abs(u).max(axis=1) / 127
    q = np.rint(u / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(((u - q * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-12)


def possible(a: tuple, b: tuple, threshold: float) -> np.ndarray:
    """Matrix of the pairs that may reach the threshold, from (codes, scales, errors) of two tiles."""
    exact = np.float32 if a[0].shape[1] <= EXACT32 else np.float64
    near = a[0].astype(exact) @ b[0].T.astype(exact)
    near *= a[1][:, None].astype(exact)
    near *= b[1][None].astype(exact)
    return near >= threshold - SLACK - a[2][:, None] * (1 + b[2][None]) - b[2][None]


def linked_pairs(a: np.ndarray, b: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two tiles of unit vectors with a cosine of at least the threshold (i < j within one tile)."""
    may = possible(quantise(a), quantise(b), threshold)
    i, j = np.nonzero(np.triu(may, 1) if same else may)
    sure = np.concatenate([np.einsum("ij,ij->i", a[i[s : s + SLICE]], b[j[s : s + SLICE]]) >= threshold for s in range(0, len(i), SLICE)] or [np.zeros(0, bool)])
    return i[sure], j[sure]


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest index that each of ``n`` nodes reaches over the links."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        old = root.copy()
        for side in (i, j):
            np.minimum.at(root, old[side], low)
            np.minimum.at(root, side, low)
        root = root[root]
        if (root == old).all():
            break
    return root


def _block(table: pa.Table) -> pa.Table:
    """One block: ids, codes, scales and errors of its vectors as four blobs."""
    table = table.sort_by("node")
    flat = [table.column(c).to_numpy().tobytes() for c in ("node", "scale", "error")]
    return pa.table({"block": table.column("block")[:1], "ids": [flat[0]], "codes": [b"".join(table.column("codes").to_pylist())], "scales": [flat[1]], "errors": [flat[2]]})


def _tiled(n: int, tile: int) -> list[slice]:
    return [slice(s, s + tile) for s in range(0, n, tile)]


def _candidates(threshold: float, tile: int):
    """Pair of blocks -> the vectors that may reach the threshold with one of the other block (or of the same, if it is one)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("side")
        sides = []
        for r in table.select(["ids", "codes", "scales", "errors"]).to_pylist():
            ids = np.frombuffer(r["ids"], np.int64)
            sides.append((ids, np.frombuffer(r["codes"], np.int8).reshape(len(ids), -1), np.frombuffer(r["scales"]), np.frombuffer(r["errors"])))
        one = len(sides) == 1
        a, b = sides[0], sides[-1]
        hit_a, hit_b = np.zeros(len(a[0]), bool), np.zeros(len(b[0]), bool)
        for s in _tiled(len(a[0]), tile):
            for t in _tiled(len(b[0]), tile):
                if one and t.start < s.start:
                    continue
                may = possible(tuple(x[s] for x in a[1:]), tuple(x[t] for x in b[1:]), threshold)
                if one and s == t:
                    np.fill_diagonal(may, False)
                hit_a[s] |= may.any(axis=1)
                hit_b[t] |= may.any(axis=0)
        if one:
            hit_a, hit_b = hit_a | hit_b, hit_b[:0]
        ids = np.r_[a[0][hit_a], b[0][: len(hit_b)][hit_b]]
        side = np.r_[np.zeros(hit_a.sum(), np.int32), np.ones(hit_b.sum(), np.int32)]
        n = len(ids)
        return pa.table({"b1": np.repeat(table.column("b1").to_numpy()[:1], n), "b2": np.repeat(table.column("b2").to_numpy()[:1], n), "side": side, "node": ids})

    return run


def _exact(threshold: float, tile: int):
    """Candidates of a pair of blocks with their full vectors -> links and a spanning set of them."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("node", "ascending")])
        ids, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        x = unit(table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1))
        cut = int((table.column("side").to_numpy() == 0).sum())
        one = table.column("b1")[0] == table.column("b2")[0]
        links, edges = np.zeros(len(ids), np.int64), [np.zeros((2, 0), np.int64)]
        for s in _tiled(cut, tile):
            s = slice(s.start, min(s.stop, cut))
            for t in _tiled(len(ids) if one else len(ids) - cut, tile):
                t = t if one else slice(t.start + cut, t.stop + cut)
                if one and t.start < s.start:
                    continue
                i, j = linked_pairs(x[s], x[t], s.start == t.start, threshold)
                i, j = i + s.start, j + t.start
                links += np.bincount(i, copies[j], len(ids)).astype(np.int64) + np.bincount(j, copies[i], len(ids)).astype(np.int64)
                near, at = np.unique(np.r_[i, j], return_inverse=True)
                root = near[spanning(at[: len(i)], at[len(i) :], len(near))] if len(near) else near
                edges.append(np.stack([near, root]))
        i, j = np.concatenate(edges, axis=1)
        root = spanning(i, j, len(ids))
        hit = links > 0
        return pa.table({"node": ids[hit], "links": links[hit], "root": ids[root[hit]]})

    return run


def links(nodes: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """Stored (node, v, copies), one row per distinct vector of one length -> (node, links, root), summed per pair of blocks.

    ``links`` counts copies of linked vectors; (node, root) are edges that connect what is linked.
    """
    spark, size = nodes.sparkSession, nodes.count()
    sample = nodes.orderBy(F.xxhash64("node", "v"), "node").limit(max(PIVOTS[0], min(PIVOTS[1], size // block))).select("v").toArrow().column("v").to_pylist()
    if not sample:
        return nodes.select("node", F.lit(0).cast("long").alias("links"), F.col("node").alias("root")).limit(0)
    pivots = unit(np.array(sample, float))
    block = max(1, min(block, BLOCK_BYTES // pivots.shape[1]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                at = (x @ pivots.T).argmax(axis=1)
                angle = np.arccos(np.clip(np.einsum("ij,ij->i", x, pivots[at]), -1, 1))
                q, scale, error = quantise(x)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in q], pa.binary()), pa.array(scale), pa.array(error), pa.array(at), pa.array(angle)], names=["node", "codes", "scale", "error", "cell", "angle"])

    placed = store(nodes.select("node", "v").mapInArrow(place, "node long, codes binary, scale double, error double, cell long, angle double"), "placed")
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).orderBy("cell").toPandas()  # a row per pivot
    cells["blocks"] = -(-cells["n"] // block)
    cells["first"] = cells["blocks"].cumsum() - cells["blocks"]
    found = cells["cell"].to_numpy()
    gap = np.arccos(np.clip(pivots[found] @ pivots[found].T, -1, 1))
    radius = cells["radius"].to_numpy()
    a, b = np.nonzero(np.triu(gap <= radius[:, None] + radius[None] + math.acos(threshold) + 1e-6) | np.eye(len(found), dtype=bool))
    where = spark.createDataFrame(cells[["cell", "first", "blocks"]].astype("int64"))
    blocks = placed.join(F.broadcast(where), "cell").withColumn("block", F.col("first") + F.pmod(F.xxhash64("node"), F.col("blocks")))
    blocks = blocks.select("block", "node", "codes", "scale", "error").groupBy("block").applyInArrow(_block, "block long, ids binary, codes binary, scales binary, errors binary")
    blocks = store(blocks, "blocks")
    # cells in reach of each other, at most PIVOTS of them squared; their blocks are paired on the executors, none twice
    first, last = cells["first"].to_numpy(), (cells["first"] + cells["blocks"] - 1).to_numpy()
    reach = spark.createDataFrame(pa.table({"a1": first[a], "a2": last[a], "c1": first[b], "c2": last[b]}))
    pairs = reach.repartition(F.col("a1"), F.col("c1")).withColumn("b1", F.explode(F.sequence("a1", "a2")))
    pairs = pairs.withColumn("b2", F.explode(F.sequence("c1", "c2"))).where("b2 >= b1").select("b1", "b2")
    sides = F.when(F.col("b1") == F.col("b2"), F.array(F.struct(F.lit(0).alias("side"), F.col("b1").alias("block"))))
    sides = sides.otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("b1").alias("block")), F.struct(F.lit(1).alias("side"), F.col("b2").alias("block"))))
    met = pairs.select("b1", "b2", F.inline(sides)).join(blocks.hint("merge"), "block").drop("block")
    near = store(met.groupBy("b1", "b2").applyInArrow(_candidates(threshold, tile), "b1 long, b2 long, side int, node long"), "candidates")
    full = near.join(nodes.select("node", "copies", "v").hint("merge"), "node")
    return full.groupBy("b1", "b2").applyInArrow(_exact(threshold, tile), "node long, links long, root long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    ``n_links`` counts the other rows with a cosine of at least the threshold, exact copies included; ``component_id`` is
    the smallest id reachable.  Vectors that are null, empty, zero, or hold null or non-finite components, and rows
    without an id, link with nothing; vectors of different lengths are never compared; rows that share an id are one
    node; an empty table gives an empty result.  Other columns are ignored.
    """
    v = F.col(vec_col).cast("array<double>")
    fine = F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    rows = store(rows.withColumn("ok", F.coalesce(fine, F.lit(False))).withColumn("h", F.xxhash64("v")), "vectors")
    nodes = store(rows.where("ok").groupBy("h", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")), "vector-nodes")
    sizes = [r[0] for r in nodes.select(F.size("v")).distinct().collect()]  # the lengths of vectors, a handful
    found = None
    for n in sizes or [0]:
        part = links(nodes.where(F.size("v") == n), threshold)
        found = part if found is None else found.union(part)
    found = store(found, "vector-links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = nodes.join(counts, "node", "left").join(roots, "node", "left")
    named = named.select("h", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"), F.lit(True).alias("ok"))
    out = rows.join(named.hint("merge"), ["h", "v", "ok"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


ORACLE = r"""
WITH RECURSIVE v AS (
    SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
        AND len(list_filter(embedding, lambda y: y <> 0)) > 0
), e AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.9
), r(node, root) AS (
    SELECT vec_id, vec_id FROM v
    UNION
    SELECT e.b, r.root FROM r JOIN e ON r.node = e.a
), c AS (SELECT node, min(root) AS root FROM r GROUP BY node
), n AS (SELECT a, count(*) AS n_links FROM e GROUP BY a
)
SELECT m.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, coalesce(c.root, m.vec_id) AS component_id, m.vec_id = coalesce(c.root, m.vec_id) AS kept
FROM embeddings m LEFT JOIN c ON m.vec_id = c.node LEFT JOIN n ON m.vec_id = n.a
"""
