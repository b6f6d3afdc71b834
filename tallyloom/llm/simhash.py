"""Near-duplicates by SimHash, found by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most three bits differ in at most two bits once a suitable one of three blocks
of bits is left out (any block that holds a difference; any block at all if they are equal).  Over the
remaining bits the radius is two, so each side walks half of it: every fingerprint emits, per left-out block, all
variants within one bit of it, and two such fingerprints meet at a common variant.  The variants are shuffled, and
fingerprints that collide are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import components, row_numbers, store

RADIUS, SEED = 3, 42
BLOCKS = ((0, 22), (22, 43), (43, 64))
SLICE = 1 << 16


def fingerprint(text: str | None) -> int:
    """SimHash over the 3-word shingles of a text, as a signed 64-bit number.

    A-Z count as a-z.  Fewer than three words are one shingle; no words (also null) give zero.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < 3 else map(b" ".join, zip(words, words[1:], words[2:]))
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), SLICE):
        ones += np.unpackbits(hashes[i : i + SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = pa.array((fingerprint(t.as_py()) for t in batch.column(2)), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps], names=["rid", "doc_id", "fp"])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _balls() -> list[tuple[int, int]]:
    """(mask, flip) for each variant: ``fp & mask ^ flip``; the left-out block holds the block's number."""
    out = []
    for n, (low, high) in enumerate(BLOCKS):
        rest = ((1 << 64) - 1) ^ (((1 << high) - 1) ^ ((1 << low) - 1))
        flips = [0, *(1 << i for i in range(64) if not low <= i < high)]
        out += [(_signed(rest), _signed(f ^ (n << low))) for f in flips]
    return out


def forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the fingerprints linked within one list: at most one per fingerprint, memory linear."""
    a, b, todo = [], [], fps
    while len(todo):
        front, todo = [todo[0]], todo[1:]
        while front and len(todo):
            at = front.pop()
            near = np.bitwise_count(todo ^ at) <= RADIUS
            if near.any():
                found = todo[near]
                todo = todo[~near]
                a.append(np.full(len(found), at))
                b.append(found)
                front.extend(found)
    none = np.empty(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by variant and fingerprint -> links inside each run of equal variants."""
    key, fp = np.empty(0, np.int64), np.empty(0, np.int64)

    def links(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(key) < 2:
            return
        cut = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.r_[0, cut], np.r_[cut, len(key)]
        sizes = ends - starts
        two = starts[sizes == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= RADIUS]
        a, b = [fp[two]], [fp[two + 1]]
        for i in np.flatnonzero(sizes > 2):
            x, y = forest(fp[starts[i] : ends[i]])
            a.append(x)
            b.append(y)
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        key = np.r_[key, batch.column(0).to_numpy()]
        fp = np.r_[fp, batch.column(1).to_numpy()]
        if len(key) and key[0] != key[-1]:
            last = int(np.searchsorted(key, key[-1]))  # the last run may go on in the next batch
            yield from links(key[:last], fp[:last])
            key, fp = key[last:], fp[last:]
    yield from links(key, fp)


def links(fps: DataFrame) -> DataFrame:
    """Distinct long column ``fp`` -> edges (``a``, ``b``) that connect all fingerprints within the radius.

    Inside a run of colliding variants only a spanning forest of the verified links goes out, never all pairs.
    """
    balls = F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(x).cast("long").alias("flip")) for m, x in _balls()])
    variants = fps.select("fp", F.explode(balls).alias("v")).select(F.col("fp").bitwiseAND(F.col("v.mask")).bitwiseXOR(F.col("v.flip")).alias("variant"), "fp")
    runs = variants.repartition("variant").sortWithinPartitions("variant", "fp")
    return runs.mapInArrow(_collide, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``rid`` (the row's number), ``fp`` (long), ``fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the smallest id reachable over links of at most three differing bits.  Null and empty texts
    have fingerprint zero and are linked like any other; rows with equal fingerprints are one node of the
    graph whatever their number; repeated rows come out as often as they went in; a null id never is a
    component's id unless all its ids are null; an empty table gives an empty result.  Other columns are ignored.
    """
    texts = docs.select(row_numbers(docs).alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = store(texts.mapInArrow(_fingerprints, "rid long, doc_id long, fp long"), "fingerprints")
    nodes = store(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-nodes")
    roots = components(links(nodes.select("fp"))).select(F.col("node").alias("fp"), "root")
    placed = nodes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(lowest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "rid", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
