"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Documents are cut into full windows and a tail.  Each task packs the tails of a chunk of its documents: a tail alone
is a partial partition (one used window, the others empty); the two partial partitions with the largest imbalance
are merged, the fullest windows of one with the emptiest of the other, until one near-equal partition is
left.  What exceeds the capacity is cut off its window, and the cut pieces are one more partial partition to merge;
when that no longer fits, the window count rises.  There is no shuffle, and a lost task only runs again.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.bytebpe import byte_bpe

CAPACITY, END = 1024, 0
CHUNK_DOCS = 2000  # documents packed together

Piece = tuple[int, int, int]  # item, start in the item, length


def _merge(a: tuple, b: tuple, k: int) -> tuple:
    """Merge two partial partitions (sizes falling, contents) of ``k`` windows with opposing imbalances."""
    (x, xs), (y, ys) = a, b
    both = len(x) + len(y) - k
    if both <= 0:
        sizes, parts = np.r_[x, y], xs + ys
    else:
        y, ys = y[::-1], ys[::-1]
        alone = len(x) - both
        sizes = np.r_[x[:alone], x[alone:] + y[:both], y[both:]]
        parts = xs[:alone] + [(p, q) for p, q in zip(xs[alone:], ys[:both])] + ys[both:]
    order = np.argsort(-sizes, kind="stable")
    return sizes[order], [parts[i] for i in order]


def difference(pieces: list[Piece], k: int) -> tuple[np.ndarray, list]:
    """Largest differencing: one partition of the pieces into at most ``k`` windows, as (sizes falling, contents)."""
    heap = [(-p[2], n, (np.array([p[2]]), [p])) for n, p in enumerate(sorted(pieces, key=lambda p: (-p[2], p)))]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        merged = _merge(a, b, k)
        spread = int(merged[0][0]) - (int(merged[0][-1]) if len(merged[0]) == k else 0)
        heapq.heappush(heap, (-spread, n, merged))
        n += 1
    return heap[0][2] if heap else (np.empty(0, np.int64), [])


def _flat(part: tuple) -> list[Piece]:
    """The pieces of a window; a window is a piece or a pair of windows."""
    out, todo = [], [part]
    while todo:
        p = todo.pop()
        if isinstance(p[0], tuple):
            todo += p
        else:
            out.append(p)
    return out


def pack_tails(lengths: list[int], capacity: int = CAPACITY, rounds: int = 8) -> list[list[Piece]]:
    """Windows of pieces (item, start, length) that hold every token of every item once, none over ``capacity``."""
    pieces = [(i, 0, n) for i, n in enumerate(lengths) if n]
    k = max(1, -(-sum(lengths) // capacity))
    sizes, parts = difference(pieces, k)
    windows = [_flat(p) for p in parts]
    tried = 0
    while sizes.size and int(sizes.max()) > capacity:
        tried += 1
        if tried % rounds == 0:
            k += 1
        cut: list[Piece] = []
        for w, over in zip(windows, sizes - capacity):
            w.sort(key=lambda p: (p[2], p))
            over = int(over)
            while over > 0:
                item, start, n = w.pop()
                if n > over:
                    w.append((item, start, n - over))
                    cut.append((item, start + n - over, over))
                else:
                    cut.append((item, start, n))
                over -= n
        sizes = np.minimum(sizes, capacity)
        order = np.argsort(-sizes, kind="stable")
        sizes, parts = _merge((sizes[order], [("w", i) for i in order]), difference(cut, k), k)
        new = []
        for p in parts:
            if p[0] == "w":
                new.append(windows[p[1]])
            elif isinstance(p[0], tuple) and p[0][0] == "w":
                new.append(windows[p[0][1]] + _flat(p[1]))
            else:
                new.append(_flat(p))
        windows = new
    return windows


def encode(path: str, text: str | None) -> np.ndarray:
    """Ids of a whole text and the end id, little-endian unsigned 32-bit."""
    return np.array([*byte_bpe(path)(text or "", special=True), END], "<u4")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    ``tokenizer`` is the path of a byte-level BPE's JSON file that every worker can read; ``with_ids`` adds the piece's ``ids``.
    Null and empty texts are one token, the end id; repeated rows are documents of their own; a null id stays
    null; an empty table gives an empty result.  Each chunk of documents pads less than a window or two; the
    numbers of the sequences are unique and follow the scan's partitions.  Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 33
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        rows: list[tuple] = []
        tails: list[tuple] = []

        def add(doc_id: int | None, start: int, ids: np.ndarray, tokens: int, offset: int) -> None:
            row = (doc_id, start, len(ids), zlib.crc32(ids.tobytes()), tokens, sequence, offset)
            rows.append((*row, ids.tolist()) if with_ids else row)

        def close() -> None:
            nonlocal sequence
            for window in pack_tails([len(t[2]) for t in tails], capacity):
                offset = 0
                for item, start, n in window:
                    doc_id, first, ids, tokens = tails[item]
                    add(doc_id, first + start, ids[start : start + n], tokens, offset)
                    offset += n
                sequence += 1
            tails.clear()

        def emit() -> pa.RecordBatch:
            types = [pa.int64()] * 7 + [pa.list_(pa.int64())] * with_ids
            columns = list(zip(*rows)) or [()] * len(types)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types)], names=names + ["ids"] * with_ids)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(tokenizer, text.as_py())
                full = len(ids) // capacity * capacity
                for start in range(0, full, capacity):
                    add(doc_id, start, ids[start : start + capacity], len(ids), 0)
                    sequence += 1
                if len(ids) > full:
                    tails.append((doc_id, full, ids[full:].copy(), len(ids)))
                if len(tails) >= CHUNK_DOCS:
                    close()
                if len(rows) >= 20_000:
                    yield emit()
        close()
        yield emit()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
