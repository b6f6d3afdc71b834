"""Alignment of two tokenizers by galloping intersection of their token ends.

Every text is encoded by both.  The shorter list of byte ends drives exponential and binary search into the longer
one; ends found in both cut the tokens into groups, and the difference of neighbouring ranks is the range of tokens
that a driving token overlaps.

The links of a document are stored once, with how often each id pair is linked there.  How many documents hold a pair
is counted with map-side combine; the counts are bounded by the two vocabularies, not by the corpus, and come back to
the documents in parts of at most ``PART`` pairs, each small enough to broadcast, so the links are never shuffled.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.bytebpe import byte_bpe
from tallyloom.llm.common import row_numbers, store

#: Pairs broadcast at once: 25 bytes each in a row, at most 50 MB.
PART = 2_000_000
ENCODE_BYTES = 1 << 20  # text handed to the tokenizers at once
_tokenizers: dict[tuple[str, str], "Tokenizers"] = {}


class Tokenizers:
    """Both tokenizers with the bytes of every token: ``a`` is byte-level BPE, ``b`` pieces with byte fallback."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece

        self.a = byte_bpe(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = self.a.entries
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces]
        self.size_a = np.array([len(t) for t in self.bytes_a])
        self.size_b = np.array([len(t) for t in self.bytes_b])

    def __call__(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of each text by both; none where the text is empty or the tokens' bytes are not a space and the text."""
        for text, b in zip(texts, self.b.encode(texts, num_threads=1)):
            a, whole = self.a(" " + text, special=False), b" " + text.encode()
            same = text and b"".join(map(self.bytes_a.__getitem__, a)) == whole == b"".join(map(self.bytes_b.__getitem__, b))
            yield (np.array(a, np.int64), np.array(b, np.int64)) if same else (np.empty(0, np.int64), np.empty(0, np.int64))


def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    if (path_a, path_b) not in _tokenizers:
        _tokenizers[path_a, path_b] = Tokenizers(path_a, path_b)
    return _tokenizers[path_a, path_b]


def gallop(short: list[int], long: list[int]) -> list[int]:
    """For each value of a rising list, how many values of another rising list are smaller.

    The search starts where the last one ended, doubles its step until it has passed the value, and halves the bracket.
    """
    ranks, low, n = [], 0, len(long)
    for x in short:
        high, step = low, 1
        while high < n and long[high] < x:
            low = high + 1
            high += step
            step += step
        low = bisect_left(long, x, low, min(high, n))
        ranks.append(low)
    return ranks


def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) for every j from ``first[i]`` to ``last[i]``."""
    sizes = last - first + 1
    i = np.repeat(np.arange(len(first)), sizes)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(sizes) - sizes - first, sizes)


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping tokens as indices (i, j), and the indices of the tokens whose ends both lists hold.

    The lists rise strictly and end alike.
    """
    swap = len(ends_b) < len(ends_a)
    short, long = (ends_b, ends_a) if swap else (ends_a, ends_b)
    if not len(short):
        none = np.empty(0, np.int64)
        return none, none, none, none
    rank = np.array(gallop(short.tolist(), long.tolist()), np.int64)
    common = long[rank] == short
    i, j = spread(np.r_[0, (rank + common)[:-1]], rank)
    at_short, at_long = np.flatnonzero(common), rank[common]
    return (j, i, at_long, at_short) if swap else (i, j, at_short, at_long)


class Writer:
    """Writes groups of ids as ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self, ids: int) -> None:
        width = len(str(ids))
        self.digits = np.array([list(str(i).ljust(width + 1, "\0").encode()) for i in range(ids)], np.uint8)

    def __call__(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> bytes:
        """``at_a`` and ``at_b`` are the last tokens of each group."""
        if not len(a):
            return b""
        group_a = np.searchsorted(at_a, np.arange(len(a)))
        group_b = np.searchsorted(at_b, np.arange(len(b)))
        place_a = np.arange(len(a)) + np.r_[0, at_b + 1][group_a]
        place_b = np.arange(len(b)) + at_a[group_b] + 1
        rows = np.empty((len(a) + len(b), self.digits.shape[1]), np.uint8)
        rows[place_a], rows[place_b] = self.digits[a], self.digits[b]
        rows[:, -1] = ord(",")
        rows[place_a[at_a], -1] = ord("|")
        rows[place_b[at_b], -1] = ord(";")
        flat = rows.ravel()
        return flat[flat != 0][:-1].tobytes()


def links(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: ``rid``, ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256``, ``pairs``.

    ``pairs`` holds the distinct linked ids (``a``, ``b``) and how often they are linked (``n``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(path_a, path_b)
        write, base = Writer(max(len(both.bytes_a), len(both.bytes_b))), len(both.bytes_b)

        def table(rids: list[int], doc_ids: list[int | None], texts: list[str]) -> pa.RecordBatch:
            rows, keys, times, shas = [], [], [], []
            for a, b in both(texts):
                i, j, at_a, at_b = align(np.cumsum(both.size_a[a]), np.cumsum(both.size_b[b]))
                key, n = np.unique(a[i] * base + b[j], return_counts=True)
                keys.append(key)
                times.append(n)
                rows.append((len(a), len(b), len(at_a), len(i)))
                shas.append(hashlib.sha256(write(a, b, at_a, at_b)).hexdigest() if len(a) else "")
            key, n = np.concatenate(keys), np.concatenate(times)
            struct = pa.StructArray.from_arrays([pa.array((key // base).astype(np.int32)), pa.array((key % base).astype(np.int32)), pa.array(n.astype(np.int32))], names=["a", "b", "n"])
            pairs = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), struct)
            counts = [pa.array(c, pa.int64()) for c in zip(*rows)]
            names = ["rid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"]
            return pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(doc_ids, pa.int64()), *counts, pa.array(shas), pairs], names=names)

        for batch in batches:
            rids, doc_ids, texts, size = [], [], [], 0
            for rid, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                rids.append(rid)
                doc_ids.append(doc_id)
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= ENCODE_BYTES:
                    yield table(rids, doc_ids, texts)
                    rids, doc_ids, texts, size = [], [], [], 0
            if rids:
                yield table(rids, doc_ids, texts)

    schema = "rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<a:int,b:int,n:int>>"
    return docs.select(row_numbers(docs).alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pair_counts(linked: DataFrame) -> DataFrame:
    """``a``, ``b``, ``docs`` (how many documents hold the pair linked) and ``best`` (no pair of ``a`` is in more documents)."""
    counts = linked.select(F.explode("pairs").alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("docs"))
    counts = store(counts, "pair-counts")
    highest = counts.groupBy("a").agg(F.max("docs").alias("top"))
    return counts.join(highest, "a").select("a", "b", "docs", (F.col("docs") == F.col("top")).alias("best"))


def alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", part: int = PART) -> DataFrame:
    """One row per document row: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``, ``rid``.

    ``n_best`` counts links whose id pair is in as many documents as any pair of its A id; ``count_sum`` adds the pairs'
    document counts over all links.  Texts that are null or empty, or that a tokenizer changes (its tokens' bytes are
    not a space and the text), have no tokens: zeros and an empty hash.  Repeated rows are documents of their own; a null
    id stays null; an empty table gives an empty result.  Other columns are ignored.  The table is read once; ``rid``
    numbers its rows.
    """
    linked = store(links(docs, path_a, path_b, id_col, text_col), "links")
    counts = store(pair_counts(linked), "pairs")
    parts = max(1, -(-counts.count() // part))

    def of(df: DataFrame, n: int) -> DataFrame:
        return df.where(F.pmod(F.hash("a", "b"), F.lit(parts)) == n) if parts > 1 else df

    pairs = linked.select("rid", F.explode("pairs").alias("p")).select("rid", "p.*")
    sums = None
    for n in range(parts):
        met = of(pairs, n).join(F.broadcast(of(counts, n)), ["a", "b"]).groupBy("rid")
        met = met.agg(F.sum(F.when(F.col("best"), F.col("n").cast("long")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum"))
        sums = met if sums is None else sums.unionByName(met)
    sums = sums.groupBy("rid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = linked.drop("pairs").join(sums, "rid", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256", "rid")
