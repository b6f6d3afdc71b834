"""Exact removal of repeated word passages, found by difference-cover anchors.

A difference cover of a period holds, for any two positions, a shift below the period that takes both to cover
positions.  So if 50 words of one document equal 50 words of another, some anchor inside stands at a cover position in
both, wherever the passages begin.  Only the windows of ``ANCHOR`` words at cover positions are hashed and shuffled;
``ANCHOR + PERIOD - 1 <= WINDOW`` keeps an aligned anchor inside every passage.

Anchors that two different texts share are extended: each passage of ``WINDOW`` words around them is hashed with
128 bits, and a passage is removed from every document but the one with the smallest id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import row_numbers, spaced_words, store

WINDOW, PERIOD, ANCHOR = 50, 31, 20
COVER = (1, 5, 11, 24, 25, 27)  # every difference modulo 31 occurs between two of these
CHUNK = 1 << 18  # words hashed at once
CACHE = 500_000  # words remembered per task
LAST = (1 << 63) - 1  # what a null id counts as
EMPTY = hashlib.sha256(b"").hexdigest()
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolled(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash modulo 2**64 of every ``width`` consecutive word hashes."""
    if base not in _powers:
        up = np.full(CHUNK + WINDOW, base, np.uint64)
        down = np.full(CHUNK + WINDOW, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    up, down = _powers[base]
    out = []
    for low in range(0, len(h) - width + 1, CHUNK):
        piece = h[low : low + CHUNK + width - 1]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * up[: len(piece)], out=sums[1:])
        out.append((sums[width:] - sums[:-width]) * down[: len(piece) - width + 1])
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of a document and their hashes."""
    n = len(h) - ANCHOR + 1
    if len(h) < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = (np.arange(0, n, PERIOD)[:, None] + np.array(COVER)).ravel()
    at = at[at < n]
    return at, mixed(rolled(h, ANCHOR, BASES[0]))[at].view(np.int64)


def by_row(rid: np.ndarray, values: np.ndarray, kind: pa.DataType) -> tuple[np.ndarray, pa.ListArray]:
    """Distinct row numbers and the list of values of each."""
    order = np.argsort(rid, kind="stable")
    rid, values = rid[order], values[order]
    cut = np.r_[0, np.flatnonzero(np.diff(rid)) + 1, len(rid)]
    return rid[cut[:-1]], pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(values, kind))


def no_lists(n: int, kind: pa.DataType) -> pa.ListArray:
    """Empty lists; Spark hands null lists to a worker far more slowly than empty ones."""
    return pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], kind))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, text) -> (anchor, rid, many, done), each anchor once per batch.

    ``many`` tells that several texts of the batch hold it; the others of them go out together in ``done``, so an
    anchor that very many documents share crosses the shuffle once per batch.
    """
    known, names = WordHashes(), ["anchor", "rid", "many", "done"]
    for batch in batches:
        found = [np.unique(anchors(known.of(t.split()))[1]) for t in batch.column(1).to_pylist()]
        rid = np.repeat(batch.column(0).to_numpy(), [len(f) for f in found])
        anchor = np.concatenate([*found, np.empty(0, np.int64)])
        order = np.argsort(anchor, kind="stable")
        anchor, rid = anchor[order], rid[order]
        new = np.r_[True, anchor[1:] != anchor[:-1]][: len(anchor)]
        many = np.diff(np.r_[np.flatnonzero(new), len(anchor)]) > 1
        yield pa.RecordBatch.from_arrays([pa.array(anchor[new]), pa.array(rid[new]), pa.array(many), no_lists(len(many), pa.int64())], names=names)
        if not new.all():
            rows, lists = by_row(rid[~new], anchor[~new], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(rows), pa.array(np.ones(len(rows), bool)), lists], names=names)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor -> (rid, value): anchors that more than one text holds, with each of the texts."""
    anchor, rid, many = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def pick(anchor: np.ndarray, rid: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
        new = np.r_[True, anchor[1:] != anchor[:-1]][: len(anchor)]
        size = np.diff(np.r_[np.flatnonzero(new), len(anchor)])
        hit = many | np.repeat(size > 1, size)
        return pa.RecordBatch.from_arrays([pa.array(rid[hit]), pa.array(anchor[hit])], names=["rid", "value"])

    for batch in batches:
        done = batch.column(3).value_lengths().to_numpy() > 0
        if done.any():
            yield _flat(batch.column(1).filter(pa.array(done)), batch.column(3).filter(pa.array(done)))
        rest = batch.filter(pa.array(~done))
        anchor, rid, many = np.r_[anchor, rest.column(0).to_numpy()], np.r_[rid, rest.column(1).to_numpy()], np.r_[many, np.asarray(rest.column(2)).astype(bool)]
        if len(anchor) and anchor[0] != anchor[-1]:
            last = int(np.searchsorted(anchor, anchor[-1]))  # the last run may go on in the next batch
            yield pick(anchor[:last], rid[:last], many[:last])
            anchor, rid, many = anchor[last:], rid[last:], many[last:]
    yield pick(anchor, rid, many)


def _flat(rid: pa.Array, lists: pa.Array) -> pa.RecordBatch:
    values = lists.flatten()
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(rid.to_numpy(), lists.value_lengths().to_numpy())), values.cast(pa.int64())], names=["rid", "value"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by rid -> (rid, list of its values)."""
    rid, value = np.empty(0, np.int64), np.empty(0, np.int64)

    def lists(rid: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        rows, packed = by_row(rid, value, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(rows), packed], names=["rid", "list"])

    for batch in batches:
        rid, value = np.r_[rid, batch.column(0).to_numpy()], np.r_[value, batch.column(1).to_numpy()]
        if len(rid) and rid[0] != rid[-1]:
            last = int(np.searchsorted(rid, rid[-1]))
            yield lists(rid[:last], value[:last])
            rid, value = rid[last:], value[last:]
    if len(rid):
        yield lists(rid, value)


def gathered(values: DataFrame, name: str) -> DataFrame:
    """(rid, value) -> (rid, ``name``): the values of a row in one list, no longer than its text."""
    packed = values.repartition("rid").sortWithinPartitions("rid").mapInArrow(_pack, "rid long, list array<long>")
    return packed.withColumnRenamed("list", name)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, key, text, wanted anchors) -> passages around them: (w1, w2, key, rid, pos, done).

    A passage that a smaller key of the same batch holds is settled here: its positions go out together in
    ``done``, so a passage that very many documents share crosses the shuffle once per batch.
    """
    known = WordHashes()
    for batch in batches:
        columns: list[list] = [[], [], [], [], []]
        for rid, key, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
            h = known.of(text.split())
            at, a = anchors(h)
            at = at[np.isin(a, np.array(wanted, np.int64))]
            n = len(h) - WINDOW + 1
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, np.maximum(at - (WINDOW - ANCHOR), 0), 1)
            np.add.at(edge, np.minimum(at + 1, n), -1)
            pos = np.flatnonzero(np.cumsum(edge[:-1]))
            for column, x in zip(columns, (mixed(rolled(h, WINDOW, BASES[0]))[pos], mixed(rolled(mixed(h), WINDOW, BASES[1]))[pos], np.full(len(pos), key), np.full(len(pos), rid), pos)):
                column.append(x)
        if not columns[0]:
            continue
        w1, w2, key, rid, pos = (np.concatenate(c) for c in columns)
        order = np.lexsort((pos, rid, key, w2, w1))
        w1, w2, key, rid, pos = w1[order], w2[order], key[order], rid[order], pos[order]
        new = np.r_[True, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])]
        least = key[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(key) else key
        open_ = key == least
        rows = [pa.array(w1[open_].view(np.int64)), pa.array(w2[open_].view(np.int64)), pa.array(key[open_]), pa.array(rid[open_]), pa.array(pos[open_].astype(np.int32))]
        names = ["w1", "w2", "key", "rid", "pos", "done"]
        yield pa.RecordBatch.from_arrays([*rows, no_lists(len(rows[0]), pa.int32())], names=names)
        settled = ~open_
        if settled.any():
            rows, lists = by_row(rid[settled], pos[settled], pa.int32())
            ids, none = pa.array(rows), np.full(len(rows), -1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(none), pa.array(none), ids, pa.array(none.astype(np.int32)), lists], names=names)


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by passage and key -> (rid, value): positions whose passage a smaller key holds."""
    last, least = (None, None), 0
    for batch in batches:
        w1, w2, key, rid, pos = (batch.column(i).to_numpy() for i in range(5))
        settled = pos < 0
        if settled.any():
            yield _flat(batch.column(3).filter(pa.array(settled)), batch.column(5).filter(pa.array(settled)))
            w1, w2, key, rid, pos = (x[~settled] for x in (w1, w2, key, rid, pos))
        if not len(w1):
            continue
        new = np.r_[(w1[0], w2[0]) != last, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])]
        group = np.cumsum(new)
        heads = np.r_[least, key[new]]  # group 0 goes on from the batch before
        later = key > heads[group]
        last, least = (w1[-1], w2[-1]), heads[-1]
        yield pa.RecordBatch.from_arrays([pa.array(rid[later]), pa.array(pos[later].astype(np.int64))], names=["rid", "value"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, text, places) -> (rid, n_removed, kept)."""
    for batch in batches:
        rows = []
        for rid, text, done in zip(*(c.to_pylist() for c in batch.columns)):
            words = text.split()
            edge = np.zeros(len(words) + 1, np.int64)
            at = np.array(done, np.int64)  # a place comes once
            edge[at] += 1
            edge[at + WINDOW] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            rows.append((rid, int(gone.sum()), b" ".join(w for w, g in zip(words, gone) if not g)))
        columns = zip(*rows) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], names=["rid", "n_removed", "kept"])


def candidates(bodies: DataFrame, first: DataFrame) -> DataFrame:
    """Texts of ``first`` (rid, key) that share an anchor, with it: (rid, key, text, anchors), stored.

    Its shuffles are free to go once it returns: nothing refers to them any more.
    """
    found = bodies.mapInArrow(_anchors, "anchor long, rid long, many boolean, done array<long>")
    shared = found.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_shared, "rid long, value long")
    wanted = gathered(shared, "anchors").join(first, "rid")
    return store(bodies.join(wanted, "rid").select("rid", "key", "text", "anchors"), "substring-texts")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word inside a passage of ``WINDOW`` words that also starts in a document with a smaller id.

    One row per input row: ``doc_id``, ``rid`` (the row's number; ``docs`` must be a stored table), ``n_words``,
    ``n_removed``, ``kept`` (words left, joined by spaces; null where nothing was removed), ``kept_sha256``.  Null text has no
    words; a null id counts as larger than any other; rows that share an id never cut each other; repeats inside
    one document stay; documents under ``WINDOW`` words lose nothing; an empty table gives an empty result.
    Other columns are ignored.
    """
    words = spaced_words(F.col(text_col)).alias("words")
    rows = docs.select(row_numbers(docs).alias("rid"), F.col(id_col).cast("long").alias("doc_id"), words)
    key = F.coalesce("doc_id", F.lit(LAST)).alias("key")
    n_words = F.when(F.col("words") == "", 0).otherwise(F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) + 1)
    facts = store(rows.select("rid", "doc_id", key, n_words.cast("long").alias("n_words"), F.sha2("words", 256).alias("sha")), "substring-facts")
    long = facts.where(F.col("n_words") >= WINDOW)
    first = store(long.groupBy("sha").agg(F.min("key").alias("first"), F.min_by("rid", F.struct("key", "rid")).alias("rid")), "substring-classes")

    bodies = docs.select(row_numbers(docs).alias("rid"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    texts = candidates(bodies, first.select("rid", F.col("first").alias("key")))
    passages = texts.mapInArrow(_windows, "w1 long, w2 long, key long, rid long, pos int, done array<int>")
    later = passages.repartition("w1", "w2").sortWithinPartitions("w1", "w2", "key").mapInArrow(_later, "rid long, value long")
    cut = store(texts.select("rid", "text").join(gathered(later, "done"), "rid").mapInArrow(_cut, "rid long, n_removed long, kept binary"), "substring-cut")

    lost = first.join(cut, "rid", "left").drop("rid")
    out = facts.join(lost, "sha", "left")
    copy = F.coalesce(F.col("key") > F.col("first"), F.lit(False))
    return out.select(
        "doc_id",
        "rid",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit("").cast("binary")).otherwise(F.col("kept")).alias("kept"),
        F.when(copy, F.lit(EMPTY)).when(F.col("kept").isNotNull(), F.sha2("kept", 256)).otherwise(F.col("sha")).alias("kept_sha256"),
    )


ORACLE = r"""
WITH d AS (
    SELECT doc_id, CASE WHEN s = '' THEN [] ELSE string_split(s, ' ') END AS w
    FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS s FROM documents)
), win AS (
    SELECT doc_id, i, sha256(array_to_string(list_slice(w, i, i + 49), ' ')) AS h
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), least_id AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM win JOIN least_id USING (h) WHERE doc_id > first
), kept AS (
    SELECT d.doc_id, count(g.pos) AS n_removed, coalesce(string_agg(d.word, ' ' ORDER BY d.pos) FILTER (WHERE g.pos IS NULL), '') AS kept
    FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d) d LEFT JOIN gone g ON d.doc_id = g.doc_id AND d.pos = g.pos
    GROUP BY d.doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
