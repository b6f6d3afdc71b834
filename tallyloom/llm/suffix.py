"""Exact removal of repeated byte strings by a sparse suffix array, merged by a common-prefix-aware merge sort.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts anywhere else.  Sorting the suffixes of
every byte would move hundreds of bytes per byte of text, so the suffix array is sparse: each string of
``LENGTH`` bytes elects the smallest hash among its grams of ``GRAM`` bytes (the leftmost of equals).  The choice
depends on the string alone, so equal strings elect the same place and only elected places are sorted.  An elected
place has a right context (its suffix) and a left context, both as long as the strings that elected it reach.

1. Grams that occur at one elected place only cannot be part of a repeat; hashes are counted with
   map-side combine and the rest of the work sees repeated grams only.
2. Each task sorts the suffixes of its places, merges equal ones into one with a count, and sends front-coded
   runs: the length of the prefix shared with the suffix before, and the rest.
3. A loser tree merges the runs of one range of grams; it knows the common prefixes with the last winner and never
   compares them again.  The common prefixes of the merged order, with the left contexts, say how far each distinct
   suffix repeats; joining that back to the places gives the spans to remove.  Grams with more than ``HOT`` places, which
   could fill a task, are never grouped: the strings of their contexts are counted by 128-bit hashes.

Exact copies of whole texts are one class with one representative; a class of two or more loses everything.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import row_numbers, store

LENGTH, GRAM = 200, 64
GRAMS = LENGTH - GRAM + 1  # grams in one string
CHUNK = 1 << 19  # bytes worked on at once
SITES_PER_PART = 100_000
HOT = 20_000  # places of a gram at most that one task takes as a group
RUN = 150_000  # distinct suffixes in a run at most; more make another run
BASE = 0x9E3779B97F4A7C15
EMPTY = hashlib.sha256(b"").hexdigest()
_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers:
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            x = np.full(CHUNK + LENGTH + 1, b, np.uint64)
            x[0] = 1
            _powers.append(np.multiply.accumulate(x))
    return _powers


def elect(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For at most ``CHUNK + LENGTH`` bytes: gram hash at every place, and the place elected by every string."""
    up, down = _power_tables()
    n = len(data)
    if n < LENGTH:
        none = np.empty(0, np.int64)
        return none, none
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(data * up[:n], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    low = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while 2 * span <= GRAMS:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < GRAMS:
        low = np.minimum(low[: len(low) - (GRAMS - span)], low[GRAMS - span :])
    return h.view(np.int64), (low & np.uint64((1 << 20) - 1)).astype(np.int64)


def sites(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of elected places: text number, place, first and last string start that elected it, gram hash."""
    group: list[tuple[int, int, bytes]] = []  # text, offset of the piece, bytes
    size = 0

    def flush() -> Iterator[tuple[np.ndarray, ...]]:
        data = np.frombuffer(b"".join(x[2] for x in group), np.uint8)
        h, chosen = elect(data)
        if not len(chosen):
            return
        ends = np.cumsum([len(x[2]) for x in group])
        own = np.searchsorted(ends, np.arange(len(chosen)), "right")
        inside = np.arange(len(chosen)) + LENGTH <= ends[own]
        starts = np.flatnonzero(inside)
        if not len(starts):
            return
        chosen = chosen[starts]
        cut = np.flatnonzero(np.diff(chosen)) + 1
        first, last = np.r_[0, cut], np.r_[cut, len(chosen)] - 1
        at = chosen[first]
        piece = own[starts[first]]
        shift = np.array([x[1] for x in group]) - (ends - [len(x[2]) for x in group])
        text = np.array([x[0] for x in group])
        yield text[piece], at + shift[piece], starts[first] + shift[piece], starts[last] + shift[piece], h[at]

    for number, text in enumerate(texts):
        for low in range(0, max(len(text) - LENGTH + 1, 0), CHUNK):
            piece = text[low : low + CHUNK + LENGTH - 1]
            if group and size + len(piece) > CHUNK + LENGTH - 1:
                yield from flush()
                group, size = [], 0
            group.append((number, low, piece))
            size += len(piece)
    if group:
        yield from flush()


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, text) -> (gram, class, multi, piece): each gram once per piece of a text; multi tells that the piece holds it twice."""
    for batch in batches:
        cls = batch.column(0).to_numpy()
        for text, _, first, _, h in sites(batch.column(1).to_pylist()):
            order = np.lexsort((h, text))
            text, piece, h = text[order], first[order] // CHUNK, h[order]
            new = np.r_[True, (np.diff(text) != 0) | (np.diff(h) != 0)]
            count = np.diff(np.r_[np.flatnonzero(new), len(h)])
            yield pa.RecordBatch.from_arrays([pa.array(h[new]), pa.array(cls[text[new]]), pa.array(count > 1), pa.array(piece[new])], names=["gram", "cls", "multi", "piece"])


def _sites(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, text, grams) -> places of the wanted grams with their contexts; the left context is reversed."""
    for batch in batches:
        rid, texts, wanted = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2)
        want: dict[int, np.ndarray] = {}
        for text, at, first, last, h in sites(texts):
            out: list[list] = [[], [], [], [], [], []]
            for lo, hi in zip(np.r_[0, np.flatnonzero(np.diff(text)) + 1], np.r_[np.flatnonzero(np.diff(text)) + 1, len(text)]):
                t = int(text[lo])
                if t not in want:
                    want = {t: np.array(wanted[t].as_py(), np.int64)}
                body = texts[t]
                for i in lo + np.flatnonzero(np.isin(h[lo:hi], want[t])):
                    s = int(at[i])
                    left, right = body[int(first[i]) : s][::-1], body[s : int(last[i]) + LENGTH]
                    key = xxhash.xxh64(left)
                    key.update(b"%d|" % len(left))
                    key.update(right)
                    for column, x in zip(out, (rid[t], s, h[i], key.intdigest() - (1 << 63), left, right)):
                        column.append(x)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, types)], names=["rid", "at", "gram", "ctx", "left", "right"])


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings that agree on their first ``known`` bytes."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - (x.bit_length() + 7) // 8


def _runs(parts: int):
    """(gram, ctx, left, right) -> sorted front-coded runs, one per task and part of the gram space."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        run = TaskContext.get().partitionId() << 20

        def flush() -> pa.RecordBatch:
            rows = sorted((k[0] % parts, v[2], v[1], k[0], k[1], v[0]) for k, v in found.items())
            out: list[list] = [[], [], [], [], [], [], [], [], []]
            part, before = -1, b""
            for seq, (p, right, left, gram, ctx, n) in enumerate(rows):
                shared = common(before, right) if p == part else 0
                for column, x in zip(out, (p, run, seq, shared, right[shared:], left, gram, ctx, n)):
                    column.append(x)
                part, before = p, right
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, types)], names=["part", "run", "seq", "shared", "rest", "left", "gram", "ctx", "n"])

        for batch in batches:
            for gram, ctx, left, right in zip(*(c.to_pylist() for c in batch.columns)):
                if (gram, ctx) in found:
                    found[gram, ctx][0] += 1
                else:
                    found[gram, ctx] = [1, left, right]
            if len(found) >= RUN:
                yield flush()
                found.clear()
                run += 1
        if found:
            yield flush()

    return make


def merge(runs: list[list[tuple[int, bytes, tuple]]]) -> Iterator[tuple[bytes, int, tuple]]:
    """Merge front-coded sorted runs of (shared, rest, payload) with a loser tree.

    Yields (string, length of the prefix common with the string before, payload).  ``known[i]`` is the common prefix
    of run i's head with the last winner that passed it: unequal values decide a match without looking
    at a byte, equal ones leave only the bytes behind them to compare.
    """
    size = 1
    while size < len(runs):
        size *= 2
    feeds = [iter(r) for r in runs]
    heads: list[bytes | None] = [b""] * len(runs) + [None] * (size - len(runs))
    known, loads = [0] * size, [None] * size

    def advance(i: int) -> None:
        row = next(feeds[i], None)
        if row is None:
            heads[i] = None
        else:
            known[i], loads[i] = row[0], row[2]
            heads[i] = heads[i][: row[0]] + row[1]

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser learns its common prefix with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        c = common(x, y, known[a])
        if x[c:] <= y[c:]:
            known[b] = c
            return a, b
        known[a] = c
        return b, a

    for i in range(len(runs)):
        advance(i)
        known[i] = 0
    losers, level = [0] * size, list(range(size))
    at = size // 2
    while len(level) > 1:
        up = []
        for j in range(0, len(level), 2):
            win, lose = play(level[j], level[j + 1])
            losers[at + j // 2] = lose
            up.append(win)
        level, at = up, at // 2
    win = level[0]
    while heads[win] is not None:
        yield heads[win], known[win], loads[win]
        advance(win)
        node = (win + size) // 2
        while node:
            win, losers[node] = play(win, losers[node])
            node //= 2


def reach(group: list[tuple[bytes, int, bytes, int]]) -> list[tuple[int, int]]:
    """How far each distinct context of one gram repeats.

    ``group``: (right, prefix shared with the one before, left reversed, count) in sorted order of ``right``.  Returns
    (left, right) bytes of the union of its repeated strings, (0, 0) for none.  Every such string covers the place,
    so their union is one span.  Small groups compare pairs; large ones refine classes of equal
    contexts per split, in time linear in the group but for sorting.
    """
    m = len(group)
    full = [(len(g[2]), len(g[0])) if g[3] > 1 else (0, 0) for g in group]
    if m <= 48:
        for i in range(m):
            r = LENGTH
            for j in range(i + 1, m):
                r = min(r, group[j][1])
                if r < GRAM:
                    break
                both = min(r, len(group[i][0]), len(group[j][0]))
                left = common(group[i][2], group[j][2])
                if left + both >= LENGTH:
                    for k in (i, j):
                        full[k] = (max(full[k][0], left), max(full[k][1], both))
        return full
    shared = np.array([g[1] for g in group])
    n_right, n_left = np.array([len(g[0]) for g in group]), np.array([len(g[2]) for g in group])
    order = sorted(range(m), key=lambda i: group[i][2])
    left_shared = np.array([0] + [common(group[a][2], group[b][2]) for a, b in zip(order, order[1:])])
    rank = np.empty(m, np.int64)
    rank[order] = np.arange(m)
    most, least = np.full(m, -1), np.full(m, LENGTH + 1)
    for d in range(int(n_left.max()) + 1):
        fits = np.flatnonzero((n_left >= d) & (n_right >= LENGTH - d))
        if not len(fits):
            continue
        right_class = np.cumsum(shared < LENGTH - d)
        left_class = np.cumsum(left_shared < d)[rank]
        _, back, count = np.unique(right_class[fits] * (m + 1) + left_class[fits], return_inverse=True, return_counts=True)
        hit = fits[count[back] > 1]
        most[hit] = np.maximum(most[hit], d)
        least[hit] = np.minimum(least[hit], d)
    return [f if most[i] < 0 else (max(f[0], int(most[i])), max(f[1], LENGTH - int(least[i]))) for i, f in enumerate(full)]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part, run, seq -> (gram, ctx, back, ahead): the repeated span around each distinct context."""
    part, runs, last = None, [], None
    out: list[tuple] = []

    def solve() -> None:
        group: list[tuple] = []
        keys: list[tuple] = []

        def close() -> None:
            for (gram, ctx), (back, ahead) in zip(keys, reach(group)):
                if back + ahead:
                    out.append((gram, ctx, back, ahead))
            group.clear()
            keys.clear()

        where: dict[tuple, int] = {}
        for right, shared, (left, gram, ctx, n) in merge(runs):
            if shared < GRAM:
                close()
                where = {}
            if (gram, ctx) in where:  # the same context from another run
                i = where[gram, ctx]
                group[i] = (*group[i][:3], group[i][3] + n)
                continue
            where[gram, ctx] = len(group)
            group.append((right, shared, left, n))
            keys.append((gram, ctx))
        close()

    def emit() -> pa.RecordBatch:
        columns = zip(*out) if out else ((), (), (), ())
        batch = pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["gram", "ctx", "back", "ahead"])
        out.clear()
        return batch

    for batch in batches:
        for p, run, _, shared, rest, left, gram, ctx, n in zip(*(c.to_pylist() for c in batch.columns)):
            if p != part:
                if runs:
                    solve()
                    yield emit()
                part, runs, last = p, [], None
            if run != last:
                runs.append([])
                last = run
            runs[-1].append((shared, rest, (left, gram, ctx, n)))
    if runs:
        solve()
        yield emit()


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, ctx, left, right, n) -> (gram, ctx, back, high, low, n): every string of a context, its bytes before the place and its 128-bit hash."""
    for batch in batches:
        for low in range(0, batch.num_rows, 500):
            gram, ctx, left, right, n = batch.slice(low, 500).columns
            digests: list[bytes] = []
            backs = []
            for x, y in zip(left.to_pylist(), right.to_pylist()):
                body = x[::-1] + y
                backs.append(np.arange(len(x), LENGTH - len(y) - 1, -1))
                digests += [xxhash.xxh3_128_digest(body[i : i + LENGTH]) for i in range(len(body) - LENGTH + 1)]
            own = [np.repeat(c.to_numpy(), [len(b) for b in backs]) for c in (gram, ctx, n)]
            keys = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2).T.copy()
            columns = (own[0], own[1], np.concatenate(backs), keys[0], keys[1], own[2])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["gram", "ctx", "back", "high", "low", "n"])


def hot_spans(places: DataFrame) -> DataFrame:
    """(gram, ctx, back, ahead) like :func:`_merged`, for grams with any number of contexts.

    Equal strings elect equal grams, so a string repeats when its hash counts more than one place.  The repeated hashes are stored
    first: the join then deals both sides anew and Spark can split a hash that many contexts share.
    """
    contexts = store(places.groupBy("gram", "ctx").agg(F.first("left").alias("left"), F.first("right").alias("right"), F.count("*").alias("n")), "suffix-hot-contexts")
    strings = contexts.mapInArrow(_strings, "gram long, ctx long, back long, high long, low long, n long")
    repeated = store(strings.groupBy("high", "low").agg(F.sum("n").alias("n")).where("n > 1").select("high", "low"), "suffix-hot-strings")
    return strings.join(repeated, ["high", "low"]).groupBy("gram", "ctx").agg(F.max("back").alias("back"), (LENGTH - F.min("back")).alias("ahead"))


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted maximal spans; spans that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, text, spans) -> (rid, n_removed, n_spans, kept, kept_text)."""
    for batch in batches:
        rows = []
        for rid, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
            gone = union([(s["low"], s["high"]) for s in spans])
            kept = b"".join(text[a:b] for a, b in zip([0, *(b for _, b in gone)], [*(a for a, _ in gone), len(text)]))
            rows.append((rid, sum(b - a for a, b in gone), len(gone), kept, kept.decode(errors="ignore")))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, types)], names=["rid", "n_removed", "n_spans", "kept", "kept_text"])


def repeated_spans(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Texts of ``classes`` (cls, rid of one row each) with a repeat, and its spans: (rid, text, spans).

    ``rows`` has (rid, cls, text binary).  A gram counts as repeated when two classes hold it or one text holds it twice, in one
    piece or in two; copies of a text are cut alike and add nothing.
    """
    spark = rows.sparkSession
    grams = store(rows.select("cls", "text").mapInArrow(_grams, "gram long, cls long, multi boolean, piece long"), "suffix-grams")
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("cls", "piece") for f in (F.min, F.max)]
    repeated = grams.groupBy("gram").agg(*ends, F.max("multi").alias("multi")).where("min_cls < max_cls or min_piece < max_piece or multi").select("gram")
    wanted = grams.select("cls", "gram").join(repeated, "gram").distinct().groupBy("cls").agg(F.collect_list("gram").alias("grams"))
    wanted = classes.select("cls", "rid").join(wanted, "cls").drop("cls")
    texts = store(rows.select("rid", "text").join(wanted, "rid"), "suffix-texts")
    places = store(texts.mapInArrow(_sites, "rid long, at long, gram long, ctx long, left binary, right binary"), "suffix-places")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-places.count() // SITES_PER_PART))
    hot = store(places.groupBy("gram").count().where(F.col("count") > HOT).select("gram"), "suffix-hot")  # of HOT places one row at most
    contexts = places.select("gram", "ctx", "left", "right")
    any_hot = not hot.isEmpty()
    runs = (contexts.join(F.broadcast(hot), "gram", "left_anti") if any_hot else contexts).mapInArrow(_runs(parts), "part long, run long, seq long, shared int, rest binary, left binary, gram long, ctx long, n long")
    spans = runs.repartition(parts, "part").sortWithinPartitions("part", "run", "seq").mapInArrow(_merged, "gram long, ctx long, back long, ahead long")
    if any_hot:
        spans = spans.unionByName(hot_spans(contexts.join(F.broadcast(hot), "gram", "left_semi")))
    hits = places.select("rid", "at", "gram", "ctx").join(spans, ["gram", "ctx"])
    spans = hits.groupBy("rid").agg(F.collect_set(F.struct((F.col("at") - F.col("back")).alias("low"), (F.col("at") + F.col("ahead")).alias("high"))).alias("spans"))
    return texts.select("rid", "text").join(spans, "rid")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every byte inside a string of ``LENGTH`` bytes that also starts anywhere else.

    One row per input row: ``doc_id``, ``rid`` (the row's number in this run), ``n_bytes``, ``n_removed``,
    ``n_spans`` (maximal removed runs), ``kept`` (remaining bytes, null where nothing was removed), ``kept_text`` (the
    same as text, without the characters that a cut went through) and ``kept_sha256``.  Null text counts as empty; texts shorter than ``LENGTH`` lose nothing; repeated rows are copies
    of each other; matches never cross texts; an empty table gives an empty result.  Other columns are ignored.
    """
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(row_numbers(docs).alias("rid"), F.col(id_col).cast("long").alias("doc_id"), body.alias("text"))
    rows = store(rows.withColumns({"cls": F.xxhash64("text"), "sha": F.sha2("text", 256), "n_bytes": F.length("text").cast("long")}), "suffix-rows")
    classes = rows.where(F.col("n_bytes") >= LENGTH).groupBy("cls", "sha").agg(F.min("rid").alias("rid"), F.count("*").alias("copies"))
    classes = store(classes, "suffix-classes")
    cut = store(repeated_spans(rows.where(F.col("n_bytes") >= LENGTH), classes).mapInArrow(_cut, "rid long, n_removed long, n_spans long, kept binary, kept_text string"), "suffix-cut")
    lost = classes.join(cut, "rid", "left").where("copies > 1 or n_removed is not null").drop("rid")
    whole = F.col("copies") > 1
    out = rows.select("rid", "doc_id", "n_bytes", "cls", "sha").join(lost, ["cls", "sha"], "left")
    return out.select(
        "doc_id",
        "rid",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit("").cast("binary")).otherwise(F.col("kept")).alias("kept"),
        F.when(whole, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
        F.when(whole, F.lit(EMPTY)).when(F.col("kept").isNotNull(), F.sha2("kept", 256)).otherwise(F.col("sha")).alias("kept_sha256"),
    )
