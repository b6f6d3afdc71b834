"""Phrase collocations by vertical partitioning of the word suffixes.

Every word starts a suffix, cut off after ``longest`` words or at the end of its piece.  Word prefixes are dealt to
groups so that the suffixes of a group fit a memory budget: a prefix with more suffixes than the budget is extended by
one word, which takes one more count over the corpus, until all prefixes fit or are whole suffixes.  Then each
group's subtree is built alone, in one task, from the leaf totals of its suffixes, and the count of every inner node is
the sum of the leaves below it.

Only prefixes over the budget reach the driver: at most as many as the corpus has words, divided by the budget.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import store, top_rows

LONGEST, LEAST, TOP = 3, 10, 2000
COVER = 50  # a phrase is dropped where a longer one around it has at least so many hundredths of its count
#: Suffixes of a group, counted with repeats: what the subtree of one task may hold.
BUDGET = 1_000_000
CHUNK_BYTES = 1 << 23  # text whose suffixes are counted together before they leave the task
SALTS = 8  # parts of a join key
#: Everything that ends a piece, mapped to a full stop; tabs to spaces.  ``bytes.lower`` lowers A-Z only.
ENDS = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b"......... ")
LANG = "und"


def word_list(text: str | None) -> list[bytes]:
    """Lower-cased words of a text; a full stop stands after each piece."""
    return (text or "").encode().lower().translate(ENDS).replace(b".", b" . ").split()


class Suffixes:
    """The distinct suffixes of some words, in the order of their bytes, and how often each occurs.

    ``vocabulary`` is sorted; row ``r`` of ``rows`` has the word numbers of a suffix, -1 behind its end.
    """

    def __init__(self, words: list[bytes], longest: int) -> None:
        coded = pa.array(words, pa.binary()).dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        self.vocabulary = coded.dictionary.take(pa.array(order))
        number = np.empty(len(order) + 1, np.int64)
        number[order] = np.arange(len(order))
        number[-1] = -1
        stop = pc.index(self.vocabulary, pa.scalar(b".", pa.binary())).as_py()
        ids = number[coded.indices.to_numpy()]
        ids[ids == stop] = -1
        ids = np.r_[ids, np.full(longest, -1)]
        starts = np.flatnonzero(ids >= 0)
        code, alive, columns = ids[starts].copy(), np.ones(len(starts), bool), [ids[starts]]
        size, width = len(order) + 1, len(order)
        for d in range(1, longest):
            nxt = ids[starts + d]
            alive &= nxt >= 0
            columns.append(np.where(alive, nxt, -1))
            if width * size >= 1 << 62:  # renumber, keeping the order
                known, code = np.unique(code, return_inverse=True)
                width = len(known)
            code = code * size + columns[-1] + 1
            width *= size
        order = np.argsort(code)  # any of the copies of a suffix will do
        code = code[order]
        at = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][: len(code)])
        self.times = np.diff(np.r_[at, len(code)])
        self.rows = np.stack([c[order[at]] for c in columns], 1)

    def strings(self, rows: np.ndarray, depth: int) -> pa.Array:
        """The first ``depth`` words of ``rows``, or as many as they have, joined by spaces."""
        words = [self.vocabulary.take(pa.array(rows[:, d], mask=rows[:, d] < 0)) for d in range(depth)]
        return pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.binary()), null_handling="skip")


def packed(texts: pa.Array, times: np.ndarray, depth: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """Strings with their counts and depths, cut at ``edges``, each part compressed on its own."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    body, sizes, press = memoryview(texts.buffers()[2] or b""), np.diff(offsets), zstandard.ZstdCompressor(level=1)
    out = []
    for low, high in zip(edges[:-1], edges[1:]):
        numbers = sizes[low:high].tobytes() + times[low:high].tobytes() + depth[low:high].tobytes()
        out.append(press.compress(b"".join((int(high - low).to_bytes(4, "little"), numbers, body[offsets[low] : offsets[high]]))))
    return out


def unpacked(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows of :func:`packed` parts: the bytes of all phrases, their offsets there, counts and depths."""
    press, sizes, times, depth, bodies = zstandard.ZstdDecompressor(), [], [], [], []
    for part in parts:
        raw = press.decompress(part)
        k = int.from_bytes(raw[:4], "little")
        sizes.append(np.frombuffer(raw, np.int32, k, 4))
        times.append(np.frombuffer(raw, np.int64, k, 4 + 4 * k))
        depth.append(np.frombuffer(raw, np.int8, k, 4 + 12 * k))
        bodies.append(raw[4 + 13 * k :])
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)])
    return np.frombuffer(b"".join(bodies), np.uint8), offsets, np.concatenate(times), np.concatenate(depth)


def slices(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The strings ``body[start:end]``."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    taken = body[np.repeat(starts - offsets[:-1], ends - starts) + np.arange(offsets[-1])]
    kind, width = (pa.binary(), np.int32) if offsets[-1] < 1 << 31 else (pa.large_binary(), np.int64)
    return pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(offsets.astype(width).tobytes()), pa.py_buffer(taken.tobytes())])


def nodes(parts: list[bytes], longest: int, least: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Phrases of two words, of three and so on that occur ``least`` times in the suffixes of a language, with their counts.

    A node's count is the sum of the leaves below it, so the leaves of a node that is too rare go no deeper.
    """
    body, offsets, times, depth = unpacked(parts)
    starts, ends = offsets[:-1], offsets[1:]
    spaces = np.flatnonzero(body == 32)
    first = np.searchsorted(spaces, starts)
    length = np.searchsorted(spaces, ends) - first + 1
    spaces = np.r_[spaces, np.zeros(longest, spaces.dtype)]
    left = np.arange(len(starts))
    for d in range(2, longest + 1):
        left = left[length[left] >= d]
        # a node above the prefix of its leaves lies in several groups; its count was taken with the prefixes
        here = depth[left] <= d
        rows = left[here]
        stop = np.where(length[rows] > d, spaces[first[rows] + d - 1], ends[rows])
        coded = slices(body, starts[rows], stop).dictionary_encode()
        at = coded.indices.to_numpy()
        order = np.argsort(at)
        edges = np.flatnonzero(np.r_[True, at[order][1:] != at[order][:-1]][: len(at)])
        totals = np.add.reduceat(times[rows][order], edges) if len(at) else times[:0]  # by number, none is left out
        frequent = totals >= least
        yield coded.dictionary.filter(pa.array(frequent)), totals[frequent]
        keep = np.ones(len(left), bool)
        keep[here] = frequent[at]
        left = left[keep]


def chunks(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[tuple[str, Suffixes]]:
    """Suffixes by language of the texts of a task, some megabytes at a time."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            if text:
                held.setdefault(lang, []).extend([*word_list(text), b"."])
                size += len(text)
            if size >= CHUNK_BYTES:
                yield from ((k, Suffixes(v, longest)) for k, v in held.items())
                held, size = {}, 0
    yield from ((k, Suffixes(v, longest)) for k, v in held.items())


def _totals(rows: np.ndarray, times: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted suffixes that have ``depth`` words: one row per distinct prefix of that length, and its count."""
    has = rows[:, depth - 1] >= 0
    rows, times = rows[has], times[has]
    new = np.r_[True, (rows[1:, :depth] != rows[:-1, :depth]).any(1)][: len(rows)]
    at = np.flatnonzero(new)
    return rows[at], np.add.reduceat(times, at) if len(at) else times


def prefix_counts(texts: DataFrame, depth: int, hot: set[tuple[str, bytes]]) -> DataFrame:
    """``lang``, ``phrase``, ``n`` of all prefixes of ``depth`` words, or of those that extend a prefix in ``hot``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, found in chunks(batches, depth):
            rows, times = _totals(found.rows, found.times, depth)
            if depth > 1:
                wanted = pa.array([p for k, p in hot if k == lang], pa.binary())
                keep = pc.is_in(found.strings(rows, depth - 1), value_set=wanted).to_numpy(zero_copy_only=False)
                rows, times = rows[keep], times[keep]
            phrase = found.strings(rows, depth).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), phrase, pa.array(times, pa.int64())], names=["lang", "phrase", "n"])

    return texts.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def subtrees(texts: DataFrame, hot: set[tuple[str, bytes]], groups: int, longest: int, least: int) -> DataFrame:
    """``lang``, ``phrase``, ``n`` of phrases of two words or more that occur ``least`` times, but for those in ``hot``.

    A chunk sends each group its suffixes as one compressed table, so copies of a suffix are added before the shuffle.
    """
    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, found in chunks(batches, longest):
            keep = found.rows[:, 1] >= 0
            rows, times = found.rows[keep], found.times[keep]
            if not len(rows):
                continue
            own = {p for k, p in hot if k == lang}
            seed = xxhash.xxh64_intdigest(lang)
            hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in found.vocabulary.to_pylist()], np.uint64)
            key, depth = hashes[rows[:, 0]], np.ones(len(rows), np.int8)
            grows = np.ones(len(rows), bool)
            for d in range(1, longest):
                at = np.flatnonzero(grows & (rows[:, d - 1] >= 0))
                grows[:] = False
                if own and len(at):
                    grows[at] = pc.is_in(found.strings(rows[at], d), value_set=pa.array(list(own), pa.binary())).to_numpy(zero_copy_only=False)
                depth[grows] = d + 1  # also where the suffix ends here: its own node was counted with the prefixes
                longer = grows & (rows[:, d] >= 0)
                key[longer] = key[longer] * np.uint64(0x9E3779B97F4A7C15) + hashes[rows[longer, d]]
            group = ((key >> np.uint64(20)) % np.uint64(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            rows, times, depth, group = rows[order], times[order], depth[order], group[order]
            edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
            blobs = packed(found.strings(rows, longest), times.astype(np.int64), depth, edges)
            yield pa.RecordBatch.from_arrays([pa.array(group[edges[:-1]]), pa.array([lang] * len(blobs), pa.string()), pa.array(blobs, pa.binary())], names=["group", "lang", "suffixes"])

    def build(group: pa.Table) -> pa.Table:
        langs, parts = group.column("lang").to_pylist(), group.column("suffixes").to_pylist()
        out = []
        for lang in sorted(set(langs)):
            for phrase, n in nodes([part for k, part in zip(langs, parts) if k == lang], longest, least):
                out.append(pa.table([pa.array([lang] * len(n), pa.string()), phrase.cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "phrase", "n"]))
        return pa.concat_tables(out)

    runs = texts.mapInArrow(scatter, "group long, lang string, suffixes binary")
    return runs.groupBy("group").applyInArrow(build, "lang string, phrase string, n long")


def phrase_counts(texts: DataFrame, longest: int = LONGEST, least: int = LEAST, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(all words with their counts, phrases of two to ``longest`` words that occur ``least`` times): ``lang``, ``phrase``, ``n``.

    ``texts`` has the columns ``lang`` (not null) and ``text``.
    """
    words = store(prefix_counts(texts, 1, set()), "words")
    total = words.agg(F.sum("n")).first()[0] or 0
    over, frontier, found = set(), words, []
    for depth in range(2, longest + 1):
        hot = {(r.lang, r.phrase.encode()) for r in frontier.where(F.col("n") > budget).collect()}
        over |= hot
        if not hot or depth == longest:
            break
        frontier = store(prefix_counts(texts, depth, hot).where(F.col("n") > budget), "prefixes")
        found.append(frontier.where(F.col("n") >= least))
    trees = subtrees(texts, over, max(1, -(-2 * total // budget)), longest, least)
    return words, store(reduce(DataFrame.unionByName, found, trees), "phrases")


def _salted(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, top: int = TOP, cover: int = COVER, budget: int = BUDGET) -> DataFrame:
    """The ``top`` phrases of each language: ``lang``, ``rank`` (from 1), ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    ``a`` counts the phrase, ``l`` and ``r`` its two parts at the cut with the lowest score (of equal ones the first), ``n``
    all words of the language; ``score`` is ``floor(1000000 * a * a / (l * r))``, computed with decimals.  A phrase inside a
    longer one with at least ``cover`` hundredths of its count is dropped.  Order: score and count falling, then bytes.
    Null texts hold no words, null languages count as ``und``; repeated rows count again; a language without such
    phrases and an empty table give no rows.  Other columns are ignored.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(LANG)).alias("lang"), F.col(text_col).alias("text"))
    words, phrases = phrase_counts(texts, longest, least, budget)
    # every part of a phrase is at least as frequent; hot parts are split over salts
    parts = words.where(F.col("n") >= least).unionByName(phrases)
    parts = parts.select("lang", F.col("phrase").alias("part"), F.col("n").alias("times"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    w = F.split("phrase", " ")
    cuts = phrases.select("lang", "phrase", F.col("n").alias("a"), _salted(F.col("phrase")).alias("salt"), w.alias("w"), F.explode(F.sequence(F.lit(1), F.size(w) - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "salt", "cut", F.array_join(F.slice("w", 1, F.col("cut")), " ").alias("first"), F.expr("array_join(slice(w, cut + 1, size(w)), ' ')").alias("rest"))
    for side, count in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(parts.select("lang", F.col("part").alias(side), F.col("times").alias(count), "salt"), ["lang", side, "salt"])
    a, l, r = (F.col(c).cast("decimal(15,0)") for c in "alr")
    cuts = cuts.withColumn("score", F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), l * r))
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("c"))
    inner = phrases.where(F.size(w) > 2).select("lang", "n", w.alias("w"))
    inner = inner.select("lang", "n", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("m"))
    inner = inner.select("lang", "n", "w", "m", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)).alias("at"))
    around = inner.select("lang", F.array_join(F.slice("w", F.col("at"), F.col("m")), " ").alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = lowest.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a")))
    kept = kept.select("lang", "phrase", "a", "c.l", "c.r", F.col("c.score").cast("long").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = top_rows(kept, ["lang"], order, top, F.xxhash64("phrase"))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return best.join(totals, "lang").select("lang", rank.cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH d AS (
    SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
        string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS s FROM documents
), p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(s) AS piece FROM d)
), o AS (
    SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase
    FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, (VALUES (1), (2), (3)) t(m) WHERE len(w) >= m)
), f AS (SELECT lang, m, phrase, count(*) AS n FROM o GROUP BY ALL
), c AS (SELECT lang, m, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND n >= 10
), k AS (
    SELECT lang, m, phrase, a, cut, array_to_string(list_slice(w, 1, cut), ' ') AS head, array_to_string(list_slice(w, cut + 1, m), ' ') AS rest
    FROM (SELECT *, unnest(range(1, m)) AS cut FROM c)
), s AS (
    SELECT k.lang, k.m, k.phrase, a, cut, x.n AS l, y.n AS r, (1000000::HUGEINT * a * a) // (x.n::HUGEINT * y.n) AS score
    FROM k JOIN f x ON x.lang = k.lang AND x.phrase = head JOIN f y ON y.lang = k.lang AND y.phrase = rest
), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS q FROM s) WHERE q = 1
), g AS (
    SELECT lang, phrase, max(a) AS longer FROM (
        SELECT lang, a, w[1] || ' ' || w[2] AS phrase FROM c WHERE m = 3 UNION ALL SELECT lang, a, w[2] || ' ' || w[3] FROM c WHERE m = 3)
    GROUP BY ALL
), t AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang
), ranked AS (
    SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, score::BIGINT AS score
    FROM b LEFT JOIN g USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a
)
SELECT lang, rank, phrase, a, l, r, t.n, score FROM ranked JOIN t USING (lang) WHERE rank <= 2000
"""
