"""Language identification: words first, character n-grams for words that were never seen.

A known word adds its log frequency in every language.  An unseen word is cut into its longest character n-grams; if none
of them is known either, into shorter ones, down to single characters; what it adds is the mean over the known n-grams of that
length.  Frequencies are counted over all training documents with map-side combine; the model keeps the most frequent words
and n-grams of each language (``WORDS``, ``GRAMS``), so its size depends on the number of languages only.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import store, top_rows

#: What the model keeps per language: words, and n-grams of each length.
WORDS, GRAMS = 30_000, 10_000
LONGEST = 4
SMOOTHING = 0.5
UNKNOWN = "und"
CACHE = 300_000  # words remembered per worker
HELD_WORDS = 200_000  # distinct words that a task holds before it sends their counts on
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def fold(id_col: Column) -> Column:
    """Remainder by 4 of crc32 of the id as text; remainder 2 is held out.  A null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4


def word_list(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with marked ends; single characters go without the marks."""
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass(frozen=True)
class Model:
    """Languages, log of their shares of documents, and per length (0: whole words) the log frequencies of the known ones."""

    langs: list[str]
    prior: np.ndarray
    known: list[dict[str, int]]
    logs: list[np.ndarray]

    def word(self, word: str) -> np.ndarray:
        """What one occurrence of a word adds to each language."""
        at = self.known[0].get(word)
        if at is not None:
            return self.logs[0][at]
        for n in range(len(self.known) - 1, 0, -1):
            found = [self.known[n][g] for g in grams(word, n) if g in self.known[n]]
            if found:
                return self.logs[n][found].mean(0)
        return np.zeros(len(self.langs))


class Identifier:
    """Applies a model to texts; what a word adds is kept until ``CACHE`` words are known."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.kept: dict[str, np.ndarray] = {}

    def __call__(self, text: str | None) -> tuple[str, float]:
        """(language, its posterior probability); ``und`` and 0 for a text without a letter or a model without languages."""
        words = Counter(word_list(text))
        if not words or not self.model.langs:
            return UNKNOWN, 0.0
        if len(self.kept) > CACHE:
            self.kept.clear()
        for w in words:
            if w not in self.kept:
                self.kept[w] = self.model.word(w)
        total = self.model.prior + np.fromiter(words.values(), float, len(words)) @ np.array([self.kept[w] for w in words])
        best = int(total.argmax())  # of equal ones the first by name
        return self.model.langs[best], float(1 / np.exp(total - total[best]).sum())


def counts(rows: DataFrame) -> DataFrame:
    """``lang``, ``word``, ``n`` over rows (``lang``, ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for lang, words in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], names=["lang", "word", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.setdefault(lang, Counter()).update(word_list(text.as_py()))
                if sum(map(len, held.values())) > HELD_WORDS:
                    yield from emit()
        yield from emit()

    return rows.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame, longest: int) -> DataFrame:
    """``lang``, ``size``, ``gram``, ``n``: character n-grams of distinct words, weighted by the words' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for lang, word, times in zip(*(c.to_pylist() for c in batch.columns)):
                for n in range(1, longest + 1):
                    for g in grams(word, n):
                        total[lang, n, g] += times
            keys = list(zip(*total)) or [(), (), ()]
            columns = [pa.array(k, t) for k, t in zip([*keys, total.values()], (pa.string(), pa.int32(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "size", "gram", "n"])

    out = words.select("lang", "word", "n").mapInArrow(run, "lang string, size int, gram string, n long")
    return out.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", words: int = WORDS, grams_kept: int = GRAMS, longest: int = LONGEST) -> Model:
    """Learn from all documents with a language outside the held-out fold.

    The driver receives the words and n-grams that the model keeps: at most ``words + longest * grams_kept`` per language.
    """
    known = docs.where((fold(F.col(id_col)) != 2) & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    shares = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(shares)
    if not langs:
        return Model([], np.empty(0), [{}], [])
    seen = store(counts(known), "language-words")
    every = seen.select("lang", F.lit(0).alias("size"), F.col("word").alias("gram"), "n").unionByName(gram_counts(seen, longest))
    every = store(every, "language-grams")
    totals = {(r["lang"], r["size"]): r["n"] for r in every.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()}
    order, spread = [F.desc("n"), F.asc("gram")], F.xxhash64("gram")
    best = top_rows(every.where("size = 0"), ["lang", "size"], order, words, spread).unionByName(top_rows(every.where("size > 0"), ["lang", "size"], order, grams_kept, spread))
    # what is kept for one language needs its counts in all of them: a column per language, named by its number
    number = F.coalesce(*[F.when(F.col("lang") == k, F.lit(str(i))) for i, k in enumerate(langs)])
    kept = every.join(best.select("size", "gram").distinct(), ["size", "gram"], "left_semi")
    kept = kept.withColumn("lang", number).groupBy("size", "gram").pivot("lang", [str(i) for i in range(len(langs))]).agg(F.sum("n"))
    kept = kept.orderBy("size", "gram").toArrow()
    index: list[dict[str, int]] = []
    logs = []
    for size in range(longest + 1):
        part = kept.filter(pc.equal(kept["size"], size))
        index.append({g: i for i, g in enumerate(part["gram"].to_pylist())})
        seen_in = [pc.fill_null(part[str(i)], 0).to_numpy() for i in range(len(langs))]
        total = [totals.get((k, size), 0) + SMOOTHING * (part.num_rows + 1) for k in langs]
        logs.append(np.log((np.stack(seen_in, 1) + SMOOTHING) / np.array(total)))
    prior = np.array([math.log(shares[k] / sum(shares.values())) for k in langs])
    return Model(langs, prior, index, logs)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: ``doc_id``, ``held_out``, ``lang_pred``, ``score`` (posterior probability of the language).

    Null texts and texts without a letter give ``und`` with score 0, and so does a model that saw no language; words that
    are unknown down to their characters add nothing, and the shares of the training documents decide alone; ties go to the
    first name.  Repeated rows score alike; an empty table gives an empty result.  Only the text enters; other columns
    are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = Identifier(held.value)
        for batch in batches:
            out = [name(t.as_py()) for t in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(F.col(id_col)) == 2).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
