"""Quality scores by supervised subword embeddings.

A document is the mean of learned vectors of its features: its words and their character n-grams, hashed into a
fixed number of buckets, and a mark for each word that repeats the one before.  A softmax layer on the mean gives the
class.  Vectors and layer are trained by stochastic gradient descent in numpy on a bounded sample of labelled
documents.

Once trained, the layer can be applied to every bucket's vector beforehand, so a score is the mean of one number per
feature, and the numbers of a word are computed once and kept.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound of the labelled sample: at most so many documents train the model, chosen by a hash of their ids.
SAMPLE = 4000
BUCKETS, DIM = 1 << 17, 8
SHORT, LONG = 2, 4  # character n-grams
EPOCHS, RATE, SEED = 6, 2.0, 7
REPEAT = 0  # bucket of the mark for a repeated word
REPEAT_WEIGHT = 8
CACHE = 400_000  # words remembered per worker


def fold(id_col: Column) -> Column:
    """Remainder by 3 of crc32 of the id as text; remainder 1 is held out.  A null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and of their character n-grams, with the number of the word each belongs to."""
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
    whole = np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint64, len(words))
    hashes, owners = [whole], [np.arange(len(words))]
    mixed = codes
    for n in range(2, LONG + 1):
        mixed = mixed[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        inside = owner[: len(mixed)] == owner[n - 1 :]
        if n >= SHORT:
            hashes.append(mixed[inside] + np.uint64(n))
            owners.append(owner[: len(mixed)][inside])
    h = np.concatenate(hashes) * np.uint64(0x9E3779B97F4A7C15)
    return 1 + ((h >> np.uint64(32)) % np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate(owners)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text and their weights."""
    words = (text or "").split()
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    at, owner = grams(list(counts))
    total = np.bincount(at, np.fromiter(counts.values(), float)[owner], BUCKETS)
    total[REPEAT] = REPEAT_WEIGHT * sum(map(str.__eq__, words, words[1:]))
    ids = np.flatnonzero(total)
    return ids, total[ids]


@dataclass(frozen=True)
class Model:
    """``weight``: what each bucket adds to the mean; ``bias``: what an empty text scores."""

    weight: np.ndarray
    bias: float


def train(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> Model:
    """Fit on (label, buckets, weights).  No rows give a model that scores 0.5; the order of rows is shuffled by seed."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1, 1, (BUCKETS, DIM)) / DIM
    layer, bias = np.zeros((DIM, 2)), np.zeros(2)
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            label, ids, weight = rows[i]
            rate = RATE * (1 - done / steps)
            done += 1
            share = weight / weight.sum() if len(ids) else weight
            mean = share @ vectors[ids]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = layer @ p
            # the step of a vector is scaled to its document's features, else long texts would hardly move any
            vectors[ids] -= (rate * share / max(math.sqrt(share @ share), 1e-9))[:, None] * back if len(ids) else 0
            layer -= rate * np.outer(mean, p)
            bias -= 0.1 * rate * p
    ahead = layer[:, 1] - layer[:, 0]
    return Model(vectors @ ahead, float(bias[1] - bias[0]))


class Scorer:
    """Applies a model to texts; what a word adds is kept until ``CACHE`` words are known."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.number: dict[str, int] = {}
        self.value, self.count = np.empty(0), np.empty(0, np.int64)

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.number]
        if not new:
            return
        at, owner = grams(new)
        self.number.update(zip(new, range(len(self.value), len(self.value) + len(new))))
        self.value = np.r_[self.value, np.bincount(owner, self.model.weight[at], len(new))]
        self.count = np.r_[self.count, np.bincount(owner, minlength=len(new))]

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for low in range(0, len(texts), 1000):
            if len(self.number) > CACHE:
                self.__init__(self.model)
            split = [(t or "").split() for t in texts[low : low + 1000]]
            self.learn(set().union(*split))
            for i, words in enumerate(split, low):
                at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
                again = REPEAT_WEIGHT * int(np.count_nonzero(at[1:] == at[:-1]))
                z = self.model.bias
                if words:
                    z += (float(self.value[at].sum()) + again * float(self.model.weight[REPEAT])) / (int(self.count[at].sum()) + again)
                out[i] = 1 / (1 + math.exp(-z)) if z > -700 else 0.0
        return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Train on labelled documents outside the held-out fold, ``SAMPLE`` at most.

    Documents whose label rows disagree or are null are left out; of documents that share an id one is taken.
    The driver receives the features of the sample (bounded by its size times the buckets), no text.
    """
    known = labels.where(fold(F.col(id_col)) != 1).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("y2"))
    sample = known.where("y = y2 and y in (0, 1) and id is not null").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("id", F.col("y").cast("int").alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("id", "y", "text", F.xxhash64("text").alias("h"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(2)]
            ids = pa.array([f[0] for f in found], pa.list_(pa.int32()))
            weights = pa.array([f[1] for f in found], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), ids, weights], names=["id", "y", "h", "ids", "weights"])

    rows = texts.mapInArrow(measure, "id long, y int, h long, ids array<int>, weights array<float>")
    one = rows.groupBy("id").agg(F.min(F.struct("h", "y", "ids", "weights")).alias("r")).select("id", "r.*").toArrow().sort_by("id")
    columns = (one.column(c) for c in ("y", "ids", "weights"))
    return train([(y.as_py(), np.array(i.values), np.array(w.values, np.float64)) for y, i, w in zip(*columns)])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: ``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 if score >= 0.5).

    Null and empty texts get the score of no features; repeated rows score alike; an empty table gives an
    empty result.  Only the text enters the score; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in batches:
            scores = scorer(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(F.col(id_col)) == 1).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model accepts (score >= 0.5), with all their columns and without a shuffle."""
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in batches:
            yield batch.filter(pa.array(scorer(batch.column(at).to_pylist()) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
