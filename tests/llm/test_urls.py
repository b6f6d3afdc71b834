"""The URL models against brute force: grams, scores, threshold and verdicts, on odd and very long URLs."""

import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import urls


def naive_scores(trained, asked, order=urls.ORDER, weight=urls.WEIGHT):
    """Scores of texts from (text, n_allow, n_block), with a dictionary of counts per context length; grams of any text are known."""
    counts = [[Counter(), Counter()] for _ in range(order + 1)]
    for text, *times in trained:
        padded = urls.PAD * order + text
        for i in range(len(text)):
            for k in range(order + 1):
                for side, n in enumerate(times):
                    counts[k][side][padded[i + order - k : i + order + 1]] += n
    totals = [[Counter(), Counter()] for _ in range(order + 1)]
    for k in range(order + 1):
        for side in (0, 1):
            for g, n in counts[k][side].items():
                totals[k][side][g[:k]] += n

    def p(gram, side):
        out = 1 / urls.ALPHABET
        for k in range(order + 1):
            g = gram[order - k :]
            out = (counts[k][side][g] + weight * out) / (totals[k][side][g[:k]] + weight)
        return out

    def score(text):
        padded = urls.PAD * order + text
        grams = [padded[i : i + order + 1] for i in range(len(text))]
        return sum(math.log(p(g, 0)) - math.log(p(g, 1)) for g in grams) / len(grams)

    return {t: score(t) for t in asked if t}


def naive_limit(labelled, step=urls.STEP):
    a, b = sum(x[1] for x in labelled), sum(x[2] for x in labelled)
    if not a or not b:
        return 0.0
    bins = sorted({math.floor(s / step) for s, *_ in labelled})
    good = {x: sum(m for s, m, _ in labelled if math.floor(s / step) >= x) / a + sum(n for s, _, n in labelled if math.floor(s / step) < x) / b for x in bins}
    return max(bins, key=lambda x: (good[x], -abs(x), x)) * step


def addresses():
    rng = random.Random(8)
    words = "news shop play bet free page item help".split()
    out = [f"http{rng.choice(['', 's'])}://{rng.choice(words)}.{rng.choice(['com', 'net', 'org', 'NET'])}/{rng.choice(['es', 'fr', 'en', ''])}/{rng.choice(words)}{rng.choice(['', '?q=1', '#top', '?casino=1'])}" for _ in range(120)]
    return [*out, *out[:9], "http://q.org/p?casino=1&win", "http://q.org/p?lesson=2", "no scheme", "other text", "", None, "://", "http://é.org/ß?ü"]


def test_scores_and_verdicts_by_brute_force(spark):
    data = addresses()
    frame = spark.createDataFrame(list(enumerate(data)), "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(frame).collect()}
    assert len(got) == len(data)

    def text(u):
        at = (u or "").find("://")
        if at < 0:
            return u or ""
        end = min([len(u), *(u.find(c, at + 3) for c in "/?#" if u.find(c, at + 3) >= 0)])
        return u[:end].lower() + u[end:]

    texts = Counter(text(u) for u in data)
    held = {r.t: r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", (F.pmod(F.xxhash64("t"), F.lit(urls.HOLD)) == 0).alias("h")).collect()}
    ruled = {text(u): got[i].verdict if got[i].rule else None for i, u in enumerate(data)}
    trained = [(t, n * (ruled[t] == "allow" and not held[t]), n * (ruled[t] == "block" and not held[t])) for t, n in texts.items()]
    want = naive_scores(trained, texts)
    limit = naive_limit([(round(want[t], 9), n * (ruled[t] == "allow"), n * (ruled[t] == "block")) for t, n in texts.items() if held[t] and ruled[t]])
    for i, u in enumerate(data):
        t = text(u)
        if ruled[t] is None:
            assert got[i].score == pytest.approx(want.get(t, 0.0), abs=1e-8)
            assert got[i].verdict == ("allow" if round(want.get(t, 0.0), 9) >= limit else "block")
    free = {u: got[i].score for i, u in enumerate(data)}
    assert free["http://q.org/p?casino=1&win"] != free["http://q.org/p?lesson=2"] and free["no scheme"] != free["other text"]


def test_threshold_ties_and_missing_sides(spark):
    rows = [(0.031, 2, 0), (0.004, 1, 0), (-0.012, 0, 3), (-0.2, 1, 0), (0.5, 0, 1), (0.004, 0, 1)]
    frame = spark.createDataFrame(rows, "score double, n_allow long, n_block long")
    assert urls.threshold(frame).first().limit == pytest.approx(naive_limit(rows))
    assert urls.threshold(frame.where("n_block = 0")).first().limit == urls.threshold(frame.limit(0)).first().limit == 0
    assert urls.threshold(spark.createDataFrame([(0.055, 1, 0), (-0.055, 1, 0), (0.055, 0, 1), (-0.055, 0, 1)], "score double, n_allow long, n_block long")).first().limit == pytest.approx(naive_limit([(0.055, 1, 0), (-0.055, 1, 0), (0.055, 0, 1), (-0.055, 0, 1)]))


def test_contexts_of_long_urls(spark):
    for n in (1, 5, urls.PIECE - 1, urls.PIECE, urls.PIECE + 1, 3 * urls.PIECE + 7):
        text = "".join(random.Random(n).choice("abé/") for _ in range(n))
        got = spark.createDataFrame([(text,)], "t string").select(urls.contexts(F.col("t")).alias("g")).first().g
        padded = urls.PAD * urls.ORDER + text
        assert got == [padded[i : i + urls.ORDER + 1] for i in range(n)]
    assert spark.createDataFrame([("",)], "t string").select(urls.contexts(F.col("t")).alias("g")).first().g == []
    long = spark.createDataFrame([(0, "http://a.com/" + "ab/" * 20_000), (1, "http://b.org/" + "c" * 20_000), (2, "http://x.net/es/"), (3, "http://b.org/c")], "page_id long, url string")
    start = time.time()
    assert {r.page_id: r.verdict for r in urls.judge(long).collect()}.keys() == {0, 1, 2, 3}
    assert time.time() - start < 120
