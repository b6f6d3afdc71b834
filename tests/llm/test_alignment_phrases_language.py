"""Tokenizer alignment, phrase mining and language identification against brute force on odd tables."""

import hashlib
import math
import random
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.llm import alignment, language, phrases
from tallyloom.llm.bytebpe import byte_level
from tallyloom.llm.common import store, table
from tallyloom.llm.queries import ORACLES, QUERIES, alignment_paths
from tests.oracle import compare

SF = "/root/testdata/sf0.001"
#: Columns with names that the operators use inside.
EXTRA = {"rid": 1, "pairs": 2, "n": 3, "phrase": 4, "a": 5, "b": 6, "word": 7, "part": 8, "held_out": 9, "score": 10}


def rows():
    rng = random.Random(3)
    vocabulary = {"x": "the cat sat on a mat und".split(), "y": "le chat était sur un tapis".split()}

    def text(lang, n):
        return "".join(rng.choice(vocabulary[lang]) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "! "]) for _ in range(n))

    out = [(i, text(k, n), k) for i, (k, n) in enumerate([("x", 300), ("x", 200), ("y", 250), ("y", 5), ("x", 1)])]
    out += [(10, out[0][1], "x"), (11, out[0][1], "y"), (11, out[0][1], "x"), (12, text("x", 60), None), (13, text("y", 60), None)]
    out += [(20, None, "x"), (21, "", "x"), (22, " \t\n\x0b", "y"), (23, "...,,!", "x"), (24, "123 456", "x"), (25, "THE Cat SAT ÉTÉ", "x"), (26, None, None)]
    out += [(30, "the cat " * 40, "x"), (31, "a" * 5000, "y"), (32, " " * 3000 + "end", "x"), (33, "\n" * 3000, "x"), (34, "the<|endoftext|>cat <s> <0x41> <unk>", "x")]
    out += [(40, "half ▁ sign", "x"), (41, "日本語のテキスト 東京", "z"), (42, "ﬁne ｗｉｄｅ é 　  nbsp \x00 zero\r\nline", "x"), (43, "🙂🙂 नमस्ते", "z"), (None, "the cat sat", "x"), (None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    data = [(*r, *EXTRA.values()) for r in rows()]
    return store(spark.createDataFrame(data, "doc_id long, text string, lang string, " + ", ".join(f"{c} int" for c in EXTRA)).repartition(3), "test-docs")


@pytest.fixture(scope="module")
def empty(docs):
    return store(docs.limit(0), "test-empty")


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


# --- alignment ------------------------------------------------------------------------------


@given(st.lists(st.integers(0, 300), unique=True), st.lists(st.integers(0, 300), unique=True))
def test_gallop_ranks(short, long):
    short, long = sorted(short), sorted(long)
    assert alignment.gallop(short, long) == [bisect_left(long, x) for x in short]


@given(st.lists(st.integers(1, 4), min_size=1, max_size=30), st.lists(st.integers(1, 4), min_size=1, max_size=30))
def test_overlaps_of_any_two_cuts(a, b):
    short = min(sum(a), sum(b))
    a, b = [sorted({min(e, short) for e in np.cumsum(x)} | {short}) for x in (a, b)]
    i, j, at_a, at_b = alignment.align(np.array(a), np.array(b))
    overlap = {(m, n) for m in range(len(a)) for n in range(len(b)) if max([0, *a][m], [0, *b][n]) < min(a[m], b[n])}
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(overlap)
    assert [a[k] for k in at_a] == [b[k] for k in at_b] == sorted(set(a) & set(b))


def naive_alignment(texts):
    """(ids of both, groups as text, Counter of linked id pairs) of each text, byte by byte."""
    import sentencepiece
    import tokenizers

    path_a, path_b = alignment_paths()
    tok, sp = tokenizers.Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    tok.encode_special_tokens = True
    byte, entries = byte_level(), {i: t for t, i in tok.get_vocab().items()}
    out = []
    for text in texts:
        a = tok.encode(" " + (text or ""), add_special_tokens=False).ids
        b = sp.encode(text or "")
        bytes_a = [bytes(byte[c] for c in entries[i]) for i in a]
        bytes_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            out.append(([], [], "", Counter()))
            continue
        owner_a = [n for n, t in enumerate(bytes_a) for _ in t]
        owner_b = [n for n, t in enumerate(bytes_b) for _ in t]
        groups, ga, gb = [], [], []
        for p, (m, n) in enumerate(zip(owner_a, owner_b)):
            ga += [m] * (not ga or ga[-1] != m)
            gb += [n] * (not gb or gb[-1] != n)
            if p + 1 == len(owner_a) or owner_a[p + 1] != m and owner_b[p + 1] != n:
                groups.append(",".join(str(a[x]) for x in ga) + "|" + ",".join(str(b[x]) for x in gb))
                ga, gb = [], []
        out.append((a, b, ";".join(groups), Counter((a[m], b[n]) for m, n in set(zip(owner_a, owner_b)))))
    return out


@pytest.mark.parametrize("part", [alignment.PART, 40])
def test_alignment(docs, empty, part):
    data = rows()
    found = naive_alignment([t for _, t, _ in data])
    count = Counter(p for *_, pairs in found for p in pairs)
    highest = defaultdict(int)
    for (a, _), n in count.items():
        highest[a] = max(highest[a], n)
    want = []
    for (i, *_), (a, b, groups, pairs) in zip(data, found):
        best = sum(n for p, n in pairs.items() if count[p] == highest[p[0]])
        sha = hashlib.sha256(groups.encode()).hexdigest() if a else ""
        want.append((i, len(a), len(b), groups.count("|"), sum(pairs.values()), best, sum(n * count[p] for p, n in pairs.items()), sha))
    same([tuple(r)[:8] for r in alignment.alignment(docs, *alignment_paths(), part=part).collect()], want)
    assert sum(bool(w[1]) for w in want) > 15 and any(w[1] == 0 and t for w, (_, t, _) in zip(want, data))
    assert alignment.alignment(empty, *alignment_paths(), part=part).count() == 0


def test_long_texts_are_tokenized_whole():
    both = alignment.tokenizers(*alignment_paths())
    texts = [" " * 2_000_000, "\n" * 2_000_000, "a" * 1_000_000, "word " * 400_000]
    for text, (a, b) in zip(texts, both(texts)):
        assert both.size_a[a].sum() == both.size_b[b].sum() == len(text) + 1


# --- phrases --------------------------------------------------------------------------------


def naive_phrases(data, longest, least, top, cover):
    f, total = Counter(), Counter()
    for _, text, lang in data:
        lang = lang or "und"
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for end in ".,;:!?\n\x0b\x0c\r":
            lowered = lowered.replace(end, "\n")
        for piece in lowered.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            total[lang] += len(words)
            for i in range(len(words)):
                for m in range(1, longest + 1):
                    if i + m <= len(words):
                        f[lang, tuple(words[i : i + m])] += 1
    found = {k: n for k, n in f.items() if n >= least and len(k[1]) > 1}
    out = defaultdict(list)
    for (lang, w), a in found.items():
        longer = [n for (k, v), n in found.items() if k == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if any(100 * n >= cover * a for n in longer):
            continue
        score, _, l, r = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return [(lang, n, p.decode(), -a, l, r, total[lang], -s) for lang, c in out.items() for n, (s, a, p, l, r) in enumerate(sorted(c)[:top], 1)]


@pytest.mark.parametrize(("budget", "longest", "cover", "top"), [(phrases.BUDGET, 3, 50, 2000), (50, 3, 50, 2000), (5, 3, 80, 20), (20, 4, 50, 2000), (1, 2, 50, 7)])
def test_phrases(docs, empty, budget, longest, cover, top):
    want = naive_phrases(rows(), longest, 3, top, cover)
    assert len(want) > 5
    same([tuple(r) for r in phrases.collocations(docs, budget=budget, longest=longest, least=3, cover=cover, top=top).collect()], want)
    assert phrases.collocations(empty, budget=budget).count() == 0


def test_suffixes_leave_a_task_in_chunks(docs, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 500)
    data = [r for r in rows() if r[1]]
    batches = docs.where("text is not null").selectExpr("coalesce(lang, 'und')", "text").toArrow().to_batches()
    total = Counter()
    for lang, found in phrases.chunks(iter(batches), 2):
        total[lang] += int(found.times.sum())
    assert total == Counter({k: sum(len([w for w in phrases.word_list(t) if w != b"."]) for _, t, lang in data if (lang or "und") == k) for k in total})


def test_phrases_match_sql(spark, con):
    assert compare(spark, con, "op12_phrases", QUERIES["op12_phrases"], ORACLES["op12_phrases"], SF) is None


# --- language -------------------------------------------------------------------------------


def naive_language(data, longest=language.LONGEST):
    """(doc_id, held out, language, score) with all counts in dictionaries, every word scored on its own."""
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 4 == 2 for i, *_ in data]
    train = [(t, k) for (_, t, k), h in zip(data, held) if not h and k is not None]
    langs = sorted({k for _, k in train})
    counts = [Counter() for _ in range(longest + 1)]
    for t, k in train:
        for w in language.word_list(t):
            counts[0][k, w] += 1
            for n in range(1, longest + 1):
                marked = w if n == 1 else f"<{w}>"
                for i in range(len(marked) - n + 1):
                    counts[n][k, marked[i : i + n]] += 1
    known = [{g for _, g in c} for c in counts]

    def log(n, g, k):
        total = sum(v for (lang, _), v in counts[n].items() if lang == k)
        return math.log((counts[n][k, g] + language.SMOOTHING) / (total + language.SMOOTHING * (len(known[n]) + 1)))

    out = []
    for (i, t, _), h in zip(data, held):
        words = language.word_list(t)
        if not words:
            out.append((i, h, "und", 0.0))
            continue
        z = {k: math.log(sum(x == k for _, x in train) / len(train)) for k in langs}
        for w in words:
            for n in [0, *range(longest, 0, -1)]:
                marked = w if n < 2 else f"<{w}>"
                hits = [w] if n == 0 and w in known[0] else [] if n == 0 else [g for g in (marked[j : j + n] for j in range(len(marked) - n + 1)) if g in known[n]]
                if hits:
                    for k in langs:
                        z[k] += sum(log(n, g, k) for g in hits) / len(hits)
                    break
        best = max(langs, key=lambda k: z[k])
        out.append((i, h, best, 1 / sum(math.exp(z[k] - z[best]) for k in langs)))
    return out


def test_language(spark, docs, empty):
    data = [(i, t, k) for i, t, k in rows() if len(t or "") < 1000]
    some = store(docs.where("coalesce(length(text), 0) < 1000"), "test-short")
    got = sorted((tuple(r) for r in language.identify(some, language.fit(some)).collect()), key=repr)
    want = sorted(naive_language(data), key=repr)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want])
    whole = language.identify(docs, language.fit(docs))
    assert whole.count() == len(rows()) and whole.where("score < 0 or score > 1").count() == 0
    untaught = language.identify(docs, language.fit(docs.withColumn("lang", F.lit(None).cast("string"))))
    assert untaught.select("lang_pred", "score").distinct().collect() == [("und", 0.0)]
    assert language.identify(empty, language.fit(empty)).count() == 0


def test_unseen_words_back_off():
    logs = [np.log(np.array([[0.9, 0.1]])), np.log(np.array([[0.2, 0.8]])), np.log(np.array([[0.6, 0.4]]))]
    model = language.Model(["p", "q"], np.log([0.5, 0.5]), [{"word": 0}, {"z": 0}, {"<w": 0}], logs)
    assert model.word("word") is logs[0][0] or np.allclose(model.word("word"), logs[0][0])
    assert np.allclose(model.word("wz"), logs[2][0])
    assert np.allclose(model.word("zz"), logs[1][0])
    assert np.allclose(model.word("kkk"), 0)
    assert language.Identifier(model)("kkk") == ("p", 0.5)


def test_language_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    out = QUERIES["op13_language"](spark, sf).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out and lang_pred <> 'und'")
    assert out.count() > 100
    assert out.where("lang = lang_pred").count() >= 0.98 * out.count()


def test_language_ignores_labels_of_held_out_documents(spark, docs):
    wrong = docs.withColumn("lang", F.when(language.fold(F.col("doc_id")) == 2, F.lit("wrong")).otherwise(F.col("lang")))
    a, b = language.fit(docs), language.fit(store(wrong, "test-wrong"))
    assert a.langs == b.langs and all(np.array_equal(x, y) for x, y in zip(a.logs, b.logs))


def test_nodes_of_a_group_against_brute_force():
    """Counts of all phrases below the suffixes of some chunks; a hot word's own phrases of two were counted elsewhere."""
    rng = random.Random(3)
    chunks = [[b"a b c d e f".split()[rng.randrange(6)] for _ in range(400)] + [b"."] for _ in range(3)]
    parts, want = [], Counter()
    for words in chunks:
        found = phrases.Suffixes(words, 3)
        keep = found.rows[:, 1] >= 0
        texts = found.strings(found.rows[keep], 3)
        depth = np.array([2 if s.startswith(b"a ") else 1 for s in texts.to_pylist()], np.int8) + (np.char.count(texts.to_pylist(), b" ") > 1) * np.int8(0)
        parts += phrases.packed(texts, found.times[keep].astype(np.int64), np.where(depth > 1, 3, 1).astype(np.int8), np.array([0, len(texts)]))
        text = words[:-1]
        want.update(b" ".join(text[i : i + m]) for m in (2, 3) for i in range(len(text) - m + 1) if m == 3 or text[i] != b"a")
    for least in (1, 10, 10_000):
        got = {p: n for found, counts in phrases.nodes(parts, 3, least) for p, n in zip(found.to_pylist(), counts.tolist())}
        assert got == {p: n for p, n in want.items() if n >= least}
