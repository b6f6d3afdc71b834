"""Operators against brute force on small tables that hold nulls, empty texts, ties, copies and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm import decontam, embedding, html, packing, quality, sharding, simhash, substring, suffix, urls
from tallyloom.llm.common import components, row_numbers, store, table
from tallyloom.llm.labelled_pages import labelled_pages
from tallyloom.llm.queries import ORACLES, QUERIES, tokenizer_path
from tests.oracle import compare

SF = "/root/testdata/sf0.001"
#: Columns with names that the operators use inside.
EXTRA = {"rid": 1, "fp": 2, "row": 3, "cls": 4, "key": 5, "h": 6, "sha": 7, "bucket": 8, "_rid": 9}


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """(doc_id, text): copies, near copies, shared passages, repeats inside a text, null, empty, white space, long, one id twice."""
    rng = random.Random(5)
    base = [sentence(rng, n) for n in (3, 30, 90, 200, 400)]
    shared = sentence(rng, 70)
    rows = list(enumerate(base))
    rows += [(10, base[3]), (11, base[3]), (11, base[3]), (12, base[3] + " tail"), (13, base[2] + " " + shared), (14, shared + " " + base[1]), (15, sentence(rng, 9) + " " + shared)]
    rows += [(20, None), (21, ""), (22, " \t\n\x0b"), (23, None), (24, "one"), (25, "two words"), (26, shared + " " + shared), (None, base[4]), (None, "alone here now")]
    rows += [(30, "ab " * 400), (31, "ab " * 300 + "x"), (32, sentence(rng, 20_000)), (33, "A B C"), (34, "a b c")]
    edited = base[4].split()
    for i in range(60):
        words = list(edited)
        words[rng.randrange(len(words))] = f"w{i}"
        rows.append((100 + i, " ".join(words)))
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(*r, *EXTRA.values()) for r in texts]
    return store(spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} int" for c in EXTRA)).repartition(3), "test-docs")


@pytest.fixture(scope="module")
def empty(docs):
    return store(docs.limit(0), "test-empty")


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def classes(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200, 300)] + [(500, i) for i in range(600, 700)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(70)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    number = {x: i for i, x in enumerate(nodes)}
    pairs = {(number[a], number[b]) for a, b in edges if a != b}
    root = classes(len(nodes), lambda i, j: (i, j) in pairs or (j, i) in pairs)
    assert got == {x: nodes[root[number[x]]] for x in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark, texts, docs, empty):
    fps = np.array([simhash.fingerprint(t) for _, t in texts])
    root = classes(len(texts), lambda i, j: int(fps[i] ^ fps[j]).bit_count() <= 3 if fps[i] ^ fps[j] >= 0 else (int(fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= 3)
    lowest = {r: min((texts[i][0] for i in range(len(texts)) if root[i] == r and texts[i][0] is not None), default=None) for r in set(root)}
    out = simhash.near_duplicates(docs)
    same([(r.doc_id, r.fp, r.component_id) for r in out.collect()], [(i, int(fps[n]), lowest[root[n]]) for n, (i, _) in enumerate(texts)])
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.fingerprint("a b") == np.uint64(spark.sql("select xxhash64('a b') x").first().x & (2**64 - 1)).astype(np.int64)


def test_spanning_forest_links_large_groups():
    rng = np.random.default_rng(2)
    fps = np.unique(np.r_[rng.integers(-(2**62), 2**62, 300), *[1 << rng.integers(0, 60, 300) for _ in range(2)]])
    a, b = simhash.forest(fps)
    root = classes(len(fps), lambda i, j: (int(fps[i]) ^ int(fps[j]) & (2**64 - 1)).bit_count() <= 3)
    assert len(a) == len(fps) - len(set(root))


def test_repeated_bytes(texts, docs, empty):
    seen = {}
    bodies = [(t or "").encode() for _, t in texts]
    for b in bodies:
        for p in range(len(b) - 199):
            seen[b[p : p + 200]] = seen.get(b[p : p + 200], 0) + 1
    want = []
    for (i, _), b in zip(texts, bodies):
        spans = suffix.union([(p, p + 200) for p in range(len(b) - 199) if seen[b[p : p + 200]] > 1])
        kept = b"".join(b[x:y] for x, y in zip([0, *(y for _, y in spans)], [*(x for x, _ in spans), len(b)]))
        want.append((i, len(b), sum(y - x for x, y in spans), len(spans), hashlib.sha256(kept).hexdigest()))
    same([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.dedup(docs).collect()], want)
    assert suffix.dedup(empty).count() == 0


def test_places_do_not_depend_on_chunks(monkeypatch):
    body = sentence(random.Random(4), 3000).encode()
    whole = {int(p) + d for _, at, first, last, _ in suffix.sites([body]) for s, f, l in zip(at, first, last) for p in [f] for d in range(int(l) - int(f) + 1)}
    monkeypatch.setattr(suffix, "CHUNK", 1000)
    parts = {int(f) + d for _, at, first, last, _ in suffix.sites([body]) for f, l in zip(first, last) for d in range(int(l) - int(f) + 1)}
    assert whole == parts == set(range(len(body) - suffix.LENGTH + 1))


def suffix_cuts(texts):
    """(number, n_bytes, n_removed, n_spans, kept_sha256) by brute force."""
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(hash(b[p : p + 200]) for b in bodies for p in range(len(b) - 199))
    out = []
    for i, b in enumerate(bodies):
        spans = suffix.union([(p, p + 200) for p in range(len(b) - 199) if seen[hash(b[p : p + 200])] > 1])
        kept = b"".join(b[x:y] for x, y in zip([0, *(y for _, y in spans)], [*(x for x, _ in spans), len(b)]))
        out.append((i, len(b), sum(y - x for x, y in spans), len(spans), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_across_the_pieces_of_a_long_text(spark):
    rng = random.Random(12)
    once, edge, thrice = ("".join(rng.choice("abcdefgh") for _ in range(n)) for n in (200, 900, 260))
    filler = ["".join(rng.choices("ijklmnop", k=n)) for n in (1000, suffix.CHUNK - 2500, 100_000, suffix.CHUNK, 30_000)]
    long = filler[0] + once + thrice + filler[1] + edge + filler[2] + once + filler[3] + thrice + edge + filler[4] + thrice
    assert len(long) > 2 * suffix.CHUNK + suffix.LENGTH
    texts = [long, sentence(rng, 300), "short"]
    want = suffix_cuts(texts)
    assert want[0][2] == 2 * 200 + 2 * 900 + 3 * 260
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    same([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.dedup(store(frame, "long")).collect()], want)


def test_passages_that_many_texts_hold_are_not_grouped(spark, monkeypatch):
    rng = random.Random(13)
    shared, line = ("".join(rng.choice("abcdefgh") for _ in range(n)) for n in (420, 150))
    texts = []
    for i in range(90):
        edges = ["".join(rng.choice("ijklmnop") for _ in range(rng.randint(0, 260))) for _ in range(3)]
        texts.append(edges[0] + shared[: rng.choice((420, 420, 300))] + edges[1] + line + edges[2])
    texts += [texts[0], texts[1] + "x", "", line, shared]
    seen, real = [], suffix.hot_spans
    monkeypatch.setattr(suffix, "HOT", 5)
    monkeypatch.setattr(suffix, "hot_spans", lambda places: seen.append(places.count()) or real(places))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = suffix.dedup(store(frame, "hot")).collect()
    same([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out], suffix_cuts(texts))
    assert sum(seen) > 90


def test_merge_equals_sort():
    rng = random.Random(9)
    runs, everything = [], []
    for n in (0, 1, 7, 40, 100):
        strings = sorted("".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode() for _ in range(n))
        everything += strings
        coded, before = [], b""
        for s in strings:
            k = suffix.common(before, s)
            coded.append((k, s[k:], None))
            before = s
        runs.append(coded)
    out = list(suffix.merge(runs))
    assert [s for s, _, _ in out] == sorted(everything)
    assert [k for _, k, _ in out[1:]] == [suffix.common(a[0], b[0]) for a, b in zip(out, out[1:])]


def test_large_groups_reach_as_far_as_pairs(monkeypatch):
    rng = random.Random(3)
    middle = bytes(rng.randrange(97, 99) for _ in range(200))
    rows = {(middle[: rng.randint(64, 200)] + bytes([rng.randrange(99, 102)]), middle[: rng.randint(0, 136)] + bytes([rng.randrange(99, 102)])) for _ in range(150)}
    group, before = [], b""
    for right, left in sorted(rows):
        group.append((right, suffix.common(before, right), left, 1))
        before = right
    large = suffix.reach(group)
    best = []
    for i, x in enumerate(group):
        spans = [(le, ri) for j, y in enumerate(group) if i != j for le, ri in [(suffix.common(x[2], y[2]), suffix.common(x[0], y[0]))] if le + ri >= suffix.LENGTH]
        best.append((max((s[0] for s in spans), default=0), max((s[1] for s in spans), default=0)))
    assert large == best


def test_repeated_passages(texts, docs, empty):
    last = 2**63 - 1
    lists = [(i if i is not None else last, (t or "").encode().split()) for i, t in texts]
    first = {}
    for i, w in lists:
        for p in range(len(w) - 49):
            k = tuple(w[p : p + 50])
            first[k] = min(first.get(k, i), i)
    want = []
    for (i, w), (doc, _) in zip(lists, texts):
        gone = {p + d for p in range(len(w) - 49) if first[tuple(w[p : p + 50])] < i for d in range(50)}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        want.append((doc, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    same([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup(docs).collect()], want)
    assert substring.dedup(empty).count() == 0
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))


def test_packing(docs, texts, empty):
    from tokenizers import Tokenizer

    import public_tokenizers

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for t in ("x<|endoftext|>y", "  a\n\n b", "", "naïve 東京 🙂🙂", None, texts[31][1] if texts[31][1] else ""):
        assert packing.encode(tokenizer_path(), t).tolist() == [*reference.encode(t or "", add_special_tokens=False).ids, 0]
    rows = packing.pack(docs, tokenizer_path(), with_ids=True).collect()
    assert sum(r.length for r in rows) == sum(len(packing.encode(tokenizer_path(), t)) for _, t in texts)
    windows = {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) > 0
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for w in windows.values():
        w.sort()
        assert [o for o, _ in w] == [sum(n for _, n in w[:k]) for k in range(len(w))] and sum(n for _, n in w) <= 1024
    assert packing.pack(empty, tokenizer_path()).count() == 0


@pytest.mark.parametrize("n, high", [(0, 9), (1, 1023), (2, 1023), (5, 1023), (300, 1023), (300, 40), (900, 600)])
def test_tails_fill_their_windows(n, high):
    rng = random.Random(n)
    lengths = [rng.randint(0, high) for _ in range(n)]
    windows = packing.pack_tails(lengths)
    spans = sorted(p for w in windows for p in w)
    at = [0] * n
    for item, start, size in spans:
        assert at[item] == start and size > 0
        at[item] += size
    assert at == lengths and all(sum(p[2] for p in w) <= 1024 for w in windows)
    assert len(windows) <= -(-sum(lengths) // 1024) + 1


def test_sharding(docs, texts, empty):
    rows = sharding.shard_documents(docs).collect()
    same([(r.doc_id, r["size"], r.text_crc32) for r in rows], [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts])
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) <= set(range(8)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    same([tuple(r) for r in sharding.shard_documents(docs).collect()], [tuple(r) for r in rows])  # seeded
    small = sharding.external_shuffle(docs, f"{docs.inputFiles()[0]}-shuffled", bucket_bytes=5000)
    assert small.select("bucket").distinct().count() > 5 and small.count() == len(texts)
    assert sharding.shard_documents(empty).count() == 0
    assert sorted(sharding.fisher_yates(50, [1])) == list(range(50)) and sharding.fisher_yates(0, [1]) == []


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(20, 16))
    rows = [(i, (base[i % 20] + rng.normal(size=16) * 0.25 * (i >= 20)).tolist()) for i in range(300)]
    rows += [(400, rows[0][1]), (401, rows[0][1]), (402, [2 * x for x in rows[1][1]]), (403, None), (404, []), (405, [0.0] * 16), (406, [float("nan")] + [1.0] * 15), (407, [None] + [1.0] * 15), (408, [1.0, 2.0]), (409, [2.0, 4.0]), (None, rows[0][1]), (410, [float("inf")] * 16)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, h int, ok int")

    def fine(r):
        return r[0] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    def linked(i, j):
        a, b = rows[i], rows[j]
        if not (fine(a) and fine(b) and len(a[1]) == len(b[1])):
            return False
        x, y = np.array(a[1]), np.array(b[1])
        return bool(x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.9)

    root = classes(len(rows), linked)
    want = []
    for i, r in enumerate(rows):
        component = min(rows[k][0] for k in range(len(rows)) if root[k] == root[i]) if r[0] is not None else None
        want.append((r[0], sum(linked(i, j) for j in range(len(rows)) if j != i), component, r[0] is not None and r[0] == component))
    same([tuple(r) for r in embedding.near_duplicates(frame).collect()], want)
    nodes = store(spark.createDataFrame([(r[0], r[1], 1) for r in rows[:300]], "node long, v array<double>, copies long"), "test-nodes")
    for tile, block in ((16, 40), (7, 1000), (64, 3)):  # many tiles in a block, one block in a cell, many blocks
        tiny = embedding.links(nodes, tile=tile, block=block).groupBy("node").sum("links").collect()
        assert {r[0]: r[1] for r in tiny if r[1]} == {rows[i][0]: n for i in range(300) if (n := sum(linked(i, j) for j in range(300) if j != i))}
    assert embedding.near_duplicates(frame.limit(0)).count() == 0


def test_quantisation_bound_holds():
    rng = np.random.default_rng(5)
    u, w = embedding.unit(rng.normal(size=(200, 8))), embedding.unit(rng.normal(size=(200, 8)))
    (q, s, e), (p, t, f) = embedding.quantise(u), embedding.quantise(w)
    near = (q.astype(float) @ p.T.astype(float)) * s[:, None] * t[None]
    assert (np.abs(near - u @ w.T) <= e[:, None] * (1 + f[None]) + f[None] + 1e-9).all()


@pytest.mark.parametrize("size", [16, 1040, 1041, 5000])
def test_no_possible_pair_is_missed_at_any_length(size):
    rng = np.random.default_rng(size)
    base = embedding.unit(rng.normal(size=(6, size)))
    near = embedding.unit(np.repeat(base, 40, axis=0) + rng.normal(size=(240, size)) * 0.48 / np.sqrt(size))  # cosines around 0.9
    may = embedding.possible(embedding.quantise(base), embedding.quantise(near), 0.9)
    true = base @ near.T >= 0.9
    assert true.any() and not true.all() and not (true & ~may).any() and may.mean() < 0.5


def test_shuffled_bytes_of_codes(spark):
    """Only codes, scales and errors go to the pairs of blocks: the stored blocks hold 24 bytes a vector beside a byte a component."""
    rng = np.random.default_rng(2)
    table = pa.table({"block": [4] * 50, "node": list(range(50)), "codes": [bytes(rng.integers(0, 255, 64, dtype=np.uint8)) for _ in range(50)], "scale": [0.5] * 50, "error": [0.1] * 50})
    row = embedding._block(table).to_pylist()[0]
    assert row["block"] == 4 and sum(len(row[c]) for c in ("ids", "codes", "scales", "errors")) == 50 * (64 + 24)


def test_urls(spark):
    rows = ["https://a.COM/x", "http://example.com/en/1", "http://www.example.com/en/1?q", "http://m.www.example.com/en/", "http://b.net/es/", "http://b.net/esx", "http://b.net/fr/#t", "http://Z.org", None, "", "no scheme", "http://com/", "http://notcom/", "x://a.com", "http://é.org/ß?x"]
    frame = spark.createDataFrame([(i, u, 1, 2) for i, u in enumerate(rows * 2)], "page_id long, url string, text int, n int")
    out = {r.page_id: r for r in urls.judge(frame).collect()}
    assert len(out) == 2 * len(rows)
    rules = [out[i].rule for i in range(len(rows))]
    assert rules == ["com/", "example.com/en/", "www.example.com/en/", "www.example.com/en/", "net/es/", None, "net/fr/", None, None, None, None, "com/", None, None, None]
    assert [out[i].verdict for i in (0, 1, 2, 3, 4, 6, 11)] == ["allow", "block", "allow", "allow", "block", "block", "allow"]
    assert (out[7].host, out[7].path, out[8].host, out[10].path, out[14].host, out[14].path) == ("z.org", "", "", "", "é.org", "/ß")
    assert {r.verdict for r in out.values()} <= {"allow", "block"}
    assert urls.judge(frame.limit(0)).count() == 0
    plan = urls.judge(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan


def test_decontamination_cases(spark, docs, empty):
    item = " ".join(f"w{i}" for i in range(15))
    bench = spark.createDataFrame([(1, item, 0), (2, item, 0), (3, "Tiny item", 0), (4, "", 0), (5, None, 0), (None, "null id words", 0)], "item_id long, text string, rid int")
    rows = [(1, f"start {item} end"), (2, item.upper().replace(" ", "--")), (3, "a tiny, ITEM b"), (4, None), (5, ""), (6, " ".join(item.split()[:12])), (7, "x " * 700 + item), (1, "null id words"), (8, f"{item} {item}")]
    frame = store(spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, words int"), "test-contaminated")
    got = {(r.doc_id, r.n_words): (r.n_hit, r.n_items, r.contaminated) for r in decontam.contamination(frame, bench).collect()}
    assert got == {(1, 17): (15, 2, True), (2, 15): (15, 2, True), (3, 4): (2, 1, True), (4, 0): (0, 0, False), (5, 0): (0, 0, False), (6, 12): (0, 0, False), (7, 715): (15, 2, False), (1, 3): (3, 1, True), (8, 30): (30, 2, True)}
    assert decontam.contamination(empty, bench).count() == 0
    assert {r.n_hit for r in decontam.contamination(docs, bench.limit(0)).collect()} == {0}


def test_proximity(spark):
    rows = store(spark.createDataFrame([(1, "alpha x beta"), (2, "alpha x y z beta"), (3, "beta alpha")], "rid long, words string"), "test-near")
    lookup = decontam.rarest(decontam.phrases(spark.createDataFrame([(1, "alpha q beta")], "item_id long, text string"), window=3).where("phrase <> ''"), rows)
    assert lookup.count() == 0  # no document holds q
    lookup = store(decontam.rarest(decontam.phrases(spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")), rows), "test-lookup")
    postings = decontam.index(rows, lookup)
    assert {r.rid for r in decontam.proximity_matches(postings, lookup).collect()} == set()
    assert {r.rid for r in decontam.proximity_matches(postings, lookup, slop=1).collect()} == {1}
    assert {r.rid for r in decontam.proximity_matches(postings, lookup, slop=3).collect()} == {1, 2, 3}


def test_main_text(spark):
    model = html.train(labelled_pages())
    cases = {
        "<nav><a href=/>m</a></nav><article><h1>T  &amp; x</h1><p>One <b>two</b><br>three.<p>Four &lt; five, a sentence that goes on for a while.</article><footer>&copy; f</footer>": "T & x\nOne two three.\nFour < five, a sentence that goes on for a while.",
        "": "",
        None: "",
        "<script>var a='<p>no</p>'</script><!-- <p>no</p> --><style>p{}</style>": "",
    }
    frame = spark.createDataFrame([(i, "u", h, 1) for i, h in enumerate(cases)], "page_id long, url string, html string, text int")
    out = {r.page_id: r for r in html.main_text(frame, model).collect()}
    assert [out[i].text for i in range(len(cases))] == list(cases.values()) and all(r.n_chars == len(r.text) for r in out.values())
    assert html.main_text(frame.limit(0), model).count() == 0
    held, right, nodes = labelled_pages(60, 99), 0, 0
    for source in held:
        page = html.parse(source)
        labels = []
        for i, a in enumerate(page.attributes):
            m = html.LABEL.search(a)
            labels.append(int(m[1]) if m else (labels[page.parent[i]] if i else 0))
        texts = set(html.extract(model, [source])[0].split("\n"))
        shown = [(n, t) for n, t in page.segments if page.tag[n] not in html.HIDDEN]
        right += sum((t in texts) == bool(labels[n]) for n, t in shown)
        nodes += len(shown)
    assert right / nodes > 0.95


def test_text_after_empty_svg_and_custom_elements_stays():
    cases = {
        '<p>a</p><svg viewBox="0 0 1 1" class=\'x/y\'/><p>b</p>': ["a", "b"],
        "<p>a</p><svg/><p>b</p>": ["a", "b"],
        "<p>a</p><svg width=1 /><p>b</p><svg><path d='M0'/>x</svg><p>c</p>": ["a", "b", "c"],
        "<p>a</p><svg width=1/><p>b</p></svg><p>c</p>": ["a", "c"],
        "<p>a <svg-icon name='x'></svg-icon>b</p><style-guide>c</style-guide><template-part/><p>d</p>": ["a b", "c", "d"],
        "<p>a</p><style>x</style><script/>y</script><TEMPLATE\n>z</template><p>b</p>": ["a", "b"],
    }
    for source, want in cases.items():
        assert " ".join(t for _, t in html.parse(source).segments).split() == " ".join(want).split(), source


def test_sharding_query_moves_whole_records(spark, monkeypatch):
    given, real = [], sharding.shard_documents
    monkeypatch.setattr(sharding, "shard_documents", lambda docs: given.append(docs) or real(docs))
    out = QUERIES["op4_sharding"](spark, SF).collect()
    assert given[0].columns == table(spark, SF, "documents").columns
    same([tuple(r) for r in out], [tuple(r) for r in real(given[0].select("doc_id", "text")).collect()])


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(8)
    parent, depth = np.array([-1, 0, 0, 1, 1, 2]), np.array([0, 1, 1, 2, 2, 2])
    own, edge = rng.normal(size=(6, 2)), rng.normal(size=(2, 2))
    weights, states = [], [[(s >> i) & 1 for i in range(6)] for s in range(64)]
    for x in states:
        weights.append(np.exp(sum(own[i, x[i]] for i in range(6)) + sum(edge[x[parent[i]], x[i]] for i in range(1, 6))))
    total = sum(weights)
    got, pair = html.sum_product(parent, depth, own, edge)
    assert np.allclose(got, [sum(w for w, x in zip(weights, states) if x[i]) / total for i in range(6)])
    assert np.allclose(pair[3], [[sum(w for w, x in zip(weights, states) if (x[1], x[3]) == (a, b)) / total for b in (0, 1)] for a in (0, 1)])


def test_quality(spark, docs, empty):
    sf = "/root/testdata/sf0.01"
    frame, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.score(frame, quality.fit(frame, labels)).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    none = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(empty, none).count() == 0 and quality.keep(docs, none).columns == docs.columns
    assert {r.held_out for r in quality.score(docs, none).collect() if r.doc_id is not None} == {zlib.crc32(str(i).encode()) % 3 == 1 for i in range(200)}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], SF) is None


@pytest.mark.parametrize("name", ["op9_urls", "op10_decontam"])
def test_native(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_row_numbers_do_not_follow_the_cores(spark):
    """What Spark cuts files by is fixed once, so that a lost executor cannot move the numbers; a user's value stays."""
    cores = "spark.sql.leafNodeDefaultParallelism"
    docs = table(spark, SF, "documents")
    before = spark.conf.get(cores, None)
    try:
        spark.conf.unset(cores)
        row_numbers(docs)
        assert spark.conf.get(cores) == str(spark.sparkContext.defaultParallelism)
        spark.conf.set(cores, "3")
        row_numbers(docs)
        assert spark.conf.get(cores) == "3"
    finally:
        spark.conf.unset(cores) if before is None else spark.conf.set(cores, before)


@pytest.mark.parametrize("text", [" " * 5_000_000, "\n" * 5_000_000, "é" * 1_000_000, "x" * 5_000_000, " \n\t" * 1_000_000, "<|endoftext|>" + " " * 1_500_000 + "end"], ids=["spaces", "newlines", "accents", "letters", "blanks", "special"])
def test_packing_of_very_long_runs(text):
    import tokenizers

    ids = packing.encode(tokenizer_path(), text)
    part = text[:100_000]
    assert packing.encode(tokenizer_path(), part).tolist() == [*tokenizers.Tokenizer.from_file(tokenizer_path()).encode(part, add_special_tokens=False).ids, 0]
    entries = packing.byte_bpe(tokenizer_path()).entries
    assert b"".join(entries[i] for i in ids[:-1]).decode() == text
