"""Benchmark decontamination with a distributed positional inverted index.

Every window of 13 consecutive words of a benchmark item is a phrase (an item of fewer words is one phrase).  The
corpus frequency of every benchmark term is counted over all documents; each phrase is looked up by its rarest
terms.  The index stores the postings (document, position) of those terms only; lists are moved by the term's
offset in the phrase, so equal starts meet, and the documents left are compared with the phrase word by word.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import lower_ascii, row_numbers, store

WINDOW = 13
#: Bytes that separate words once A-Z are lower-cased: everything in ASCII but digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHARE = 20  # contaminated: at least one word in so many is hit


def spaced(c: Column) -> Column:
    """Lower-cased words joined by single spaces; null gives an empty string."""
    return F.trim(F.regexp_replace(lower_ascii(F.coalesce(c, F.lit(""))), SEPARATORS, " "))


def word_list(c: Column) -> Column:
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


def phrases(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct phrases of a benchmark: ``phrase``, ``n`` (words), ``items`` (ids as text).  Items without words have none."""
    words = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), word_list(spaced(F.col(text_col))).alias("w")).where(F.size("w") > 0)
    starts = words.select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))).alias("i"))
    out = starts.select("item", F.slice("w", F.col("i"), window).alias("w"))
    return out.groupBy(F.array_join("w", " ").alias("phrase"), F.size("w").alias("n")).agg(F.collect_set("item").alias("items"))


def rarest(wanted: DataFrame, rows: DataFrame, depth: int = 2) -> DataFrame:
    """Per phrase its ``depth`` rarest terms in ``rows`` (column ``words``): ``phrase``, ``term``, ``off``, ``rank`` (1 = rarest).

    Phrases with a term that no document holds cannot occur and are left out.
    """
    terms = wanted.select("phrase", F.posexplode(F.split("phrase", " ")).alias("off", "term")).groupBy("phrase", "term").agg(F.min("off").alias("off"))
    terms = store(terms, "phrase-terms")
    corpus = rows.select(F.explode(word_list(F.col("words"))).alias("term"))
    vocabulary = store(terms.select("term").distinct(), "vocabulary")  # its size is known then, and decides how it is joined
    counts = corpus.join(vocabulary, "term").groupBy("term").agg(F.count("*").alias("freq"))
    ranked = terms.join(counts, "term", "left").groupBy("phrase").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "term", "off"))).alias("t"))
    ranked = ranked.where(F.col("t")[0]["freq"] > 0)
    return ranked.select("phrase", F.posexplode(F.slice("t", 1, depth)).alias("rank", "t")).select("phrase", "t.term", "t.off", (F.col("rank") + 1).alias("rank"))


def index(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Positional index of the distinct ``term`` values over ``rows`` (rid, words): ``term``, ``rid``, ``pos`` (from 0), stored."""
    postings = rows.select("rid", F.posexplode(word_list(F.col("words"))).alias("pos", "term"))
    return store(postings.join(store(terms.select("term").distinct(), "vocabulary"), "term").select("term", "rid", "pos"), "postings")


def proximity_matches(postings: DataFrame, lookup: DataFrame, slop: int = 0) -> DataFrame:
    """(rid, phrase, start) where the looked-up terms of a phrase stand within ``slop`` words of their places.

    Starts from the rarest term's list; ``slop=0`` intersects the offset-adjusted lists exactly.
    """
    hits = postings.join(lookup, "term").select("phrase", "rank", "rid", (F.col("pos") - F.col("off")).alias("start")).where(F.col("start") >= -slop)
    first, rest = hits.where("rank = 1").drop("rank"), hits.where("rank > 1")
    depths = lookup.groupBy("phrase").agg(F.max("rank").alias("depth"))
    if slop == 0:
        meet = first.select("*", F.lit(1).alias("rank")).union(rest.select("phrase", "rid", "start", "rank"))
        found = meet.groupBy("rid", "phrase", "start").agg(F.count("*").alias("met"))
    else:
        near = rest.select("phrase", "rid", F.col("start").alias("other"), "rank")
        pairs = first.join(near, ["phrase", "rid"], "left").where(f"other is null or abs(other - start) <= {slop}")
        found = pairs.groupBy("rid", "phrase", "start").agg((F.count_distinct("rank") + 1).alias("met"))
    return found.join(depths, "phrase").where("met = depth").select("rid", "phrase", "start")


def exact_matches(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates (rid, phrase, start) whose phrase really stands there, with its length ``n``."""
    candidates = store(candidates.where("start >= 0").withColumn("n", F.size(F.split("phrase", " "))), "candidates")
    texts = rows.select("rid", "words").join(store(candidates.select("rid").distinct(), "candidate-rows"), "rid", "left_semi")
    at = F.slice("w", F.col("start") + 1, F.col("n"))
    return texts.select("rid", F.split("words", " ").alias("w")).join(candidates, "rid").where(F.array_join(at, " ") == F.col("phrase")).select("rid", "phrase", "start", "n")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document row: ``doc_id``, ``rid``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``.

    ``n_hit`` counts words inside any occurrence of a phrase; ``items_sha256`` hashes the sorted, comma-joined ids of the
    items with an occurrence (of an empty string for none).  Null text has no words; a null item id counts as an
    empty one; equal items share their phrases; repeated rows are judged alike; an empty benchmark hits nothing and
    empty documents give an empty result.  Other columns are ignored.
    """
    rows = docs.select(row_numbers(docs).alias("rid"), F.col(id_col).cast("long").alias("doc_id"), spaced(F.col(text_col)).alias("words"))
    rows = store(rows.withColumn("n_words", F.size(word_list(F.col("words"))).cast("long")), "decontam-rows")
    wanted = store(phrases(items, item_col, item_text, window), "phrases")
    lookup = store(rarest(wanted, rows), "lookup")
    found = store(exact_matches(rows, proximity_matches(index(rows, lookup), lookup)), "matches")
    hit = found.select("rid", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("pos")).distinct().groupBy("rid").agg(F.count("*").alias("n_hit"))
    named = found.select("rid", "phrase").distinct().join(wanted.select("phrase", "items"), "phrase").select("rid", F.explode("items").alias("item")).distinct()
    named = named.groupBy("rid").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("items_sha256"))
    out = rows.select("rid", "doc_id", "n_words").join(hit.join(named, "rid"), "rid", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id", "rid", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
    SELECT doc_id, CASE WHEN s = '' THEN [] ELSE string_split(s, ' ') END AS w
    FROM (SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' ') AS s FROM documents)
), b AS (
    SELECT item_id, CASE WHEN s = '' THEN [] ELSE string_split(s, ' ') END AS w
    FROM (SELECT item_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' ') AS s FROM benchmark)
), p AS (
    SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 12), ' ') AS phrase, least(len(w), 13) AS n
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM p
), g AS (
    SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS phrase
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), m AS (SELECT g.doc_id, g.i, g.n, p.item_id FROM g JOIN p ON g.phrase = p.phrase AND g.n = p.n
), h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS pos FROM m) GROUP BY doc_id
), t AS (
    SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
    coalesce(t.items_sha256, sha256('')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
