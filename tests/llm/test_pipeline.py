"""The pipeline's stages, one by one, against what their operators say."""

from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import decontam, quality, simhash, suffix
from tallyloom.llm.common import store, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert len(corpus_pipeline.STAGES) == 5

    kept = store(stages["quality classifier"](spark, docs, SF), "t")
    scored = quality.score(docs, quality.fit(docs, table(spark, SF, "labels")))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in scored.where("predicted = 1").collect()}
    assert kept.columns == docs.columns

    single = store(stages["simhash near-dedup"](spark, kept, SF), "t")
    groups = simhash.near_duplicates(kept).collect()
    assert sorted(r.doc_id for r in single.collect()) == sorted({r.component_id for r in groups})
    assert single.columns == docs.columns

    cut = store(stages["suffix-array dedup"](spark, single, SF), "t")
    removed = {r.doc_id: r for r in suffix.dedup(single).collect()}
    before = {r.doc_id: r.text for r in single.collect()}
    for r in cut.collect():
        x = removed[r.doc_id]
        assert r.text == (bytes(x.kept).decode(errors="ignore") if x.n_removed else before[r.doc_id]) and (not x.n_removed or r.n_chars == len(r.text))
    assert cut.count() == single.count() and cut.columns == docs.columns

    clean = store(stages["benchmark decontamination"](spark, cut, SF), "t")
    judged = decontam.contamination(cut, table(spark, SF, "benchmark"))
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in judged.where("not contaminated").collect()}

    pieces = stages["packing"](spark, clean, SF)
    want = {r.doc_id for r in clean.select("doc_id").collect()}
    whole = pieces.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id for r in whole} == want and all(r.n == r.doc_tokens for r in whole)


def test_run_and_odd_rows(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    odd = [(1, "same text here and more", 1, 9), (1, "same text here and more", 1, 9), (None, None, 1, 9), (2, "", 1, 9), (2, None, 1, 9)]
    docs = store(spark.createDataFrame(odd, "doc_id long, text string, rid int, row int"), "t")
    one = corpus_pipeline.simhash_dedup(spark, docs, SF)
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == [1, 2]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, store(docs.limit(0), "t"), SF).count() == 0
