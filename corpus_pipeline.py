"""Corpus pipeline: quality filter, near-duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) with ``docs`` read from a stored table and judges all rows it is given.  All
stages but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontam, packing, quality, simhash, suffix
from tallyloom.llm.common import having, replaced, store, table
from tallyloom.llm.queries import tokenizer_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects; it is trained on the labelled ones among ``docs``."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every near-duplicate group: the smallest id, of its rows the first."""
    groups = simhash.near_duplicates(docs)
    first = groups.groupBy("component_id").agg(F.min_by("rid", F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("rid"))
    return having(docs, first)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every repeated string of 200 bytes out of the texts; ``n_chars`` follows where a text changed."""
    cut = suffix.dedup(docs).where("n_removed > 0").select("rid", "kept_text")
    return replaced(docs, cut, {"text": F.col("kept_text"), "n_chars": F.length("kept_text")})


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents of which at least one word in twenty stands in a benchmark phrase."""
    clean = decontam.contamination(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select("rid")
    return having(docs, clean)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents left, in sequences of at most 1024 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_filter),
    ("simhash near-dedup", simhash_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", packed),
]
#: SQL can express neither the trained classifier nor the fingerprints; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = store(docs, f"pipeline-{n}")
    return docs
