"""Helpers of the operators in this package: shared storage, word rules, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.core import work_dir

#: White space that separates words: U+0020 and U+0009 to U+000D (what ``bytes.split()`` splits on).
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and no later stage runs it again."""
    path = work_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_numbers(docs: DataFrame) -> Column:
    """A number for every row of a stored table, the same in every scan.

    Spark cuts files by the cores it has at that moment, so the numbers would move when an executor is lost between two
    scans.  The session's ``spark.sql.leafNodeDefaultParallelism`` is therefore fixed at its present value where it is unset.
    """
    spark, cores = docs.sparkSession, "spark.sql.leafNodeDefaultParallelism"
    if spark.conf.get(cores, None) is None:
        spark.conf.set(cores, spark.sparkContext.defaultParallelism)
    return F.monotonically_increasing_id()


def _fresh(name: str, taken: list[str]) -> str:
    while name.lower() in (c.lower() for c in taken):
        name += "_"
    return name


def having(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose number is a ``rid`` of ``rows``.

    ``rid`` comes from :func:`row_numbers` over ``docs``, which must be a stored table.  No column of ``docs`` is hidden by the
    number.
    """
    rid = _fresh("rid", docs.columns)
    return docs.withColumn(rid, row_numbers(docs)).join(rows.select(F.col("rid").alias(rid)), rid, "left_semi").select(docs.columns)


def replaced(docs: DataFrame, rows: DataFrame, new: dict[str, Column]) -> DataFrame:
    """``docs`` with columns replaced by ``new`` (expressions over ``rows``) where ``rows`` holds their ``rid``, as in :func:`having`."""
    rid, value = _fresh("rid", docs.columns), _fresh("new", docs.columns)
    values = rows.select(F.col("rid").alias(rid), F.struct(*[c.alias(k) for k, c in new.items()]).alias(value))
    joined = docs.withColumn(rid, row_numbers(docs)).join(values, rid, "left")
    pick = {c: F.when(F.col(value).isNotNull(), F.col(value)[c].cast(docs.schema[c].dataType)).otherwise(F.col(f"`{c}`")) for c in new if c in docs.columns}
    return joined.select(*[pick.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased; every other character unchanged."""
    return F.translate(c, UPPER, LOWER)


def spaced_words(c: Column) -> Column:
    """The words of a text joined by single spaces; null gives an empty string."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACES, " "))


def top_rows(rows: DataFrame, by: list[str], order: list[Column], n: int, spread: Column, parts: int = 64) -> DataFrame:
    """The first ``n`` rows of every group in ``order``: first of each of its ``parts`` (by the hash ``spread``), then of what is left."""
    part = _fresh("part", rows.columns)
    place = _fresh("place", rows.columns)
    rows = rows.withColumn(part, F.pmod(spread, F.lit(parts)))
    for keys in ([*by, part], by):
        rows = rows.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(place) <= n).drop(place)
    return rows.drop(part)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph: rows (``node``, ``root``) for every node on an edge.

    ``edges`` has long columns ``a`` and ``b``; direction and repeats do not matter; the root is the smallest
    node of the component.  Large-star and small-star steps alternate until the edges no longer change; each step
    groups with map-side combine and is a join of edges with one row per node, so a hub is never one task's group.
    Every round is written to the shared folder.  An empty graph gives no rows.
    """

    def star(pairs: DataFrame, lowest: DataFrame, test: Column) -> DataFrame:
        """Hang the neighbours that pass ``test`` on the smallest node around."""
        return pairs.join(lowest, "u").where(test).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")

    edges = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = star(both, lowest, F.col("v") > F.col("u")).distinct()
        down = store(large.select(F.col("a").alias("u"), F.col("b").alias("v")), "edges")
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        # each node's smaller neighbours and the node itself go below the smallest of them
        own = lowest.select(F.col("u").alias("a"), F.col("m").alias("b"))
        edges = store(star(down, lowest, F.lit(True)).union(own).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b"), F.col("b")).distinct())
