"""Set operations, de-duplication and reshaping (inventory E)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.core import levels
from tallyloom.spec import SPLIT, TEST, TRAIN


def union_split(train: DataFrame, test: DataFrame) -> DataFrame:
    """Stack train and test with a ``split`` tag; columns missing on one side become null."""
    return train.withColumn(SPLIT, F.lit(TRAIN)).unionByName(test.withColumn(SPLIT, F.lit(TEST)), allowMissingColumns=True)


def split_back(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(SPLIT) == TRAIN).drop(SPLIT), df.where(F.col(SPLIT) == TEST).drop(SPLIT)


def union_missing(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.unionByName(other, allowMissingColumns=True)


def distinct(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return (df.select(*cols) if cols else df).distinct()


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key by a total order, as a min aggregate (combined map-side, so hot keys are safe)."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def only_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop every row whose key repeats; keys are combined map-side before the shuffle.

    The other columns are taken one by one: plain numbers are combined in a hash table, structs would be sorted.
    """
    rest = [c for c in df.columns if c not in keys]
    once = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.any_value(c).alias(c) for c in rest]).where("_n = 1")
    return once.select(*df.columns)


def unpivot(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(cols), name, value)


def pivot(df: DataFrame, rows: Sequence[str], col: str, values: Sequence, agg: Column) -> DataFrame:
    """Pivot over a stated list of values, so no extra job looks for them."""
    return df.groupBy(*rows).pivot(col, list(values)).agg(agg)


def crosstab_dense(df: DataFrame, a: str, b: str, max_levels: int = 1000) -> DataFrame:
    """Pair counts including empty cells; ``b`` is a small domain, ``a`` may be large.

    Each level of ``a`` is expanded with the collected levels of ``b``.
    """
    counts = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    domain = F.array(*[F.lit(v) for v in levels(df, b, max_levels)])
    cells = counts.select(a).distinct().withColumn(b, F.explode(domain))
    return cells.join(counts, [a, b], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def transpose(df: DataFrame, id_col: str, cols: Sequence[str], max_rows: int = 1000) -> DataFrame:
    """Rows become columns and columns rows; the number of rows turned into columns is checked."""
    ids = levels(df, id_col, max_rows)
    long = df.unpivot([id_col], list(cols), "column", "value")
    return long.groupBy("column").pivot(id_col, ids).agg(F.max("value"))


def append_known(df: DataFrame, test: DataFrame, known: DataFrame, key: str, target: str) -> DataFrame:
    """Add the test rows whose target is known to the training rows."""
    return df.unionByName(test.drop(target).join(known.select(key, target), key, "inner"))
