"""Joins (inventory D)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.core import assert_unique, attach, levels
from tallyloom.ordered import running
from tallyloom.operators.reshape import only_unique


def left_join(df: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on one or many keys; size and skew handling is left to the adaptive planner."""
    return df.join(right, list(keys), "left")


def left_join_keep(df: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join that cannot add rows: the right key is checked to be unique first."""
    assert_unique(right, keys)
    return df.join(right, list(keys), "left")


def lookup(df: DataFrame, right: DataFrame, key: str, value: str, default=None, out: str | None = None) -> DataFrame:
    """Map a key through a two-column table; missing keys get ``default``."""
    mapped = attach(df, right.select(F.col(key), F.col(value).alias("_v")), [key])
    found = F.col("_v") if default is None else F.coalesce(F.col("_v"), F.lit(default))
    return mapped.withColumn(out or value, found).drop("_v")


def inner_join(df: DataFrame, right: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Inner join on the keys, or on all shared column names."""
    return df.join(right, list(keys) if keys else [c for c in df.columns if c in right.columns], "inner")


def semi(df: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(right.select(*keys), list(keys), "left_semi")


def anti(df: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(right.select(*keys), list(keys), "left_anti")


def unique_key_join(df: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Left join restricted to keys that occur exactly once on both sides.

    Both sides are reduced to one row per key by aggregation, so repeated keys cannot multiply.
    """
    once_left = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select(*key)
    pairs = only_unique(right, key).join(once_left, list(key), "left_semi")
    return attach(df, pairs, key)


def join_where(df: DataFrame, right: DataFrame, keys: Sequence[str], condition: Column) -> DataFrame:
    """Inner equi join with a residual condition on the joined row."""
    return df.join(right, list(keys), "inner").where(condition)


def nearest_join(
    df: DataFrame, right: DataFrame, value: str, payload: str, band: Sequence[str] = (), chunks: int | None = None
) -> DataFrame:
    """Give each row the payload of the nearest ``right`` value in the same band (ties: the lower value).

    Distinct values of both sides are scanned once upwards and once downwards, carrying the last
    known ``right`` value; no pairs are formed.  ``right`` has one row per (band, value).
    """
    band = list(band)
    known = right.select(*band, F.col(value).alias("_x"), F.col(value).alias("_known"))
    asked = df.select(*band, F.col(value).alias("_x")).distinct().withColumn("_known", F.lit(None).cast(right.schema[value].dataType))
    points = known.unionByName(asked).groupBy(*band, "_x").agg(F.max("_known").alias("_known"))
    up = running(points, band, ["_x"], {"_below": ("max", F.col("_known"))}, chunks=chunks)
    both = running(up, band, ["_x"], {"_above": ("min", F.col("_known"))}, reverse=True, chunks=chunks)
    x = F.col("_x")
    nearest = (
        F.when(F.col("_below").isNull(), F.col("_above"))
        .when(F.col("_above").isNull(), F.col("_below"))
        .when(x - F.col("_below") <= F.col("_above") - x, F.col("_below"))
        .otherwise(F.col("_above"))
    )
    chosen = both.select(*band, x.alias(value), nearest.alias("_nearest"))
    payloads = right.select(*band, F.col(value).alias("_nearest"), payload)
    resolved = chosen.join(payloads, [*band, "_nearest"], "left")
    return df.join(resolved, [*band, value], "left").withColumnRenamed("_nearest", f"nearest_{value}")


def band_join(df: DataFrame, right: DataFrame, key: str, k: int) -> DataFrame:
    """Join each row to the right rows whose integer key is within ``k``; needs one right row per key.

    The right side is copied to its ``2k + 1`` neighbours and joined by equality.
    """
    near = right.withColumn(f"near_{key}", F.col(key)).withColumn(key, F.explode(F.sequence(F.col(key) - k, F.col(key) + k)))
    return df.join(near, key, "inner")


def complete_grid(entities: DataFrame, period: str, first: Column, last: Column) -> DataFrame:
    """Every entity in every period of ``first..last``; the grid is the result, built by a generator."""
    return entities.withColumn(period, F.explode(F.sequence(first, last)))


def cross(df: DataFrame, right: DataFrame, col: str, max_levels: int = 1000) -> DataFrame:
    """Pair every row with each level of a small domain (checked against ``max_levels``)."""
    domain = levels(right, col, max_levels)
    return df.withColumn(col, F.explode(F.array(*[F.lit(v) for v in domain])))


def glue(blocks: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Put feature blocks side by side by joining on an explicit key."""
    return reduce(lambda a, b: a.join(b, list(key), "inner"), blocks)
