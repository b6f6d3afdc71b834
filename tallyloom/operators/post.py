"""Prediction post-processing (inventory P)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.core import match, with_scalars
from tallyloom.operators.impute import TARGET_PAIRS


def override(df: DataFrame, pred: str, rules: Sequence[Column], value: float = 0.0) -> DataFrame:
    """Force the prediction where any business rule holds; unknown rules do not fire."""
    hit = F.lit(False)
    for rule in rules:
        hit = hit | F.coalesce(rule, F.lit(False))
    return df.withColumn(pred, F.when(hit, F.lit(value)).otherwise(F.col(pred)))


def attach_submission(keys: DataFrame, preds: DataFrame, key: Sequence[str]) -> DataFrame:
    """Predictions on a list of keys, by key and never by position."""
    return keys.join(preds, list(key), "left")


def known_override(preds: DataFrame, known: DataFrame, key: Sequence[str], pred: str, value: str) -> DataFrame:
    """Known values replace predictions."""
    joined = preds.join(known.select(*key, F.col(value).alias("_known")), list(key), "left")
    return joined.withColumn(pred, F.coalesce(F.col("_known"), F.col(pred))).drop("_known")


def broadcast_periods(preds: DataFrame, pred: str, periods: Sequence[str]) -> DataFrame:
    """The same prediction in several period columns."""
    return preds.withColumns({p: F.col(pred) for p in periods}).drop(pred)


def inverse_chain(preds: DataFrame, pred: str, steps: Sequence[tuple[str, dict]]) -> DataFrame:
    """Undo target transforms, last applied first.

    Steps in the order they were applied: ``("standardize", {"mean": m, "std": s})`` or one of the
    named transforms with no parameters.
    """
    value = F.col(pred)
    for name, params in reversed(list(steps)):
        value = value * params["std"] + params["mean"] if name == "standardize" else TARGET_PAIRS[name][1](value)
    return preds.withColumn(pred, value)


def fitted_inverse(preds: DataFrame, pred: str, train: DataFrame, target: str, fn: str) -> DataFrame:
    """Undo standardising after ``fn``: the mean and std of the transformed training target are read as a subquery."""
    moved = TARGET_PAIRS[fn][0](F.col(target).cast("double"))
    scaled = with_scalars(preds, train, {"m": F.avg(moved), "s": F.stddev_pop(moved)})
    return scaled.withColumn(pred, TARGET_PAIRS[fn][1](F.col(pred) * F.col("_s.s") + F.col("_s.m"))).drop("_s")


def segment_blend(preds: DataFrame, key: Sequence[str], segment: str, fold: str, pred: str, k: int) -> DataFrame:
    """Two models in one fold numbering: folds 0..k-1 serve everyone, folds k..2k-1 serve the segment.

    Each row gets the mean over its own range; rows of the segment fall back to the general range.
    """
    general = F.avg(F.when(F.col(fold) < k, F.col(pred)))
    special = F.avg(F.when(F.col(fold) >= k, F.col(pred)))
    return preds.groupBy(*key, segment).agg(F.coalesce(F.when(F.col(segment) == 1, special), general).alias(pred))
