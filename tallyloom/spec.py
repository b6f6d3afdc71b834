"""Small immutable descriptions of a table and of a feature job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLIT = "split"
TRAIN, TEST = "train", "test"
SCOPES = ("train", "all")


@dataclass(frozen=True)
class TableSpec:
    """Column roles by name; ``states`` records the preparation steps already applied."""

    key: tuple[str, ...]
    target: str
    task: str = "regression"  # regression | binary | classification
    metric: str = "rmse"
    cat: tuple[str, ...] = ()
    num: tuple[str, ...] = ()
    drop: tuple[str, ...] = ()
    heavy_tailed: bool = False
    states: tuple[str, ...] = ()

    def with_state(self, state: str) -> TableSpec:
        return replace(self, states=(*self.states, state))

    def without(self, cols: list[str]) -> TableSpec:
        gone = set(cols)
        return replace(
            self,
            cat=tuple(c for c in self.cat if c not in gone),
            num=tuple(c for c in self.num if c not in gone),
        )

    def version(self, prep: str, scope: str, toy: bool = False) -> str:
        """Cache key built from all three flags, so no two variants can share a folder."""
        return f"{prep}-{scope}-{'toy' if toy else 'full'}"


@dataclass(frozen=True)
class FeatureJob:
    """A data set as four functions: load, features, folds and finish."""

    name: str
    spec: TableSpec
    load: Callable[[SparkSession, str], DataFrame]
    features: Callable[[DataFrame, str], DataFrame]
    folds: Callable[[DataFrame], DataFrame] = field(default=lambda df: df)
    finish: Callable[[DataFrame], DataFrame] = field(default=lambda preds: preds)

    def run(self, spark: SparkSession, path: str, scope: str = "all") -> DataFrame:
        return self.folds(self.features(self.load(spark, path), scope))


@dataclass(frozen=True)
class Fitted:
    """Statistics of a fitted operator (a DataFrame, or a bounded list) and how to apply them."""

    stats: object
    apply: Callable[[DataFrame], DataFrame]

    def transform(self, df: DataFrame) -> DataFrame:
        return self.apply(df)


def in_scope(df: DataFrame, scope: str, source: DataFrame | None = None) -> DataFrame:
    """Rows that statistics may look at: training rows only, or training and test together.

    ``source`` names another table with the same rows to learn from.  Jobs that add many features pass
    the table they started with, so that learning one feature does not run the joins of the others.
    """
    df = df if source is None else source
    if scope not in SCOPES:
        raise ValueError(f"scope must be one of {SCOPES}, got {scope!r}")
    return df.filter(F.col(SPLIT) == TRAIN) if scope == "train" else df
