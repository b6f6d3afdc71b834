"""Column selection driven by a profile (inventory C): one aggregate over all columns, then a projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.core import with_scalars
from tallyloom.ranks import quantiles
from tallyloom.spec import SPLIT, in_scope


def _features(df: DataFrame, cols: Sequence[str] | None) -> list[str]:
    return list(cols) if cols is not None else [c for c in df.columns if c != SPLIT]


def column_profile(df: DataFrame, cols: Sequence[str] | None = None, distinct: bool = True) -> DataFrame:
    """One row per column: rows, non-null count, missing share, whether it is constant, distinct count.

    ``n_distinct`` counts (column, value) pairs after an unpivot, so that the values of all columns
    are spread over the cluster; nulls are ignored.
    """
    cols = _features(df, cols)
    base = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.count(F.lit(1)).alias("n_rows"),
                    F.count(c).alias("n_values"),
                    (F.min(c).eqNullSafe(F.max(c)) & (F.count(c) > 0)).cast("int").alias("is_constant"),
                )
                for c in cols
            ]
        ).alias("p")
    ).select(F.inline("p"))
    base = base.withColumn(
        "missing", F.try_divide((F.col("n_rows") - F.col("n_values")).cast("double"), F.col("n_rows"))
    )
    if not distinct:
        return base
    text = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    pairs = text.unpivot([], cols, "column", "value").where("value is not null").groupBy("column", "value").agg(F.lit(1).alias("one"))
    found = pairs.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
    return base.join(found, "column", "left").withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)))


def _profile_rows(df: DataFrame, cols: Sequence[str], exprs: dict[str, Column]) -> dict:
    """One aggregate row: as many values as there are columns, whatever the size of the table."""
    return df.agg(*[e.alias(c) for c, e in exprs.items()]).first().asDict()


def drop_constant(df: DataFrame, scope: str = "all", cols: Sequence[str] | None = None, source: DataFrame | None = None) -> DataFrame:
    """Drop columns with a single non-null value (nulls ignored); min = max decides, no distinct count."""
    cols = _features(df, cols)
    row = _profile_rows(in_scope(df, scope, source), cols, {c: (F.count(c) > 0) & F.min(c).eqNullSafe(F.max(c)) for c in cols})
    return df.drop(*[c for c in cols if row[c]])


def drop_all_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = _features(df, cols)
    row = _profile_rows(df, cols, {c: F.count(c) for c in cols})
    return df.drop(*[c for c in cols if row[c] == 0])


def drop_sparse(df: DataFrame, max_missing: float = 0.98, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop columns whose missing share is above the limit."""
    cols = _features(df, cols)
    row = _profile_rows(df, cols, {c: F.avg(F.col(c).isNull().cast("double")) for c in cols})
    return df.drop(*[c for c in cols if (row[c] or 0.0) > max_missing])


def drop_single_value(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop columns with exactly one distinct non-null value over all rows."""
    return drop_constant(df, "all", cols)


def duplicate_columns(df: DataFrame, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Pairs of columns that are equal in every row (null equals null).

    One pass builds an order-free fingerprint per column; only columns with equal fingerprints are
    compared value by value.
    """
    cols = list(cols)
    prints = df.agg(
        *[
            F.struct(
                F.sum(F.xxhash64(*key, F.col(c).cast("string"), F.col(c).isNull()).cast("decimal(38,0)")).alias("a"),
                F.bit_xor(F.xxhash64(F.lit(1), *key, F.col(c).cast("string"), F.col(c).isNull())).alias("b"),
            ).alias(c)
            for c in cols
        ]
    ).first()
    by_print: dict = {}
    for c in cols:
        by_print.setdefault((prints[c]["a"], prints[c]["b"]), []).append(c)
    pairs = [(g[0], other) for g in by_print.values() for other in g[1:]]
    schema = "left string, right string"
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    same = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(a).alias("left"), F.lit(b).alias("right"),
                    F.min(F.col(a).cast("string").eqNullSafe(F.col(b).cast("string")).cast("int")).alias("same"),
                )
                for a, b in pairs
            ]
        ).alias("p")
    )
    return same.select(F.inline("p")).where("same = 1").drop("same")


def drop_duplicate_cols(df: DataFrame, key: Sequence[str], cols: Sequence[str], prefer: str = "_0") -> DataFrame:
    """Of equal columns keep one: the first whose name does not hold ``prefer``, else the first."""
    equal: dict[str, list[str]] = {}
    for r in duplicate_columns(df, key, cols).collect():  # at most one row per column
        equal.setdefault(r["left"], [r["left"]]).append(r["right"])
    gone = set()
    for names in equal.values():
        names.sort(key=df.columns.index)
        stays = next((n for n in names if prefer not in n), names[0])
        gone |= set(names) - {stays}
    return df.drop(*gone)


def support(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """Sum of the target over the rows where the column is not zero, one row per column."""
    return df.agg(
        F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.coalesce(F.sum(F.when(F.col(c) != 0, F.col(target))), F.lit(0)).cast("bigint").alias("support"))
                for c in cols
            ]
        ).alias("p")
    ).select(F.inline("p"))


def drop_low_support(df: DataFrame, target: str, cols: Sequence[str], min_pos: int = 4) -> DataFrame:
    row = _profile_rows(df, cols, {c: F.coalesce(F.sum(F.when(F.col(c) != 0, F.col(target))), F.lit(0)) for c in cols})
    return df.drop(*[c for c in cols if row[c] < min_pos])


def binary_cols(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    """Columns with exactly two levels: every value equals the minimum or the maximum, and they differ."""
    cols = _features(df, cols)
    ends = with_scalars(
        df.select(*cols), df, {f"{e}_{c}": getattr(F, e)(c) for c in cols for e in ("min", "max")}, "_e"
    )
    row = _profile_rows(
        ends, cols,
        {
            c: F.min((F.col(c) == F.col(f"_e.min_{c}")) | (F.col(c) == F.col(f"_e.max_{c}")))
            & (F.min(c) != F.max(c))
            for c in cols
        },
    )
    return [c for c in cols if row[c]]


def categorical_cols(df: DataFrame, max_levels: int = 1000, exclude_tokens: Sequence[str] = ()) -> list[str]:
    """Columns with fewer than ``max_levels`` levels whose name holds none of the tokens."""
    cols = [c for c in _features(df, None) if not any(t in c for t in exclude_tokens)]
    rows = column_profile(df, cols).where(F.col("n_distinct") < max_levels).select("column").collect()
    few = {r["column"] for r in rows}
    return [c for c in cols if c in few]


def cardinality_class(df: DataFrame, cols: Sequence[str], low: int = 5) -> DataFrame:
    """Binary (at most 2 levels), low (fewer than ``low``) or high, one row per column."""
    return column_profile(df, cols).select(
        "column", "n_distinct",
        F.when(F.col("n_distinct") <= 2, "binary").when(F.col("n_distinct") < low, "low").otherwise("high").alias("kind"),
    )


def skewness_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Population skewness per column."""
    return df.agg(
        F.array(*[F.struct(F.lit(c).alias("column"), F.skewness(F.col(c).cast("double")).alias("skew")) for c in cols]).alias("p")
    ).select(F.inline("p"))


def skew_gate(df: DataFrame, cols: Sequence[str], limit: float = 0.75, suffix: str = "_gated") -> DataFrame:
    """Add a log1p copy of skewed columns and a plain copy of the others."""
    row = _profile_rows(df, cols, {c: F.skewness(F.col(c).cast("double")) for c in cols})
    return df.withColumns(
        {
            c + suffix: F.log1p(F.col(c).cast("double")) if (row[c] or 0.0) > limit else F.col(c).cast("double")
            for c in cols
        }
    )


def iqr_filter(df: DataFrame, col: str, k: float = 1.5) -> DataFrame:
    """Keep rows inside Q1 - k*IQR ... Q3 + k*IQR.

    The two exact quartiles are read first, so the filter is a plain range that reaches the scan.
    """
    q = quantiles(df, [], col, {"q1": 0.25, "q3": 0.75}).first()
    if q is None or q["q1"] is None:
        return df.limit(0)
    margin = k * (q["q3"] - q["q1"])
    return df.where(F.col(col).cast("double").between(q["q1"] - margin, q["q3"] + margin))


def numeric_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
