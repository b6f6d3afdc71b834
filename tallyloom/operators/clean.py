"""Projection, filters and value repair (inventory B).  Every operator is a single projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.core import attach
from tallyloom.spec import SPLIT, TEST, TRAIN, in_scope


def replace_cols(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Replace or add many columns in one projection."""
    return df.withColumns(new) if new else df


def split_xy(df: DataFrame, target: str, ids: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Features without target and ids, and the target."""
    return df.drop(target, *ids), df.select(*ids, target)


def keep(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)


def matching(df: DataFrame, prefix: str | None = None, contains: str | None = None) -> list[str]:
    """Names that start with ``prefix`` or hold ``contains``."""
    return [
        c for c in df.columns
        if (prefix is not None and c.startswith(prefix)) or (contains is not None and contains in c)
    ]


def drop_matching(df: DataFrame, prefix: str | None = None, contains: str | None = None) -> DataFrame:
    return df.drop(*matching(df, prefix, contains))


def nullify_matching(df: DataFrame, prefix: str) -> DataFrame:
    """Blank out every column with the prefix, keeping its type."""
    return replace_cols(df, {c: F.lit(None).cast(df.schema[c].dataType) for c in matching(df, prefix)})


def sentinel_to_null(df: DataFrame, cols: Sequence[str], values: Sequence) -> DataFrame:
    return replace_cols(df, {c: F.when(~F.col(c).isin(list(values)), F.col(c)) for c in cols})


def null_to(df: DataFrame, mapping: dict[str, object]) -> DataFrame:
    """Fill nulls with a constant per column."""
    return replace_cols(
        df, {c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in mapping.items()}
    )


def recode(df: DataFrame, col: str, rules: Sequence[tuple[object, object, object]]) -> DataFrame:
    """Rules ``(low, high, value)``: the first closed range that holds the value replaces it."""
    out = None
    for low, high, value in rules:
        test = F.col(col).between(low, high)
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return df.withColumn(col, out.otherwise(F.col(col)).cast(df.schema[col].dataType))


def zero_to(df: DataFrame, cols: Sequence[str], value) -> DataFrame:
    return replace_cols(
        df, {c: F.when(F.col(c) == 0, F.lit(value)).otherwise(F.col(c)).cast(df.schema[c].dataType) for c in cols}
    )


def clip(df: DataFrame, col: str, lo=None, hi=None) -> DataFrame:
    """Clamp to [lo, hi]; nulls stay null."""
    out = F.col(col)
    if lo is not None:
        out = F.when(out < lo, F.lit(lo)).otherwise(out)
    if hi is not None:
        out = F.when(out > hi, F.lit(hi)).otherwise(out)
    return df.withColumn(col, out.cast(df.schema[col].dataType))


def cap_to(df: DataFrame, col: str, limit, value) -> DataFrame:
    """Values above ``limit`` become ``value``."""
    return df.withColumn(col, F.when(F.col(col) > limit, F.lit(value)).otherwise(F.col(col)).cast(df.schema[col].dataType))


def segment_scale(df: DataFrame, col: str, by: str, factors: dict[str, float]) -> DataFrame:
    """Multiply by the factor of the row's segment; segments without a factor are left alone."""
    factor = F.lit(1.0)
    for level, f in factors.items():
        factor = F.when(F.col(by) == level, F.lit(float(f))).otherwise(factor)
    return df.withColumn(col, F.col(col).cast("double") * factor)


def align_names(df: DataFrame, reference_cols: Sequence[str], rename: dict[str, str] | None = None) -> DataFrame:
    """Rename, lower-case and reorder so that columns line up with ``reference_cols``."""
    renamed = df.withColumnsRenamed(rename or {})
    lowered = renamed.toDF(*[c.lower() for c in renamed.columns])
    return lowered.select(*[c.lower() for c in reference_cols])


def rare_to_other(
    df: DataFrame, col: str, keep: Sequence | None = None, min_count: int | None = None,
    scope: str = "train", other: str = "Other",
    source: DataFrame | None = None,
) -> DataFrame:
    """Keep the listed levels, or the levels seen at least ``min_count`` times in scope."""
    if keep is not None:
        return df.withColumn(col, F.when(F.col(col).isin(list(keep)), F.col(col)).otherwise(F.lit(other)))
    kept = in_scope(df, scope, source).groupBy(col).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_count)
    joined = attach(df, kept, [col])
    return joined.withColumn(col, F.when(F.col("_n").isNotNull(), F.col(col)).otherwise(F.lit(other))).drop("_n")


def map_levels(df: DataFrame, col: str, mapping: dict, default=None, out: str | None = None) -> DataFrame:
    """Look up each level in a small mapping; unmapped levels get ``default``, or stay when it is None."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    fallback = F.col(col) if default is None else F.lit(default)
    return df.withColumn(out or col, F.coalesce(F.try_element_at(pairs, F.col(col)), fallback))


def missing_flags(df: DataFrame, cols: Sequence[str], suffix: str = "_missing") -> DataFrame:
    return replace_cols(df, {c + suffix: F.col(c).isNull().cast("int") for c in cols})


def presence_flags(df: DataFrame, cols: Sequence[str], scope: str = "all", source: DataFrame | None = None) -> DataFrame:
    """Turn columns that hold one value and nulls into 0/1 presence (one profile job over ``cols``)."""
    seen = in_scope(df, scope, source).agg(
        *[F.struct(F.min(c).eqNullSafe(F.max(c)).alias("single"), F.count(c).alias("n")).alias(c) for c in cols]
    ).first()
    flat = [c for c in cols if seen[c]["n"] > 0 and seen[c]["single"]]
    return replace_cols(df, {c: F.col(c).isNotNull().cast("int") for c in flat})


def repair(df: DataFrame, rules: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """Ordered repairs ``(column, condition, new value)``; each sees the result of the previous one."""
    for col, condition, value in rules:
        df = df.withColumn(col, F.when(condition, value).otherwise(F.col(col)).cast(df.schema[col].dataType))
    return df


def zero_if(df: DataFrame, col: str, predicate: Column) -> DataFrame:
    return df.withColumn(col, F.when(predicate, F.lit(0)).otherwise(F.col(col)).cast(df.schema[col].dataType))


INT_RANGES = (("byte", -(2**7), 2**7 - 1), ("short", -(2**15), 2**15 - 1), ("int", -(2**31), 2**31 - 1))


def narrow_types(df: DataFrame) -> DataFrame:
    """Smallest type that holds the observed range: one min/max job, then a cast.

    Doubles become floats only when every value survives the round trip.
    """
    ints = [f.name for f in df.schema if isinstance(f.dataType, T.IntegralType)]
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    if not ints and not doubles:
        return df
    seen = df.agg(
        *[F.min(c).alias(f"lo_{c}") for c in ints],
        *[F.max(c).alias(f"hi_{c}") for c in ints],
        *[F.min((F.col(c).cast("float").cast("double").eqNullSafe(F.col(c))).cast("int")).alias(f"ok_{c}") for c in doubles],
    ).first()
    casts = {}
    for c in ints:
        lo, hi = seen[f"lo_{c}"], seen[f"hi_{c}"]
        fit = next((t for t, a, b in INT_RANGES if lo is not None and a <= lo and hi <= b), None)
        if fit:
            casts[c] = F.col(c).cast(fit)
    casts |= {c: F.col(c).cast("float") for c in doubles if seen[f"ok_{c}"] == 1}
    return replace_cols(df, casts)


def restrict_domain(df: DataFrame, cols: Sequence[str], scope: str = "train", null_level: str | None = "nan", source: DataFrame | None = None) -> DataFrame:
    """Values not seen in scope become null, then nulls become ``null_level`` when it is given."""
    for c in cols:
        domain = in_scope(df, scope, source).where(F.col(c).isNotNull()).select(c).distinct().withColumn("_known", F.lit(1))
        known = F.when(F.col("_known") == 1, F.col(c))
        filled = F.coalesce(known, F.lit(null_level)) if null_level is not None else known
        df = attach(df, domain, [c]).withColumn(c, filled).drop("_known")
    return df


def with_split(df: DataFrame, key: str) -> DataFrame:
    """Tag every fifth key as test."""
    return df.withColumn(SPLIT, F.when(F.col(key) % 5 == 0, F.lit(TEST)).otherwise(F.lit(TRAIN)))
