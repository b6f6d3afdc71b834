"""Row-wise features over groups of columns (inventory H): projections of built-in expressions only."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _sum(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def count_where(df: DataFrame, cols: Sequence[str], name: str, test) -> DataFrame:
    return df.withColumn(name, _sum([F.coalesce(test(F.col(c)).cast("int"), F.lit(0)) for c in cols]))


def count_zero(df: DataFrame, cols: Sequence[str], name: str = "n_zero") -> DataFrame:
    return count_where(df, cols, name, lambda c: c == 0)


def count_null(df: DataFrame, cols: Sequence[str], name: str = "n_null") -> DataFrame:
    return count_where(df, cols, name, lambda c: c.isNull())


def count_value(df: DataFrame, cols: Sequence[str], values: Sequence) -> DataFrame:
    """One count per value over the source columns, and their total."""
    counts = {f"n_eq_{v}": _sum([F.coalesce((F.col(c) == v).cast("int"), F.lit(0)) for c in cols]) for v in values}
    return df.withColumns({**counts, "n_eq_any": _sum(list(counts.values()))})


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _present(cols: Sequence[str], drop_zero: bool = False) -> Column:
    values = F.array(*[F.col(c).cast("double") for c in cols])
    return F.filter(values, (lambda x: x.isNotNull() & (x != 0)) if drop_zero else (lambda x: x.isNotNull()))


def _mean(values: Column) -> Column:
    return F.try_divide(_total(values), F.size(values))


def _std(values: Column, centre: Column) -> Column:
    """Sample std around the row's own mean, a column of its own: an expression would be worked out again for every value."""
    spread = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - centre) * (x - centre))
    return F.when(F.size(values) > 1, F.sqrt(F.try_divide(spread, F.size(values) - 1)))


def _median(values: Column) -> Column:
    ordered, n = F.sort_array(values), F.size(values)
    low, high = F.floor((n + 1) / 2).cast("int"), F.ceil((n + 1) / 2).cast("int")
    return F.when(n > 0, (F.try_element_at(ordered, low) + F.try_element_at(ordered, high)) / 2)


def row_stats(df: DataFrame, cols: Sequence[str], prefix: str = "row") -> DataFrame:
    """Mean, sample std, min and max of the non-null values of a row."""
    v = F.col("_v")
    staged = df.withColumn("_v", _present(cols)).withColumn("_mid", _mean(v))
    return staged.withColumns(
        {f"{prefix}_mean": F.col("_mid"), f"{prefix}_std": _std(v, F.col("_mid")), f"{prefix}_min": F.array_min(v), f"{prefix}_max": F.array_max(v)}
    ).drop("_v", "_mid")


def nonzero_stats(df: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Per column group: max, non-zero mean/min/median, sum, std, distinct values and zero count."""
    staged = df.withColumns({f"_all_{g}": _present(cols) for g, cols in groups.items()}).withColumns(
        {f"_nz_{g}": F.filter(f"_all_{g}", lambda x: x != 0) for g in groups} | {f"_mid_{g}": _mean(F.col(f"_all_{g}")) for g in groups}
    )
    new: dict[str, Column] = {}
    for g in groups:
        every, some = F.col(f"_all_{g}"), F.col(f"_nz_{g}")
        new |= {
            f"{g}_high": F.array_max(every), f"{g}_mean": _mean(some), f"{g}_low": F.array_min(some),
            f"{g}_median": _median(some), f"{g}_sum": _total(every), f"{g}_std": _std(every, F.col(f"_mid_{g}")),
            f"{g}_unique": F.size(F.array_distinct(every)),
            f"{g}_zeros": F.lit(len(groups[g])) - F.size(some),
        }
    return staged.withColumns(new).drop(*[f"_{part}_{g}" for part in ("all", "nz", "mid") for g in groups])


def first_last_nonzero(df: DataFrame, cols: Sequence[str], prefix: str = "row") -> DataFrame:
    """log1p of the first and of the last non-zero column."""
    picks = [F.nullif(F.col(c).cast("double"), F.lit(0.0)) for c in cols]
    return df.withColumns(
        {f"{prefix}_first_nz": F.log1p(F.coalesce(*picks)), f"{prefix}_last_nz": F.log1p(F.coalesce(*reversed(picks)))}
    )


def log_mean(df: DataFrame, cols: Sequence[str], name: str = "log_mean") -> DataFrame:
    """expm1 of the mean log1p of the non-zero values."""
    staged = df.withColumn("_v", F.transform(_present(cols, drop_zero=True), lambda x: F.log1p(x)))
    return staged.withColumn(name, F.expm1(_mean(F.col("_v")))).drop("_v")


def any_flag(df: DataFrame, cols: Sequence[str], name: str = "any_flag") -> DataFrame:
    return df.withColumn(name, F.greatest(*[F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in cols], F.lit(0)))


def row_sum(df: DataFrame, cols: Sequence[str], name: str) -> DataFrame:
    return df.withColumn(name, _sum([F.col(c) for c in cols]))


def mod_flags(df: DataFrame, cols: Sequence[str], m: int) -> DataFrame:
    return df.withColumns({f"{c}_mod{m}": (F.pmod(F.col(c), F.lit(m)) == 0).cast("int") for c in cols})


def precision_flag(df: DataFrame, cols: Sequence[str], decimals: int = 2, name: str = "has_ugly") -> DataFrame:
    """1 when any positive value of the row needs more than ``decimals`` decimals."""
    scale = float(10**decimals)
    values = F.array(*[F.col(c).cast("double") for c in cols])
    return df.withColumn(
        name, F.coalesce(F.exists(values, lambda x: (x > 0) & (F.abs(x * scale - F.rint(x * scale)) > 1e-6)).cast("int"), F.lit(0))
    )


def tuple_key(df: DataFrame, cols: Sequence[str], name: str = "tuple_key") -> DataFrame:
    """Hash of an ordered tuple of columns; nulls and separators cannot be confused with values."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in cols]
    return df.withColumn(name, F.md5(F.concat_ws("|", *parts)))


def cell_columns(df: DataFrame, groups: Sequence[Sequence[str]]) -> list[list[Column]]:
    """The cells of groups of columns such that equal cells are those with equal texts, whatever their columns' types.

    Where all have one type whose values are equal just when their texts are, they stay as they are, nulls included; otherwise
    they become texts, and a null is told apart from every value.
    """
    types = {df.schema[c].dataType for g in groups for c in g}
    if len(types) == 1 and all(t == T.StringType() or isinstance(t, (T.IntegralType, T.DecimalType, T.BooleanType, T.DateType)) for t in types):
        return [[F.col(c) for c in g] for g in groups]
    return [[F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in g] for g in groups]


def tuple_longs(cells: Sequence[Column]) -> list[Column]:
    """An ordered tuple of cells as two 64-bit hashes; a null is told apart from every value."""
    parts = [part for c in cells for part in (c.isNull(), c)]
    return [F.xxhash64(F.lit(seed), *parts) for seed in (1, 2)]


def first_nonzero(df: DataFrame, cols: Sequence[str], name: str) -> DataFrame:
    """First non-zero of ordered alternatives, 0 when there is none."""
    return df.withColumn(name, F.coalesce(*[F.nullif(F.col(c), F.lit(0)) for c in cols], F.lit(0)))
