"""Categorical encoders (inventory J), fitted on a scope and applied to both splits.

A level table has one row per level.  It is broadcast only after its size was measured; a hot level
costs nothing extra because counts and sums are combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.core import attach, levels, small_keys, stat, with_scalars
from tallyloom.ordered import row_index
from tallyloom.operators.group import group_encode, level_counts
from tallyloom.spec import SPLIT, TEST, TRAIN, Fitted, in_scope


def fit_label_encode(df: DataFrame, cols: Sequence[str], scope: str = "all", source: DataFrame | None = None) -> Fitted:
    """Codes 0..n-1 by sorted level; the code table may be large, so it is numbered chunk by chunk."""
    source = in_scope(df, scope, source)
    small = small_keys(source, [[c] for c in cols], 1)
    tables = {}
    for c in cols:
        domain = source.where(F.col(c).isNotNull()).select(c).distinct()
        tables[c] = row_index(domain, [], [c], "_code", sample=source).select(c, (F.col("_code") - 1).alias(f"{c}_code"))

    def apply(rows: DataFrame) -> DataFrame:
        for c in cols:
            rows = attach(rows, tables[c], [c], small=small[(c,)])
            rows = rows.withColumn(f"{c}_code", F.coalesce(f"{c}_code", F.lit(-1)))
        return rows

    return Fitted(tables, apply)


def label_encode(df: DataFrame, cols: Sequence[str], scope: str = "all", source: DataFrame | None = None) -> DataFrame:
    """Sorted codes; null and unseen levels are -1."""
    return fit_label_encode(df, cols, scope, source).transform(df)


def align_categories(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The same ordered domain in both splits: codes of the training levels."""
    return label_encode(df, cols, "train")


def ordinal_encode(df: DataFrame, cols: Sequence[str], scope: str = "train", source: DataFrame | None = None) -> DataFrame:
    """Sorted codes; missing and unseen levels share the extra code n."""
    coded = with_scalars(label_encode(df, cols, scope, source), in_scope(df, scope, source), {c: F.count_distinct(c) for c in cols})
    return coded.withColumns(
        {f"{c}_code": F.when(F.col(f"{c}_code") < 0, F.col(f"_s.{c}")).otherwise(F.col(f"{c}_code")) for c in cols}
    ).drop("_s")


def one_hot(df: DataFrame, cols: Sequence[str], scope: str = "train", max_levels: int = 100, source: DataFrame | None = None) -> DataFrame:
    """One 0/1 column per level in scope; unknown and missing levels are all zeros."""
    source = in_scope(df, scope, source)
    new: dict[str, Column] = {}
    for c in cols:
        for v in levels(source, c, max_levels):
            new[f"{c}={v}"] = F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0))
    return df.withColumns(new)


def count_encode(df: DataFrame, cols: Sequence[str], scope: str = "train", source: DataFrame | None = None) -> DataFrame:
    """Rows of the level in scope; unseen levels get 0."""
    return level_counts(df, cols, scope, "_count", source)


def _training(df: DataFrame, source: DataFrame | None) -> DataFrame:
    return in_scope(df, "train", source)


def _target_sums(train: DataFrame, keys: Sequence[str], y: str, prefix: str) -> DataFrame:
    return train.groupBy(*keys).agg(F.sum(y).alias(f"{prefix}_t"), F.count(y).alias(f"{prefix}_n"))


def _with_other_folds(df: DataFrame, train: DataFrame, c: str, y: str, fold: str, small: bool) -> DataFrame:
    """Add target sum ``_t`` and count ``_n`` of the level over the training rows outside the row's own fold.

    ``fold`` is null on test rows, which therefore see all training rows.  Level totals are rolled up
    from the (level, fold) sums, so the rows are aggregated once.
    """
    by_fold = _target_sums(train.where(F.col(c).isNotNull()), [c, fold], y, "_f")
    by_level = by_fold.groupBy(c).agg(F.sum("_f_t").alias("_l_t"), F.sum("_f_n").alias("_l_n"))
    joined = attach(attach(df, by_level, [c], small=small), by_fold, [c, fold], small=small)
    return joined.withColumns(
        {
            "_t": (F.col("_l_t") - F.coalesce("_f_t", F.lit(0))).cast("double"),
            "_n": F.col("_l_n") - F.coalesce("_f_n", F.lit(0)),
        }
    ).drop("_l_t", "_l_n", "_f_t", "_f_n")


def target_mean_oof(df: DataFrame, cols: Sequence[str], y: str, fold: str, source: DataFrame | None = None) -> DataFrame:
    """Out-of-fold target mean for training rows, full training mean for the others.

    Levels without rows in other folds get the training mean.
    """
    train = _training(df, source)
    small = small_keys(train, [[c, fold] for c in cols], 4)
    df = with_scalars(df, train, {"mean": stat(train, y, "mean")}, "_g")
    for c in cols:
        df = _with_other_folds(df, train, c, y, fold, small[(c, fold)])
        df = df.withColumn(f"{c}_target", F.coalesce(F.try_divide("_t", "_n"), F.col("_g.mean"))).drop("_t", "_n")
    return df.drop("_g")


def likelihood(df: DataFrame, cols: Sequence[str], y: str, fold: str, m: float = 30.0, source: DataFrame | None = None) -> DataFrame:
    """Smoothed target rate (sum + m * prior) / (n + m), out of fold for training rows.

    The prior is the mean of the rows the encoding was learned from.
    """
    train = _training(df, source)
    small = small_keys(train, [[fold], *[[c, fold] for c in cols]], 4)
    df = with_scalars(df, train, {"t": F.sum(y), "n": F.count(y)}, "_g")
    df = attach(df, _target_sums(train, [fold], y, "_p"), [fold], small=small[(fold,)])
    prior = F.try_divide((F.col("_g.t") - F.coalesce("_p_t", F.lit(0))).cast("double"), F.col("_g.n") - F.coalesce("_p_n", F.lit(0)))
    df = df.withColumn("_prior", prior)
    for c in cols:
        df = _with_other_folds(df, train, c, y, fold, small[(c, fold)])
        t, n = F.coalesce("_t", F.lit(0.0)), F.coalesce("_n", F.lit(0))
        df = df.withColumn(f"{c}_likelihood", (t + m * F.col("_prior")) / (n + m)).drop("_t", "_n")
    return df.drop("_g", "_prior", "_p_t", "_p_n")


def leave_one_out(df: DataFrame, cols: Sequence[str], y: str, source: DataFrame | None = None) -> DataFrame:
    """(sum - y) / (n - 1) on training rows, the level mean elsewhere, the training mean as a fallback."""
    train = _training(df, source)
    small = small_keys(train, [[c] for c in cols], 2)
    df = with_scalars(df, train, {"mean": stat(train, y, "mean")}, "_g")
    own = (F.col(SPLIT) == TRAIN) & F.col(y).isNotNull()  # a row without a target is in neither sum nor count
    for c in cols:
        df = attach(df, _target_sums(train.where(F.col(c).isNotNull()), [c], y, "_l"), [c], small=small[(c,)])
        rest = F.col("_l_t") - F.when(own, F.col(y)).otherwise(F.lit(0))
        count = F.col("_l_n") - F.when(own, F.lit(1)).otherwise(F.lit(0))
        df = df.withColumn(f"{c}_loo", F.coalesce(F.try_divide(rest.cast("double"), count), F.col("_g.mean"))).drop("_l_t", "_l_n")
    return df.drop("_g")


def mean_std_encode(df: DataFrame, key_sets: Sequence[Sequence[str]], y: str, cutoff: Column, source: DataFrame | None = None) -> DataFrame:
    """Mean and std of the target over many key sets; targets where ``cutoff`` holds are nulled first."""
    hidden = (df if source is None else source).withColumn("_y", F.when(~cutoff, F.col(y)))
    coded = group_encode(df, [("_y", list(ks), ["mean", "std"]) for ks in key_sets], source=hidden)
    names = {f"_y_{'_'.join(ks)}_{a}": f"enc_{'_'.join(ks)}_{a}" for ks in key_sets for a in ("mean", "std")}
    return coded.withColumnsRenamed(names)


def binary_encode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Two-level columns become 1.0 for the smaller level, 0.0 for the other, null stays null."""
    out = with_scalars(df, df, {c: F.min(c) for c in cols})
    return out.withColumns({f"{c}_bin": (F.col(c) == F.col(f"_s.{c}")).cast("double") for c in cols}).drop("_s")


# --- uniqueness of values ---------------------------------------------------------------------


def _long(df: DataFrame, cols: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """One row per (row, column); the values of all columns share one shuffle."""
    typed = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols])
    return typed.unpivot(list(ids), list(cols), "_column", "_value")


def real_keys(df: DataFrame, cols: Sequence[str], key: str) -> DataFrame:
    """Keys of test rows that hold at least one value occurring once among the test rows.

    A value that occurs once has exactly one key, so the keys fall out of the count itself.
    """
    long = _long(df.where(F.col(SPLIT) == TEST), cols, [key])
    once = long.groupBy("_column", "_value").agg(F.count(F.lit(1)).alias("_n"), F.max(key).alias(key))
    return once.where("_n = 1").select(key).distinct()


def real_rows(df: DataFrame, cols: Sequence[str], key: str) -> DataFrame:
    """Flag test rows that hold a value unique within test; null on training rows."""
    marked = df.join(real_keys(df, cols, key).withColumn("_real", F.lit(1)), key, "left")
    return marked.withColumn("is_real", F.when(F.col(SPLIT) == TEST, F.coalesce("_real", F.lit(0)))).drop("_real")


def _value_table(df: DataFrame, cols: Sequence[str], y: str, key: str, scope: str) -> DataFrame:
    """Per (column, value): training rows with y = 1 and y = 0, and rows of the reference set.

    The reference set is train, plus the real test rows when the scope is ``all``.
    """
    train = F.col(SPLIT) == TRAIN
    flagged = df.select(key, SPLIT, y, *cols)
    if scope == "all":
        flagged = real_rows(flagged, cols, key)
    else:
        flagged = flagged.withColumn("is_real", F.lit(0))
    long = _long(flagged, cols, [key, SPLIT, y, "is_real"])
    return long.groupBy("_column", "_value").agg(
        F.count_if(train & (F.col(y) == 1)).alias("_n1"),
        F.count_if(train & (F.col(y) == 0)).alias("_n0"),
        F.count_if(train | (F.coalesce("is_real", F.lit(0)) == 1)).alias("_ref"),
    )


def uniqueness_pattern(df: DataFrame, cols: Sequence[str], y: str, key: str, scope: str = "all") -> DataFrame:
    """Per column a code 0..4 for where the row's value is seen again.

    4: unique in the reference set; otherwise 2 * (seen with y = 1) + (seen with y = 0), not counting
    the row itself.
    """
    long = _long(df, cols, [key, SPLIT, y]).join(_value_table(df, cols, y, key, scope), ["_column", "_value"], "left")
    own = F.when(F.col(SPLIT) == TRAIN, F.col(y))
    one = (F.col("_n1") - F.coalesce((own == 1).cast("int"), F.lit(0)) > 0).cast("int")
    zero = (F.col("_n0") - F.coalesce((own == 0).cast("int"), F.lit(0)) > 0).cast("int")
    code = F.when(F.col("_ref") >= 2, 2 * one + zero).otherwise(F.lit(4))
    coded = long.withColumn("_code", code).groupBy(key).agg(
        *[F.max(F.when(F.col("_column") == c, F.col("_code"))).alias(f"{c}_pattern") for c in cols]
    )
    return df.join(coded, key, "left")


def unique_to_mean(df: DataFrame, cols: Sequence[str], y: str, key: str, scope: str = "all") -> DataFrame:
    """Values unique in the reference set become the training mean of their column."""
    train = df.where(F.col(SPLIT) == TRAIN)
    table = _value_table(df, cols, y, key, scope).where("_ref >= 2").select("_column", "_value", F.lit(1).alias("_again"))
    long = _long(df, cols, [key]).join(table, ["_column", "_value"], "left")
    kept = long.groupBy(key).agg(*[F.max(F.when((F.col("_column") == c) & (F.col("_again") == 1), F.col("_value"))).alias(f"_k_{c}") for c in cols])
    out = with_scalars(df.join(kept, key, "left"), train, {c: stat(train, c, "mean") for c in cols})
    return out.withColumns({f"{c}_shared": F.coalesce(F.col(f"_k_{c}"), F.col(f"_s.{c}")) for c in cols}).drop(
        "_s", *[f"_k_{c}" for c in cols]
    )
