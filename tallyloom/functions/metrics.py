"""Metrics (inventory O): each is one aggregated row per ``by`` group, plus a direction."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.core import stat, wide
from tallyloom.ordered import row_index, running
from tallyloom.core import match

DIRECTION = {
    "r2": "maximize", "mse": "minimize", "rmse": "minimize", "mae": "minimize", "rmsle": "minimize",
    "logloss": "minimize", "mlogloss": "minimize", "multilabel": "minimize", "auc": "maximize",
    "gini": "maximize", "norm_gini": "maximize", "cohens_kappa": "maximize", "quadratic_kappa": "maximize",
}
EPS = 1e-15


def scored(df: DataFrame, y: str, pred: str) -> DataFrame:
    """The one rule for nulls: a row without a label or without a prediction counts in no metric."""
    return df.where(F.col(y).isNotNull() & F.col(pred).isNotNull())


def _error(df: DataFrame, y: str, pred: str) -> Column:
    """The difference; of integers as a decimal whose square does not overflow."""
    return wide(df, y) - wide(df, pred)


def _squares(e: Column) -> Column:
    """Sum of squares, exact where the differences are and the sum fits a decimal, else in double precision."""
    square = F.try_multiply(e, e)
    exact = F.when(F.count(square) == F.count(e), F.try_sum(square).cast("double"))
    return F.coalesce(exact, F.sum(e.cast("double") * e.cast("double")))


def r2(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """1 - SSE / SST."""
    df = scored(df, y, pred)
    spread = stat(df, y, "std_pop")
    total = spread * spread * F.count(y)
    return df.groupBy(*by).agg((1 - F.try_divide(_squares(_error(df, y, pred)), total)).alias("r2"))


def mse_rmse_mae(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    df = scored(df, y, pred)
    e = _error(df, y, pred)
    mse = F.try_divide(_squares(e), F.count(e))
    return df.groupBy(*by).agg(
        mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.try_divide(F.sum(F.abs(e)).cast("double"), F.count(e)).alias("mae")
    )


def rmsle(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    e = F.log1p(F.col(pred).cast("double")) - F.log1p(F.col(y).cast("double"))
    return scored(df, y, pred).groupBy(*by).agg(F.sqrt(F.avg(e * e)).alias("rmsle"))


def _clipped(p: str) -> Column:
    return F.greatest(F.least(F.col(p).cast("double"), F.lit(1 - EPS)), F.lit(EPS))


def logloss(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    p = _clipped(pred)
    return scored(df, y, pred).groupBy(*by).agg((-F.avg(F.when(F.col(y) == 1, F.log(p)).otherwise(F.log(1 - p)))).alias("logloss"))


def kappa(df: DataFrame, y: str, pred: str, by: Sequence[str] = (), quadratic: bool = False) -> DataFrame:
    """Cohen's kappa of two ratings: agreement beyond chance, or with squared distances between numeric classes.

    The rows are counted per pair of classes; what chance would give follows from the margins alone, as sums of squares
    for the distances and as products of equal classes otherwise, so no pair of classes is built that does not occur.
    A group in which chance cannot disagree has no kappa (null).
    """
    by = list(by)
    cells = scored(df, y, pred).groupBy(*by, F.col(y).alias("_a"), F.col(pred).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    if quadratic:
        n, a, b = (F.col(c).cast("decimal(19,0)") for c in ("_n", "_a", "_b"))
        sums = cells.groupBy(*by).agg(
            F.sum(n).cast("double").alias("n"), F.sum(n * (a - b) * (a - b)).cast("double").alias("seen"), F.sum(n * a).cast("double").alias("ta"), F.sum(n * b).cast("double").alias("tb"),
            F.sum(n * a * a).cast("double").alias("qa"), F.sum(n * b * b).cast("double").alias("qb"),
        )
        # sum over all pairs of rows of (a - b)^2, over n
        chance = F.col("qa") + F.col("qb") - 2 * F.try_divide(F.col("ta") * F.col("tb"), F.col("n"))
    else:
        margin_a = cells.groupBy(*by, F.col("_a").alias("_c")).agg(F.sum("_n").alias("_na")).withColumn("_nb", F.lit(0).cast("bigint"))
        margin_b = cells.groupBy(*by, F.col("_b").alias("_c")).agg(F.lit(0).cast("bigint").alias("_na"), F.sum("_n").alias("_nb"))
        margins = margin_a.unionByName(margin_b).groupBy(*by, "_c").agg(F.sum("_na").alias("_na"), F.sum("_nb").alias("_nb"))
        both = F.col("_na").cast("decimal(19,0)") * F.col("_nb").cast("decimal(19,0)")
        alike = margins.groupBy(*by).agg(F.sum(both).cast("double").alias("alike"))
        sums = cells.groupBy(*by).agg(F.sum("_n").cast("double").alias("n"), F.sum(F.when(F.col("_a") == F.col("_b"), 0).otherwise(F.col("_n"))).cast("double").alias("seen"))
        sums = match(sums.withColumn("_all", F.lit(0)), alike.withColumn("_all", F.lit(0)), [*by, "_all"])
        chance = F.col("n") - F.try_divide("alike", "n")
    name = "quadratic_kappa" if quadratic else "cohens_kappa"
    return sums.select(*by, (1 - F.try_divide(F.col("seen"), chance)).alias(name))


def mlogloss(df: DataFrame, key: Sequence[str], y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Multiclass log loss from one row per (key, class): ``y`` marks the true class, rows are rescaled to sum 1."""
    rows = df.groupBy(*by, *key).agg(F.sum(p).cast("double").alias("_t"), F.sum(F.when(F.col(y) == 1, F.col(p))).cast("double").alias("_p"))
    share = F.greatest(F.least(F.try_divide("_p", "_t"), F.lit(1 - EPS)), F.lit(EPS))
    return rows.groupBy(*by).agg((-F.avg(F.log(share))).alias("mlogloss"))


def multilabel(df: DataFrame, label: str, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean over labels of the log loss of each label."""
    per = logloss(df, y, p, [*by, label])
    return per.groupBy(*by).agg(F.avg("logloss").alias("multilabel"))


def auc(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve with ties, from the score histogram.

    Sum over scores of neg * (positives above + pos / 2), over P * N; positives above come from a
    chunked running sum, not from one global sort.
    """
    df = scored(df, y, pred)
    hist = df.groupBy(*by, pred).agg(F.count_if(F.col(y) == 1).alias("_p"), F.count_if(F.col(y) == 0).alias("_n"))
    cum = running(hist, list(by), [pred], {"_upto": ("sum", F.col("_p"))}, sample=df)
    # positives above = P - upto, so only per-group sums are left to take
    sums = cum.groupBy(*by).agg(
        F.sum("_p").cast("double").alias("P"), F.sum("_n").cast("double").alias("N"),
        F.sum(F.col("_n").cast("decimal(19,0)") * (2 * F.col("_upto") - F.col("_p")).cast("decimal(19,0)")).cast("double").alias("below"),
    )
    area = F.try_divide(2 * F.col("P") * F.col("N") - F.col("below"), 2 * F.col("P") * F.col("N"))
    return sums.select(*by, area.alias("auc"))


def gini(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    return auc(df, y, pred, by).withColumn("gini", 2 * F.col("auc") - 1).drop("auc")


def norm_gini(df: DataFrame, y: str, pred: str, key: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Gini of the predictions over the gini of the labels themselves; ties are taken in key order.

    Needs each row's position by falling prediction and by falling label, both counted in chunks.
    """
    slim = scored(df, y, pred).select(*by, *key, F.col(y).alias("_y"), (-F.col(pred)).alias("_np"), (-F.col(y)).alias("_ny"))
    by = list(by)
    sums = []
    for order, name in (("_np", "a"), ("_ny", "b")):
        placed = row_index(slim, by, [order, *key], "_pos").withColumn("_all", F.lit(0))
        sums.append(
            placed.groupBy(*by, "_all").agg(
                F.sum(wide(placed, "_y")).cast("double").alias(f"t_{name}"), F.sum(wide(placed, "_y") * wide(placed, "_pos")).cast("double").alias(f"tp_{name}"),
                F.count(F.lit(1)).cast("double").alias(f"n_{name}"),
            )
        )
    both = match(sums[0], sums[1], [*by, "_all"])

    def area(name: str) -> Column:
        n, t, tp = F.col(f"n_{name}"), F.col(f"t_{name}"), F.col(f"tp_{name}")
        return F.try_divide(F.try_divide((n + 1) * t - tp, t) - (n + 1) / 2, n)

    return both.select(*by, F.try_divide(area("a"), area("b")).alias("norm_gini"))


#: Metrics of one prediction per row, by name; those that need more columns are called by themselves.
BY_NAME = {"r2": r2, "mse": mse_rmse_mae, "rmse": mse_rmse_mae, "mae": mse_rmse_mae, "rmsle": rmsle, "logloss": logloss, "auc": auc, "gini": gini, "cohens_kappa": kappa, "quadratic_kappa": partial(kappa, quadratic=True)}


def metric(name: str) -> tuple[Callable[..., DataFrame], str]:
    """The metric called ``name``: a function (rows, y, pred, by) -> (``by``, ``name``), and the direction of better scores."""
    if name not in BY_NAME:
        raise ValueError(f"metric must be one of {sorted(BY_NAME)}, got {name!r}")

    def score(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
        return BY_NAME[name](df, y, pred, by).select(*by, name)

    return score, DIRECTION[name]
