"""Imputation, scaling, projection and clustering (inventory K)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.core import cut_lineage, stat, stored, with_scalars
from tallyloom.operators.group import group_median
from tallyloom.ordered import search
from tallyloom.spec import SPLIT, TEST, TRAIN, in_scope


def impute_mean(df: DataFrame, cols: Sequence[str], scope: str = "train", source: DataFrame | None = None) -> DataFrame:
    source = in_scope(df, scope, source)
    out = with_scalars(df, source, {c: stat(source, c, "mean") for c in cols})
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_s.{c}")) for c in cols}).drop("_s")


def impute_mode(df: DataFrame, cols: Sequence[str], scope: str = "train", source: DataFrame | None = None) -> DataFrame:
    """Most frequent level, the smallest one on ties; levels of all columns are counted in one shuffle."""
    source = in_scope(df, scope, source).select(*[F.col(c).cast("string").alias(c) for c in cols])
    counts = source.unpivot([], list(cols), "_column", "_value").where("_value is not null").groupBy("_column", "_value").agg(
        F.count(F.lit(1)).alias("_n")
    )
    modes = counts.groupBy("_column").agg(F.min_by("_value", F.struct(-F.col("_n"), F.col("_value"))).alias("_mode"))
    out = with_scalars(df, modes, {c: F.max(F.when(F.col("_column") == c, F.col("_mode"))) for c in cols})
    return out.withColumns(
        {c: F.coalesce(F.col(c), F.col(f"_s.{c}").cast(df.schema[c].dataType)) for c in cols}
    ).drop("_s")


def impute_cascade(df: DataFrame, cols: Sequence[str], keys: Sequence[Sequence[str]], source: DataFrame | None = None) -> DataFrame:
    """Fill with the median of the fine group, then of the next coarser group, and so on.

    Medians read their rows several times, so these are written once instead of being made anew each time.
    """
    if source is None:
        df = source = stored(df, "cascade")
    else:
        source = stored(source.select(*dict.fromkeys([*cols, *[k for ks in keys for k in ks]])), "cascade")
    for c in cols:
        for i, ks in enumerate(keys):
            df = group_median(df, ks, c, f"_m{i}", source)
        df = df.withColumn(c, F.coalesce(F.col(c).cast("double"), *[F.col(f"_m{i}") for i in range(len(keys))]))
        df = df.drop(*[f"_m{i}" for i in range(len(keys))])
    return df


MAX_MOMENTS = 1 << 22  # numbers that the driver may hold: patterns of missing columns times (columns + 1) squared


def impute_iterative(df: DataFrame, cols: Sequence[str], rounds: int = 3, scope: str = "all", max_moments: int = MAX_MOMENTS) -> DataFrame:
    """Chained linear regressions: each column is predicted from the others, for a fixed number of rounds.

    The model of a column learns from the rows of the scope where the column is present; scope "split" fits training
    and test rows each by themselves.  A column without a value in scope is left as it is and predicts nothing.

    Within the rows that miss the same columns, every filled value is one linear function of the values present.  So the
    moments of each such pattern, taken in one pass, are all the sweeps need: they run on small matrices, and one more
    pass fills the rows.  If the patterns counted need more than ``max_moments`` numbers, rows are swept instead, with the
    same results: a pass per column, a checkpoint per round.  The rows are written first, since several passes read them.
    """
    return _chained(stored(df, "chained"), cols, rounds, scope, max_moments)


def _chained(df: DataFrame, cols: Sequence[str], rounds: int, scope: str, max_moments: int) -> DataFrame:
    if scope == "split":
        parts = [_chained(df.where(F.col(SPLIT) == part), cols, rounds, "all", max_moments) for part in (TRAIN, TEST)]
        return parts[0].unionByName(parts[1])
    spread = in_scope(df, scope).agg(
        *[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)], *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]
    ).first()
    known = [i for i in range(len(cols)) if spread[f"m{i}"] is not None]
    cols, scaling = [cols[i] for i in known], [(spread[f"m{i}"], spread[f"s{i}"] or 1.0) for i in known]
    if not cols:
        return df
    pattern = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in cols])
    seen = F.lit(True) if scope == "all" else F.col(SPLIT) == TRAIN
    n = df.agg(F.count_distinct(pattern)).first()[0]
    if n * (len(cols) + 1) ** 2 > max_moments:
        return _swept_rows(df, cols, [m for m, _ in scaling], rounds, scope)

    # 1 and the scaled values, 0 where missing; a row per pattern and factor holds the sums of products with all factors
    z = F.array(F.lit(1.0), *[F.coalesce((F.col(c).cast("double") - m) / w, F.lit(0.0)) for c, (m, w) in zip(cols, scaling)])
    size = len(cols) + 1
    factors = df.where(F.coalesce(seen, F.lit(False))).select(pattern.alias("_pattern"), z.alias("_z")).select("_pattern", "_z", F.posexplode("_z").alias("_i", "_v"))
    sums = factors.groupBy("_pattern", "_i").agg(*[F.sum(F.col("_v") * F.col("_z")[j]).alias(f"_{j}") for j in range(size)])
    moments = {r[0]: np.zeros((size, size)) for r in df.select(pattern).distinct().collect()}  # n patterns, as counted
    for r in sums.collect():  # n * (columns + 1) rows
        moments[r[0]][r[1]] = r[2:]
    fills = _swept_moments(list(moments), np.array(list(moments.values())), rounds)

    def fill(c: int, weights: np.ndarray) -> list[float]:
        """Offset and weights of a column in the values themselves instead of the scaled ones."""
        mean, width = scaling[c]
        slopes = [float(w * width / s) for w, (_, s) in zip(weights[1:], scaling)]
        return [float(weights[0] * width + mean) - sum(w * m for w, (m, _) in zip(slopes, scaling)), *slopes]

    rows = [(p, [fill(c, m[c + 1]) if p[c] == "1" else [] for c in range(len(cols))]) for p, m in fills.items() if "1" in p]
    if not rows:
        return df.withColumns({c: F.col(c).cast("double") for c in cols})
    table = df.sparkSession.createDataFrame(rows, "_pattern string, _fill array<array<double>>")  # at most max_moments numbers
    filled = df.withColumn("_pattern", pattern).join(F.broadcast(table), "_pattern", "left")
    value = F.array(F.lit(1.0), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])
    filled = filled.withColumn("_value", value)

    def guess(i: int) -> Column:
        return F.aggregate(F.zip_with(F.col("_fill")[i], F.col("_value"), lambda w, x: w * x), F.lit(0.0), lambda t, x: t + x)

    out = {c: F.when(F.col(c).isNull(), guess(i)).otherwise(F.col(c).cast("double")) for i, c in enumerate(cols)}
    return filled.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in df.columns])


def _swept_moments(patterns: Sequence[str], moments: np.ndarray, rounds: int) -> dict[str, np.ndarray]:
    """Per pattern the matrix that takes (1, scaled values, 0 where missing) to (1, scaled values, all filled).

    Regressions are solved by least squares on the moments of the filled rows; columns that depend on each other share
    their weight (the shortest solution).
    """
    size = moments.shape[1]
    holes = np.array([[ch == "1" for ch in p] for p in patterns]).reshape(len(patterns), size - 1)
    maps = np.tile(np.eye(size), (len(patterns), 1, 1))
    maps[:, 1:, :] *= ~holes[:, :, None]  # missing ones start at the mean, 0
    for _ in range(rounds):
        for c in range(1, size):
            there = ~holes[:, c - 1]
            if there.all():
                continue
            total = np.einsum("pij,pjk,plk->il", maps[there], moments[there], maps[there], optimize=True)
            others = [0, *[o for o in range(1, size) if o != c]]
            weights = np.linalg.lstsq(total[np.ix_(others, others)], total[others, c], rcond=1e-12)[0]
            maps[~there, c, :] = np.einsum("o,poj->pj", weights, maps[~there][:, others, :])
    return dict(zip(patterns, maps))


def _swept_rows(df: DataFrame, cols: Sequence[str], means: Sequence[float], rounds: int, scope: str) -> DataFrame:
    """The same regressions over the rows, for more patterns than the driver may hold."""
    holes = {c: F.col(f"_was_null_{c}") for c in cols}
    work = df.withColumns({f"_was_null_{c}": F.col(c).isNull() for c in cols})
    work = work.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(m))) for c, m in zip(cols, means)})
    for _ in range(rounds):
        for c in cols:
            others = [o for o in cols if o != c]
            packed = VectorAssembler(inputCols=others, outputCol="_x")
            seen = packed.transform(in_scope(work, scope).where(~holes[c]).select(*cols))
            model = LinearRegression(featuresCol="_x", labelCol=c, solver="normal").fit(seen)
            guess = F.lit(float(model.intercept))
            for o, w in zip(others, model.coefficients.toArray()):
                guess = guess + F.lit(float(w)) * F.col(o)
            work = work.withColumn(c, F.when(holes[c], guess).otherwise(F.col(c)))
        work = cut_lineage(work)
    return work.drop(*[f"_was_null_{c}" for c in cols])


def standardize(df: DataFrame, cols: Sequence[str], scope: str = "train", suffix: str = "_std", source: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population std; a constant column becomes 0."""
    source = in_scope(df, scope, source)
    exprs = {f"m_{c}": stat(source, c, "mean") for c in cols} | {f"s_{c}": stat(source, c, "std_pop") for c in cols}
    out = with_scalars(df, source, exprs)

    def scaled(c: str) -> Column:
        spread = F.when(F.col(f"_s.s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_s.s_{c}"))
        return (F.col(c).cast("double") - F.col(f"_s.m_{c}")) / spread

    return out.withColumns({c + suffix: scaled(c) for c in cols}).drop("_s")


def unstandardize(df: DataFrame, col: str, train: DataFrame, target: str, out: str) -> DataFrame:
    """Undo the scaling of ``target`` for predictions in ``col``."""
    scaled = with_scalars(df, train, {"m": stat(train, target, "mean"), "s": stat(train, target, "std_pop")})
    spread = F.when(F.col("_s.s") == 0, F.lit(1.0)).otherwise(F.col("_s.s"))
    return scaled.withColumn(out, F.col(col) * spread + F.col("_s.m")).drop("_s")


AFTER = {"log1p": F.log1p, "sqrt": F.sqrt}


def minmax(df: DataFrame, cols: Sequence[str], scope: str = "train", then: str | None = None, suffix: str = "_mm", source: DataFrame | None = None) -> DataFrame:
    """(x - min) / (max - min), clamped at 0 before an optional log1p or sqrt; constant columns give null."""
    source = in_scope(df, scope, source)
    out = with_scalars(df, source, {f"{e}_{c}": getattr(F, e)(c).cast("double") for c in cols for e in ("min", "max")})

    def scaled(c: str) -> Column:
        low, high = F.col(f"_s.min_{c}"), F.col(f"_s.max_{c}")
        x = F.try_divide(F.col(c).cast("double") - low, high - low)
        return x if then is None else AFTER[then](F.when(x < 0, F.lit(0.0)).otherwise(x))

    return out.withColumns({c + suffix: scaled(c) for c in cols}).drop("_s")


def positive_max_scale(df: DataFrame, cols: Sequence[str], scope: str = "train", overflow: float = 9999999999.0, source: DataFrame | None = None) -> DataFrame:
    """Divide by the largest value in scope, treating negatives by how many levels they have.

    ``overflow`` stands for max + 1 of the other values.  No negative level: only positive values are divided,
    others stay.  Exactly one: it becomes -1.  Several negative levels: all values are divided.
    """
    source = in_scope(df, scope, source)
    exprs = {}
    for c in cols:
        v = F.col(c).cast("double")
        exprs |= {
            f"top_{c}": F.max(F.when(v < overflow, v)), f"over_{c}": F.max(v) >= overflow,
            f"lo_{c}": F.min(F.when(v < 0, v)), f"hi_{c}": F.max(F.when(v < 0, v)),
        }
    out = with_scalars(df, source, exprs)

    def scaled(c: str) -> Column:
        top = F.when(F.col(f"_s.over_{c}"), F.col(f"_s.top_{c}") + 1).otherwise(F.col(f"_s.top_{c}"))
        v = F.when(F.col(c) >= overflow, top).otherwise(F.col(c).cast("double"))
        several = F.coalesce(F.col(f"_s.lo_{c}") < F.col(f"_s.hi_{c}"), F.lit(False))
        share = F.when(top > 0, v / top).otherwise(v)
        return F.when(several, share).when(v > 0, share).when((v < 0) & F.col(f"_s.lo_{c}").isNotNull(), F.lit(-1.0)).otherwise(v)

    return out.withColumns({f"{c}_pms": scaled(c) for c in cols}).drop("_s")


# Coefficients of the published rational approximation of the inverse normal CDF
# (relative error below 1.15e-9); a/b for the centre, c/d for the tails.
NORM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
NORM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
NORM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
NORM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
NORM_TAIL = 0.02425


def _poly(x: Column, coefficients: Sequence[float], last: float | None = None) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out if last is None else out * x + F.lit(last)


def inverse_normal(p: Column) -> Column:
    """Normal score of a probability strictly between 0 and 1."""
    q = p - 0.5
    centre = _poly(q * q, NORM_A) * q / _poly(q * q, NORM_B, 1.0)
    low = F.sqrt(-2 * F.log(p))
    high = F.sqrt(-2 * F.log(1 - p))
    return (
        F.when(p < NORM_TAIL, _poly(low, NORM_C) / _poly(low, NORM_D, 1.0))
        .when(p > 1 - NORM_TAIL, -_poly(high, NORM_C) / _poly(high, NORM_D, 1.0))
        .otherwise(centre)
    )


def quantile_normal(df: DataFrame, cols: Sequence[str], n: int = 1000, scope: str = "train", suffix: str = "_qn", source: DataFrame | None = None) -> DataFrame:
    """Map each column to normal scores through a grid of at most ``n`` quantiles of the scope.

    The grid (``n`` numbers per column) comes from mergeable sketches in one job; rows are placed by a
    two-step search and interpolated.  Repeated grid values take the middle of their range.
    """
    probs = [i / (n - 1) for i in range(n)]
    source = in_scope(df, scope, source)
    grids = source.agg(*[F.percentile_approx(F.col(c).cast("double"), probs, 100 * n).alias(c) for c in cols]).first()
    out = df
    for c in cols:
        if grids[c] is None:  # no value in scope
            out = out.withColumn(c + suffix, F.lit(None).cast("double"))
        else:
            out = _normal_scores(out, c, [float(g) for g in grids[c]], c + suffix)
    return out


SCORE_EDGE = 1e-7  # probabilities are kept this far from 0 and 1


def _normal_scores(df: DataFrame, col: str, grid: list[float], out: str) -> DataFrame:
    """Place values on a quantile grid, interpolate the probability and turn it into a normal score."""
    n, x = len(grid), F.col(col).cast("double")
    points, values = [F.lit(g) for g in grid], F.array(*[F.lit(g) for g in grid])
    # Grid values <= x and < x; staged as columns so that the search is evaluated once per row.
    placed = df.withColumns({"_right": F.when(x.isNotNull(), search(x, points)), "_left": F.when(x.isNotNull(), search(x, points, strict=True))})
    low = F.try_element_at(values, F.greatest(F.col("_right"), F.lit(1)))
    high = F.try_element_at(values, F.least(F.col("_right") + 1, F.lit(n)))
    between = (F.col("_right") - 1) + F.coalesce(F.try_divide(x - low, high - low), F.lit(0.0))
    middle = (F.col("_left") + F.col("_right") - 1) / 2.0
    share = F.when(x <= grid[0], 0.0).when(x >= grid[-1], 1.0).otherwise(
        F.when(F.col("_left") < F.col("_right"), middle).otherwise(between) / float(n - 1)
    )
    staged = placed.withColumn("_p", F.greatest(F.least(share, F.lit(1 - SCORE_EDGE)), F.lit(SCORE_EDGE)))
    return staged.withColumn(out, F.when(x.isNotNull(), inverse_normal(F.col("_p")))).drop("_right", "_left", "_p")


TARGET_PAIRS = {
    "log1p": (F.log1p, F.expm1),
    "sqrt": (F.sqrt, lambda c: c * c),
    "identity": (lambda c: c, lambda c: c),
}


def transform_target(df: DataFrame, col: str, fn: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, TARGET_PAIRS[fn][0](F.col(col).cast("double")))


def inverse_target(df: DataFrame, col: str, fn: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, TARGET_PAIRS[fn][1](F.col(col)))


def unit_norm(df: DataFrame, cols: Sequence[str], suffix: str = "_unit") -> DataFrame:
    """Divide each column by its Euclidean length; an all-zero column stays 0."""
    out = with_scalars(df, df, {c: F.sqrt(F.sum(F.col(c) * F.col(c)).cast("double")) for c in cols})
    return out.withColumns(
        {c + suffix: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col(f"_s.{c}")), F.col(c).cast("double")) for c in cols}
    ).drop("_s")


def shift_nonnegative(df: DataFrame, cols: Sequence[str], scope: str = "all", source: DataFrame | None = None) -> DataFrame:
    """Subtract the smallest value in scope; nulls stay."""
    out = with_scalars(df, in_scope(df, scope, source), {c: F.min(c) for c in cols})
    return out.withColumns({c: F.col(c) - F.col(f"_s.{c}") for c in cols}).drop("_s")


# --- projections and clusters -------------------------------------------------------------------


def _project(fit_on: DataFrame, df: DataFrame, cols: Sequence[str], k: int, names: Sequence[str], centre: Sequence[float]) -> DataFrame:
    """Coordinates of ``df`` on the principal directions of ``fit_on``.

    Each direction is signed so that its largest entry is positive; only k * len(cols) fitted numbers
    are held by the driver.
    """
    packer = VectorAssembler(inputCols=list(cols), outputCol="_x")
    model = PCA(k=k, inputCol="_x", outputCol="_p").fit(packer.transform(fit_on).select("_x"))
    matrix = model.pc.toArray()
    signs = [1.0 if matrix[abs(matrix[:, j]).argmax(), j] > 0 else -1.0 for j in range(k)]
    shift = [float(sum(m * w for m, w in zip(centre, matrix[:, j]))) for j in range(k)]
    scored = model.transform(packer.transform(df)).withColumn("_p", vector_to_array("_p"))
    return scored.withColumns(
        {n: (F.col("_p")[j] - F.lit(shift[j])) * F.lit(signs[j]) for j, n in enumerate(names)}
    ).drop("_x", "_p")


def pca(df: DataFrame, cols: Sequence[str], k: int = 2, scope: str = "train", prefix: str = "pca", source: DataFrame | None = None) -> DataFrame:
    """First ``k`` principal components of the centred columns."""
    source = in_scope(df, scope, source) if SPLIT in df.columns else df
    means = source.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols]).first()
    return _project(source, df, cols, k, [f"{prefix}_{j}" for j in range(k)], [means[c] for c in cols])


def svd(df: DataFrame, cols: Sequence[str], k: int = 30, prefix: str = "svd", standardised: bool = True) -> DataFrame:
    """First ``k`` coordinates of the uncentred decomposition, standardised unless told otherwise.

    The products of all columns are those of the centred columns plus the rank one part of the means, so the centred fit
    of the rows, as they stand, gives the right singular vectors of the uncentred ones: a (columns x columns) matrix
    summed over the partitions in a tree, the only thing that reaches the driver.  Each direction is signed so that its
    largest entry is positive; an empty table gives no rows.
    """
    names = [f"{prefix}_{j}" for j in range(k)]
    plain = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)])
    stats = plain.agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in plain.columns]).alias("mean"), F.array(*[F.var_pop(c) for c in plain.columns]).alias("var")
    ).first()
    if not stats["n"]:
        return df.withColumns({n: F.lit(None).cast("double") for n in names})
    mean, spread = np.array(stats["mean"]), float(sum(stats["var"]))
    products = np.outer(mean, mean)
    if spread > 0 and stats["n"] > 1:
        packed = VectorAssembler(inputCols=plain.columns, outputCol="_x").transform(plain).select("_x")
        model = PCA(k=len(cols), inputCol="_x", outputCol="_p").fit(packed)
        turn = model.pc.toArray()
        products = products + (turn * (model.explainedVariance.toArray() * spread)) @ turn.T
    directions = np.linalg.eigh(products)[1][:, ::-1][:, :k]
    largest = np.abs(directions).argmax(axis=0)
    directions = directions * np.where(directions[largest, np.arange(k)] > 0, 1.0, -1.0)
    row = F.array(*[F.col(c).cast("double") for c in cols])

    def along(weights: np.ndarray) -> Column:
        axis = F.array(*[F.lit(float(w)) for w in weights])
        return F.aggregate(F.zip_with(F.col("_row"), axis, lambda x, w: x * w), F.lit(0.0), lambda t, x: t + x)

    out = df.withColumn("_row", row).withColumns({n: along(directions[:, j]) for j, n in enumerate(names)}).drop("_row")
    return _standardised(out, names) if standardised else out


def _standardised(df: DataFrame, names: Sequence[str]) -> DataFrame:
    out = with_scalars(df, df, {f"m_{n}": F.avg(n) for n in names} | {f"s_{n}": F.stddev_pop(n) for n in names})
    return out.withColumns(
        {n: F.coalesce(F.try_divide(F.col(n) - F.col(f"_s.m_{n}"), F.col(f"_s.s_{n}")), F.lit(0.0)) for n in names}
    ).drop("_s")


def kmeans_ids(df: DataFrame, cols: Sequence[str], ks: Sequence[int], seed: int = 7, scope: str = "train", max_iter: int = 20, source: DataFrame | None = None) -> DataFrame:
    """Cluster number for every ``k``; centres are learned on the scope and applied to all rows."""
    packer = VectorAssembler(inputCols=list(cols), outputCol="_x")
    source = packer.transform(in_scope(df, scope, source) if SPLIT in df.columns else df).select("_x").persist()
    out = packer.transform(df)
    try:
        for k in ks:
            model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_x", predictionCol=f"kmeans_{k}").fit(source)
            out = model.transform(out)
    finally:
        source.unpersist()
    return out.drop("_x")


def expand_vector(df: DataFrame, col: str, n: int, prefix: str) -> DataFrame:
    """An array column as ``n`` double columns."""
    return df.select(*[c for c in df.columns if c != col], *[F.col(col)[i].cast("double").alias(f"{prefix}{i}") for i in range(n)])
