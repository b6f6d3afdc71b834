"""Leaderboard and study analytics (inventory Q) over long result tables.

Scores have one row per (dataset, model, prep, hpo) after folds are averaged, so windows by dataset
here see at most one row per model and regime.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product
from typing import NamedTuple

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.core import attach, cut_lineage, match, with_scalars
from tallyloom.operators.profile import iqr_filter
from tallyloom.operators.windows import rank_insert
from tallyloom.ordered import running
from tallyloom.ranks import quantiles

# Study axes.  Light search is a subset of extensive search.
PREPS = ("none", "fe", "tta")
HPOS = ("default", "light", "extensive")
STAGES = (("none", "default"), ("none", "light"), ("none", "extensive"), ("fe", "extensive"), ("tta", "extensive"))


def lb_percentile(board: DataFrame, scores: DataFrame, keys: Sequence[str], direction: str) -> DataFrame:
    """Rank and percentile of each score on the public and the private board."""
    out = scores
    for side in ("public", "private"):
        out = rank_insert(board, out, keys, side, f"{side}_score", direction).withColumnsRenamed(
            {"rank": f"{side}_rank", "percentile": f"{side}_pct"}
        ).drop("board_size")
    return out


def results_matrix(scores: DataFrame, models: Sequence[str], minimized: Sequence[str] = ()) -> DataFrame:
    """Dataset x model table of mean scores; minimised metrics are flipped to 1 - x."""
    value = F.when(F.col("dataset").isin(list(minimized)), 1 - F.col("value")).otherwise(F.col("value"))
    return scores.withColumn("value", value).groupBy("dataset").pivot("model", list(models)).agg(F.avg("value"))


def _cell(value: str, prep: str, hpo: str, fn=F.max) -> Column:
    return fn(F.when((F.col("prep") == prep) & (F.col("hpo") == hpo), F.col(value)))


def stage_gains(scores: DataFrame) -> DataFrame:
    """Stacked gains default -> light -> extensive -> features -> test-time, never below zero.

    Light search is capped at the extensive result, so over-fitted validation does not count as gain.
    """
    names = ("default", "light", "extensive", "fe", "tta")
    wide = scores.groupBy("dataset", "model").agg(*[_cell("value", p, h).alias(f"_{n}") for n, (p, h) in zip(names, STAGES)])
    wide = wide.withColumn("_light", F.least("_light", "_extensive"))
    bottom, out = F.lit(0.0), {}
    for n in names:
        top = F.greatest(bottom, F.col(f"_{n}"))
        out[f"gain_{n}"] = top - bottom
        bottom = top
    return wide.select("dataset", "model", *[e.alias(n) for n, e in out.items()])


def model_means(scores: DataFrame) -> DataFrame:
    """Mean over all datasets per model and regime; a missing dataset counts as 0."""
    sized = with_scalars(scores, scores, {"n": F.count_distinct("dataset")})
    return sized.groupBy("model", "prep", "hpo").agg((F.sum(F.coalesce("value", F.lit(0.0))) / F.max("_s.n")).alias("mean"))


def spearman(df: DataFrame, a: str, b: str, fill: float | None = None) -> DataFrame:
    """Rank correlation (average ranks for ties) over pairwise complete rows, or with nulls filled first."""
    pairs = df.select(F.col(a).alias("_a"), F.col(b).alias("_b"))
    if fill is not None:
        pairs = pairs.select(F.coalesce("_a", F.lit(fill)).alias("_a"), F.coalesce("_b", F.lit(fill)).alias("_b"))
    pairs = pairs.where("_a is not null and _b is not null")
    for c in ("_a", "_b"):
        hist = pairs.groupBy(c).agg(F.count(F.lit(1)).alias("_c"))
        cum = running(hist, [], [c], {"_hi": ("sum", F.col("_c"))}, sample=pairs)
        pairs = attach(pairs, cum.select(c, (F.col("_hi") - (F.col("_c") - 1) / F.lit(2.0)).alias(f"{c}_rank")), [c])
    return pairs.agg(F.corr("_a_rank", "_b_rank").alias("spearman"))


def best_model(scores: DataFrame, automl: str, group: Sequence[str] | None = None) -> DataFrame:
    """Best single model per dataset and regime, next to the automatic tool's score."""
    single = F.col("model") != automl
    if group is not None:
        single = single & F.col("model").isin(list(group))
    rank = F.when(single, F.struct(-F.col("value"), F.col("model")))
    return scores.groupBy("dataset", "prep", "hpo").agg(
        F.min_by("model", rank).alias("best_model"),
        F.round(F.max(F.when(single, F.col("value"))), 3).alias("best_single"),
        F.round(F.max(F.when(F.col("model") == automl, F.col("value"))), 3).alias("automl"),
    )


def near_best(scores: DataFrame, tol: float | Column = 0.01) -> DataFrame:
    """Cells within ``tol`` of the best score of their dataset and regime."""
    top = F.max("value").over(Window.partitionBy("dataset", "prep", "hpo"))
    return scores.withColumn("is_near_best", (F.col("value") > top - tol).cast("int"))


def gain_combos(scores: DataFrame, base: str) -> DataFrame:
    """All 18 combinations of preparation, search and model selection: one value per dataset.

    Without selection it is the base model's score, with selection the best over all models.
    """
    combos = [
        F.struct(
            F.lit(p).alias("prep"), F.lit(h).alias("hpo"), F.lit(s).alias("selection"),
            F.round(_cell("value", p, h) if s else F.max(F.when((F.col("prep") == p) & (F.col("hpo") == h) & (F.col("model") == base), F.col("value"))), 4).alias("value"),
        )
        for p in PREPS for h in HPOS for s in (0, 1)
    ]
    return scores.groupBy("dataset").agg(F.array(*combos).alias("_c")).select("dataset", F.inline("_c"))


def default_edges() -> list[tuple[str, str]]:
    """All one-step moves between combinations ``prep/hpo/selection``: the next level of one of the three, the others kept."""
    levels = (PREPS, HPOS, ("0", "1"))
    edges = []
    for combo in product(*levels):
        for axis, names in enumerate(levels):
            at = names.index(combo[axis]) + 1
            if at < len(names):
                edges.append(("/".join(combo), "/".join((*combo[:axis], names[at], *combo[axis + 1 :]))))
    return edges


def gain_edges(combos: DataFrame, edges: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Leaderboard positions gained along each move: value(u) - value(v) with value = 100 - mean score in percent."""
    edges = default_edges() if edges is None else edges
    name = F.concat_ws("/", "prep", "hpo", F.col("selection").cast("string"))
    nodes = combos.groupBy(name.alias("node")).agg(
        F.round(100 - F.try_divide(F.sum((F.col("value") * 100).cast("decimal(12,2)")).cast("double"), F.count("value")), 1).alias("value")
    )
    by_source: dict[str, list[Column]] = {}
    for u, v in edges:
        by_source.setdefault(u, []).append(F.lit(v))
    moves = F.create_map(*[x for u, targets in by_source.items() for x in (F.lit(u), F.array(*targets))])
    out = nodes.select(
        F.col("node").alias("src"), F.col("value").alias("_u"), F.explode(F.try_element_at(moves, F.col("node"))).alias("dst")
    )
    return out.join(nodes.select(F.col("node").alias("dst"), F.col("value").alias("_v")), "dst").select(
        "src", "dst", F.round(F.col("_u") - F.col("_v"), 3).alias("gain")
    )


def design_matrix(scores: DataFrame, base: str, adapted: Sequence[str] | None = None) -> DataFrame:
    """Regression rows with 0/1 factors; selection is -1 for the base model, 1 for the best other model.

    Test-time rows can be limited to the ``adapted`` datasets.
    """
    rows = scores if adapted is None else scores.where((F.col("prep") != "tta") | F.col("dataset").isin(list(adapted)))
    best = F.max(F.when(F.col("model") != base, F.col("value"))).over(Window.partitionBy("dataset", "prep", "hpo"))
    return rows.select(
        "dataset", "model", F.col("value").alias("target"),
        *[(F.col("hpo") == h).cast("int").alias(h) for h in HPOS],
        (F.col("prep") != "none").cast("int").alias("feature_engineering"),
        (F.col("prep") == "tta").cast("int").alias("test_time_adaptation"),
        F.when(F.col("model") == base, -1).otherwise((F.col("value") == best).cast("int")).alias("model_selection"),
    )


def fixed_effects(design: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Effect size and p-value per factor with one intercept per dataset (within-dataset demeaning)."""
    means = design.groupBy("dataset").agg(*[F.avg(c).alias(f"_m_{c}") for c in ["target", *factors]])
    centred = design.join(means, "dataset").select(*[(F.col(c) - F.col(f"_m_{c}")).alias(c) for c in ["target", *factors]])
    rows = VectorAssembler(inputCols=list(factors), outputCol="_x").transform(centred)
    model = LinearRegression(featuresCol="_x", labelCol="target", solver="normal", fitIntercept=False).fit(rows)
    found = [(f, float(c), float(p)) for f, c, p in zip(factors, model.coefficients.toArray(), model.summary.pValues)]
    return design.sparkSession.createDataFrame(found, "factor string, effect double, p_value double")


def histogram(df: DataFrame, by: Sequence[str], col: str, bins: int) -> DataFrame:
    """Counts of values in equal bins over [0, 1]; 1 falls into the last bin."""
    bucket = F.least(F.greatest(F.floor(F.col(col) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(col).isNotNull()).groupBy(*by, bucket.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def density(df: DataFrame, by: Sequence[str], col: str, bins: int, cut: float = 3.0, adjust: float = 1.0) -> DataFrame:
    """Gaussian kernel density per group at ``bins`` even points: (by, bin, x, density, step).

    The bandwidth is Scott's, ``n^(-1/5)`` sample deviations, times ``adjust``; the points reach ``cut`` bandwidths beyond the
    smallest and the largest value.  Each value is shared between its two neighbouring points (linear binning), so the facts
    are read twice and what is convolved is at most ``bins`` numbers per group.  Null values are left out; groups of one
    value or without spread have no density and no rows.
    """
    if bins < 2:
        raise ValueError("a density needs at least two points")
    keys = [*by, "_all"]
    values = df.where(F.col(col).isNotNull()).select(*by, F.lit(0).alias("_all"), F.col(col).cast("double").alias("_x"))
    stats = values.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.stddev_samp("_x").alias("_sd")
    ).where("_n > 1 and _lo < _hi")
    width = F.col("_sd") * F.pow(F.col("_n"), F.lit(-0.2)) * adjust
    grid = stats.withColumn("_h", width).select(
        *keys, "_n", "_h", (F.col("_lo") - cut * F.col("_h")).alias("_from"), ((F.col("_hi") - F.col("_lo") + 2 * cut * F.col("_h")) / (bins - 1)).alias("step")
    )
    at = (F.col("_x") - F.col("_from")) / F.col("step")
    # rounding may put the largest value a little beyond the last point
    placed = match(values, grid, keys, "inner").withColumn("_at", F.least(F.greatest(at, F.lit(0.0)), F.lit(float(bins - 1))))
    left = F.least(F.floor("_at").cast("int"), F.lit(bins - 2))
    halves = F.array(
        F.struct(left.alias("_j"), (left + 1 - F.col("_at")).alias("_w")), F.struct((left + 1).alias("_j"), (F.col("_at") - left).alias("_w"))
    )
    held = placed.select(*keys, F.inline(halves)).groupBy(*keys, "_j").agg(F.sum("_w").alias("_w"))
    spread = match(held, grid, keys).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    gap = (F.col("bin") - F.col("_j")) * F.col("step") / F.col("_h")
    out = spread.groupBy(*keys, "_n", "_h", "_from", "step", "bin").agg(F.sum(F.col("_w") * F.exp(-0.5 * gap * gap)).alias("_sum"))
    value = F.col("_sum") / (F.col("_n") * F.col("_h") * F.sqrt(2 * F.pi()))
    return out.select(*by, "bin", (F.col("_from") + F.col("bin") * F.col("step")).alias("x"), value.alias("density"), "step")


class RemlFit(NamedTuple):
    """A random-intercept model at one ratio of the variances (between datasets over within)."""

    ratio: float
    criterion: float  # minus twice the restricted log likelihood, but for a constant
    effects: np.ndarray
    errors: np.ndarray
    var_residual: float


def intercept_moments(design: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Per dataset: rows, sums and sums of products of the intercept, the factors and the target; rows with a null left out."""
    cols = ["_one", *factors, "target"]
    rows = design.dropna(subset=["target", *factors]).select("dataset", F.lit(1.0).alias("_one"), *[F.col(c).cast("double").alias(c) for c in cols[1:]])
    pairs = [(a, b) for a in range(len(cols)) for b in range(a, len(cols))]
    return rows.groupBy("dataset").agg(
        F.array(*[F.sum(F.col(cols[a]) * F.col(cols[b])) for a, b in pairs]).alias("products"), F.array(*[F.sum(c) for c in cols]).alias("sums")
    )


def reml(moments: DataFrame, factors: Sequence[str], ratios: Sequence[float]) -> list[RemlFit]:
    """Restricted likelihood and generalised least squares at some ratios of the variances: one aggregation for all of them.

    With the ratio r, a dataset of n rows adds its products less r / (1 + r n) times the products of its sums, so one row
    per dataset goes in and one row per ratio comes to the driver.
    """
    m = len(factors) + 2
    pairs = [(a, b) for a in range(m) for b in range(a, m)]
    ratio, n = F.col("_ratio"), F.col("sums")[0]
    shrink = ratio / (1 + ratio * n)
    tried = moments.withColumn("_ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
    sums = tried.groupBy("_ratio").agg(
        F.sum(n).alias("n"), F.sum(F.log(1 + ratio * n)).alias("logs"),
        F.array(*[F.sum(F.col("products")[i] - shrink * F.col("sums")[a] * F.col("sums")[b]) for i, (a, b) in enumerate(pairs)]).alias("w"),
    )
    fits = []
    for row in sums.collect():
        full = np.zeros((m, m))
        for (a, b), v in zip(pairs, row.w):
            full[a, b] = full[b, a] = v
        xx, xy, free = full[:-1, :-1], full[:-1, -1], row.n - (m - 1)
        sign, volume = np.linalg.slogdet(xx)
        if free <= 0 or sign <= 0 or np.linalg.cond(xx) > 1e12:
            raise ValueError("too few rows, or factors that depend on one another")
        effects = np.linalg.solve(xx, xy)
        within = max(float(full[-1, -1] - effects @ xy), 1e-300) / free
        criterion = free * math.log(within) + row.logs + volume
        fits.append(RemlFit(row._ratio, criterion, effects, np.sqrt(within * np.diag(np.linalg.inv(xx))), within))
    return sorted(fits, key=lambda fit: fit.ratio)


def random_intercept(design: DataFrame, factors: Sequence[str], rounds: int = 6) -> DataFrame:
    """Mixed model with a random intercept per dataset by restricted likelihood: (factor, effect, std_error, p_value, var_dataset, var_residual).

    The first row is the intercept.  The moments of each dataset are stored once; the ratio of the variances is searched in a
    fixed number of rounds, each an aggregation for 17 ratios between the neighbours of the best one so far.  The p-values
    are those of the normal distribution.
    """
    moments = cut_lineage(intercept_moments(design, factors))
    ratios = [0.0, *np.logspace(-6, 6, 33)]
    for r in range(rounds):
        fits = reml(moments, factors, ratios)
        if not fits:
            raise ValueError("the design has no rows")
        at = min(range(len(fits)), key=lambda i: fits[i].criterion)
        best, low, high = fits[at], fits[max(at - 1, 0)].ratio, fits[min(at + 1, len(fits) - 1)].ratio
        ratios = sorted({best.ratio, *(np.geomspace(low, high, 17) if low > 0 else np.linspace(low, high, 17)).tolist()})
    between = best.ratio * best.var_residual
    rows = [
        (name, float(b), float(e), math.erfc(abs(b / e) / math.sqrt(2)), between, best.var_residual)
        for name, b, e in zip(["intercept", *factors], best.effects, best.errors)
    ]
    return design.sparkSession.createDataFrame(rows, "factor string, effect double, std_error double, p_value double, var_dataset double, var_residual double")


def adtm(scores: DataFrame, board: DataFrame, score: str, col: str) -> DataFrame:
    """Score scaled by the lowest and highest board entry after entries outside the quartile fences are dropped."""
    inside = iqr_filter(board, col)
    out = with_scalars(scores, inside, {"lo": F.min(col).cast("double"), "hi": F.max(col).cast("double")})
    low, high = F.col("_s.lo"), F.col("_s.hi")
    return out.withColumn("adtm", F.try_divide(F.col(score).cast("double") - low, high - low)).drop("_s")


def regime_uplift(scores: DataFrame, group: Sequence[str], hpo: str, before: str, after: str, datasets: Sequence[str] | None = None) -> DataFrame:
    """Mean over datasets of the best model of a group, before and after a change of preparation."""
    rows = scores.where(F.col("model").isin(list(group)))
    if datasets is not None:
        rows = rows.where(F.col("dataset").isin(list(datasets)))
    best = rows.groupBy("dataset").agg(_cell("value", before, hpo).alias("_b"), _cell("value", after, hpo).alias("_a"))
    return best.agg(F.avg("_b").alias("before"), F.avg("_a").alias("after"), (F.avg("_a") - F.avg("_b")).alias("uplift"))


def coalesce_regime(tta: DataFrame, fe: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every feature-engineering row, with the test-time value where there is one."""
    joined = fe.withColumnRenamed("value", "_fe").join(tta.withColumnRenamed("value", "_tta"), list(keys), "left")
    return joined.select(*keys, F.coalesce("_tta", "_fe").alias("value"))


def tail_std(board: DataFrame, col: str, q: float = 0.99) -> DataFrame:
    """Sample std of the board scores above a quantile, one row."""
    cut = quantiles(board, [], col, {"cut": q}).select("cut").scalar()
    top = board.withColumn("_cut", cut).where(F.col(col).cast("double") > F.col("_cut"))
    return top.agg(F.stddev_samp(F.col(col).cast("double")).alias("tail_std"))
