"""Densities and the random intercept against dense arithmetic; positions that are trusted but wrong; sums beyond bigint."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import study, windows


def test_density_against_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [("a", float(v)) for v in rng.normal(5, 2, 400)] + [(None, float(v)) for v in rng.exponential(1, 300)] + [("a", None), ("one", 3.0)] + [("flat", 2.0)] * 5
    df = spark.createDataFrame(rows, "g string, x double")
    got = study.density(df, ["g"], "x", 150).toPandas()
    assert set(got.g.fillna("null")) == {"a", "null"} and len(got) == 300
    for g in ("a", None):
        x = np.array([v for k, v in rows if k == g and v is not None])
        h = x.std(ddof=1) * len(x) ** -0.2
        part = got[got.g.isna() if g is None else got.g == g].sort_values("bin")
        at, step = part.x.to_numpy(), part.step.iloc[0]
        assert np.allclose(at, np.linspace(x.min() - 3 * h, x.max() + 3 * h, 150))
        j = np.floor((x - at[0]) / step).astype(int)
        w = np.bincount(j, (at[0] + (j + 1) * step - x) / step, 150) + np.bincount(j + 1, (x - at[0] - j * step) / step, 150)
        kernel = lambda d: np.exp(-0.5 * (d / h) ** 2) / (len(x) * h * math.sqrt(2 * math.pi))
        assert np.allclose(part.density, kernel(at[:, None] - at[None, :]) @ w, atol=1e-12)
        exact = kernel(at[:, None] - x[None, :]).sum(1)
        assert np.abs(part.density - exact).max() < 0.002 * exact.max()  # what binning costs
        assert abs(part.density.sum() * step - 1) < 0.01
    whole = study.density(df.where("g = 'a'"), [], "x", 20, adjust=0.5)
    assert whole.count() == 20 and study.density(df.where("false"), ["g"], "x", 20).count() == 0
    with pytest.raises(ValueError, match="points"):
        study.density(df, ["g"], "x", 1)


def _dense(y, x, groups, ratio):
    """Minus twice the restricted log likelihood, effects, errors and residual variance from the full matrix."""
    v = np.eye(len(y)) + ratio * (groups[:, None] == groups[None, :])
    vi = np.linalg.inv(v)
    xx = x.T @ vi @ x
    beta = np.linalg.solve(xx, x.T @ vi @ y)
    rest, free = y - x @ beta, len(y) - x.shape[1]
    within = rest @ vi @ rest / free
    loss = free * math.log(within) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(xx)[1]
    return loss, beta, np.sqrt(within * np.diag(np.linalg.inv(xx))), within


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_random_intercept_against_the_full_matrix(spark, spread):
    rng = np.random.default_rng(8)
    groups = np.repeat(np.arange(14), rng.integers(1, 8, 14))
    x = np.column_stack([np.ones(len(groups)), rng.integers(0, 2, len(groups)), rng.normal(size=len(groups))])
    y = x @ [2.0, 0.7, -0.4] + spread * rng.normal(size=14)[groups] + rng.normal(size=len(groups))
    df = spark.createDataFrame([(f"d{g}", float(a), int(b), float(c)) for g, a, (_, b, c) in zip(groups, y, x)] + [("d0", None, 1, 0.0)], "dataset string, target double, p int, q double")
    got = study.random_intercept(df, ["p", "q"]).toPandas()
    ratio = got.var_dataset[0] / got.var_residual[0]
    loss, beta, errors, within = _dense(y, x, groups, ratio)
    assert list(got.factor) == ["intercept", "p", "q"]
    assert np.allclose(got.effect, beta) and np.allclose(got.std_error, errors) and np.allclose(got.var_residual, within)
    tried = [_dense(y, x, groups, r)[0] for r in [0, ratio * 1.01, ratio / 1.01, *np.geomspace(1e-3, 1e3, 13)]]
    assert loss <= min(tried) + 1e-7
    assert ratio > 0.3 or spread == 0
    assert np.allclose(got.p_value, [math.erfc(abs(b / e) / math.sqrt(2)) for b, e in zip(beta, errors)])
    with pytest.raises(ValueError, match="depend"):
        study.random_intercept(df.withColumn("q", F.col("p") * 2), ["p", "q"])
    with pytest.raises(ValueError, match="rows"):
        study.random_intercept(df.where("false"), ["p", "q"])


@pytest.mark.parametrize("at", [[0, 70000, 140000], [0, 1, 1, 3], [0, 1, 1], [0, 0, 2], [0, 1, None]])
def test_positions_with_gaps_or_repeats_raise(spark, at):
    df = spark.createDataFrame([("a", t, i) for i, t in enumerate(at)] + [("b", 0, 5)], "k string, t long, v long")
    with pytest.raises(Exception, match="leave dense out"):
        windows.lags(df, ["k"], ["t"], "v", [1], dense=True).collect()
    with pytest.raises(Exception, match="leave dense out"):
        windows.rolling(df, ["k"], ["t"], "v", [1], [2], ["mean"], dense=True).collect()
    assert windows.lags(df.where("k = 'b'"), ["k"], ["t"], "v", [1], dense=True).count() == 1
    assert windows.lags(df.where("false"), ["k"], ["t"], "v", [1], dense=True).count() == 0


def test_rolling_sums_pass_the_bigint_range(spark):
    df = spark.createDataFrame([(i, 9_000_000_000_000_000_000) for i in range(4)], "t long, v long")
    got = windows.rolling(df, [], ["t"], "v", [1], [2], ["mean"]).orderBy("t").collect()
    assert [r.v_mean_1_2 for r in got] == [None, None, 9e18, 9e18]


def test_gini_per_group_equals_gini_of_each(spark):
    df = spark.range(300).select("id", (F.col("id") % 3).alias("g"), (F.col("id") % 2).alias("y"), (F.col("id") * 7919 % 101).alias("p"))
    per = {r.g: r.gini for r in windows.gini_sum(df, "y", "p", ["id"], ["g"]).collect()}
    for g in range(3):
        assert abs(per[g] - windows.gini_sum(df.where(F.col("g") == g), "y", "p", ["id"]).first().gini) < 1e-12
