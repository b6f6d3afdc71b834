"""Chained imputation from moments against a sweep over the rows, and the decomposition against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import impute


def table(n=400, d=4, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + rng.normal(size=(n, d)) * 0.3 + 1000.0 * np.arange(d)
    x[rng.random((n, d)) < 0.2] = np.nan
    return x


def swept(x, rounds, fit):
    """The procedure itself: start at the means, then regress column by column on the current values of the others."""
    holes = np.isnan(x)
    out = np.where(holes, np.nanmean(x[fit], axis=0), x)
    for _ in range(rounds):
        for c in range(x.shape[1]):
            others = [o for o in range(x.shape[1]) if o != c]
            a = np.c_[np.ones(len(x)), out[:, others]]
            rows = ~holes[:, c] & fit
            w = np.linalg.lstsq(a[rows], out[rows, c], rcond=None)[0]
            out[holes[:, c], c] = (a @ w)[holes[:, c]]
    return out


def frame(spark, x, split):
    data = [(i, s, *[None if np.isnan(v) else float(v) for v in r]) for i, (s, r) in enumerate(zip(split, x))]
    return spark.createDataFrame(data, "id int, split string, " + ", ".join(f"c{j} double" for j in range(x.shape[1])))


@pytest.mark.parametrize("scope", ["all", "train"])
@pytest.mark.parametrize("max_moments", [impute.MAX_MOMENTS, 0])
def test_moments_fill_as_sweeps_do(spark, scope, max_moments):
    x = table()
    x[0] = np.nan  # a row without any value
    split = np.where(np.arange(len(x)) % 4 == 0, "test", "train")
    got = impute.impute_iterative(frame(spark, x, split), [f"c{j}" for j in range(4)], 3, scope, max_moments).orderBy("id").toPandas()
    want = swept(x, 3, (split == "train") | (scope == "all"))
    assert list(got.columns) == ["id", "split", "c0", "c1", "c2", "c3"]
    assert np.allclose(got[[f"c{j}" for j in range(4)]].to_numpy(), want, rtol=1e-7)


def test_unknown_empty_and_dependent_columns(spark):
    rows = [(i, None, float(i), None if i % 3 else 2.0 * i, 5.0 if i % 2 else None) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double")
    got = impute.impute_iterative(df, ["a", "b", "c", "d"], 2).orderBy("id").collect()
    assert all(r.a is None and r.b == r.id and r.c == pytest.approx(2.0 * r.id, abs=1e-9) and r.d == pytest.approx(5) for r in got)
    doubled = df.withColumn("e", df.b * 2).drop("a", "d")  # two equal predictors
    assert all(r.c == pytest.approx(2.0 * r.id, abs=1e-6) for r in impute.impute_iterative(doubled, ["b", "c", "e"], 2).collect())
    assert impute.impute_iterative(df.limit(0), ["a", "b"], 2).count() == 0
    whole = impute.impute_iterative(df.select("id", "b"), ["b"], 2).orderBy("id").collect()
    assert [r.b for r in whole] == [float(i) for i in range(30)]


def test_imputation_reads_the_facts_a_fixed_number_of_times(spark, monkeypatch):
    def no_fit(self, *_):
        raise AssertionError("rows were swept")

    monkeypatch.setattr(impute.LinearRegression, "fit", no_fit)
    x = table(200, 6, 1)
    got = impute.impute_iterative(frame(spark, x, ["train"] * 200), [f"c{j}" for j in range(6)], 10).orderBy("id").toPandas()
    assert np.allclose(got[[f"c{j}" for j in range(6)]].to_numpy(), swept(x, 10, np.ones(200, bool)), rtol=1e-6)


@pytest.mark.parametrize("shift", [0.0, 3.0, 1000.0])
def test_decomposition_spans_what_numpy_finds(spark, shift):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6)) * [9, 5, 3, 2, 1, 0.5] + shift * np.array([1, -2, 0.5, 0, 1, 1])
    names = [f"c{j}" for j in range(6)]
    raw = impute.svd(spark.createDataFrame(pd.DataFrame(x, columns=names)), names, 3, standardised=False)
    got = raw.toPandas()
    vt = np.linalg.svd(x, full_matrices=False)[2]
    want = got[names].to_numpy() @ vt[:3].T
    assert np.allclose(np.abs(got[[f"svd_{j}" for j in range(3)]]), np.abs(want), rtol=1e-6, atol=1e-6 * (1 + shift))
    plan = raw._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and "Python" not in plan


def test_decomposition_of_odd_tables(spark):
    df = spark.createDataFrame([(3.0, 4.0)] * 5, "a double, b double")
    got = impute.svd(df, ["a", "b"], 1, standardised=False).collect()
    assert all(r.svd_0 == pytest.approx(5.0) for r in got)
    assert all(r.svd_0 == 0 for r in impute.svd(df, ["a", "b"], 1).collect())
    assert impute.svd(df.limit(0), ["a", "b"], 1).count() == 0


def test_rows_are_made_once(spark):
    df = spark.createDataFrame([(i, "train", "ab"[i % 2], None if i % 5 == 0 else float(i), None if i % 7 == 0 else float(i * i)) for i in range(40)], "id int, split string, g string, a double, b double")
    made = df.withColumns({"g": F.reverse(F.reverse("g")), "a": F.abs("a")})
    for out in (impute.impute_cascade(made, ["a"], [["g", "split"], ["g"]]), impute.impute_iterative(made, ["a", "b"], 2), impute.impute_iterative(made, ["a", "b"], 2, "split")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "reverse(" not in plan and "abs(" not in plan
        assert sorted(r.id for r in out.collect()) == list(range(40)) and out.where("a is null").isEmpty()
