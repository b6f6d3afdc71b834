"""Chunked computations against pandas, with hot groups, ties and nulls, for several chunk counts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import metrics
from tallyloom.operators import windows
from tallyloom.operators.relate import nearest_join
from tallyloom.ordered import row_index, running


@pytest.fixture(scope="module")
def skewed():
    """A third of the rows in one group, a third of the values equal, one group of a single row."""
    rng = np.random.default_rng(3)
    n = 600
    g = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 6, n))
    g[0] = 99
    x = np.where(rng.random(n) < 0.34, 7, rng.integers(-50, 50, n)).astype("int64")
    return pd.DataFrame({"id": np.arange(n), "g": g.astype("int64"), "x": x, "v": rng.integers(0, 9, n).astype("int64")})


@pytest.mark.parametrize("chunks", [1, 3, 150])
def test_running_sum_and_max(spark, skewed, chunks):
    out = running(spark.createDataFrame(skewed), ["g"], ["x", "id"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, chunks=chunks)
    got = out.toPandas().sort_values("id").reset_index(drop=True)
    want = skewed.sort_values(["g", "x", "id"])
    want = want.assign(s=want.groupby("g").v.cumsum(), m=want.groupby("g").v.cummax()).sort_values("id").reset_index(drop=True)
    assert (got.s == want.s).all() and (got.m == want.m).all()


@pytest.mark.parametrize("chunks", [1, 5, 100])
def test_reverse_running_min(spark, skewed, chunks):
    out = running(spark.createDataFrame(skewed), ["g"], ["x", "id"], {"m": ("min", F.col("v"))}, reverse=True, chunks=chunks)
    got = out.toPandas().sort_values("id").reset_index(drop=True)
    want = skewed.sort_values(["g", "x", "id"], ascending=False)
    want = want.assign(m=want.groupby("g").v.cummin()).sort_values("id").reset_index(drop=True)
    assert (got.m == want.m).all()


def test_row_index_with_nulls_first(spark):
    rows = [(i, None if i % 3 == 0 else i * 7 % 50, None if i % 2 else "a") for i in range(120)]
    df = spark.createDataFrame(rows, "id long, x long, g string")
    got = {r["id"]: r["rn"] for r in row_index(df, ["g"], ["x", "id"], chunks=4).collect()}
    for group in (None, "a"):
        mine = sorted([r for r in rows if r[2] == group], key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
        assert [got[r[0]] for r in mine] == list(range(1, len(mine) + 1))


def test_lags_and_rolling_across_blocks(spark, skewed, monkeypatch):
    monkeypatch.setattr(windows, "BLOCK_ROWS", 8)  # many blocks per series
    df = spark.createDataFrame(skewed)
    got = windows.lags(df, ["g"], ["x", "id"], "v", [1, 5]).toPandas().sort_values("id").reset_index(drop=True)
    ordered = skewed.sort_values(["g", "x", "id"])
    for k in (1, 5):
        want = ordered.assign(l=ordered.groupby("g").v.shift(k)).sort_values("id").l.reset_index(drop=True)
        assert got[f"v_lag_{k}"].astype(float).equals(want)
    for cast in ("long", "double"):  # running sums and frames
        rolled = windows.rolling(df.withColumn("v", F.col("v").cast(cast)), ["g"], ["x", "id"], "v", [2], [3, 6], ["mean", "std"]).toPandas()
        rolled = rolled.sort_values("id").reset_index(drop=True)
        assert len(rolled) == len(skewed)
        for w in (3, 6):
            frames = ordered.groupby("g").v.transform(lambda s: s.shift(2).rolling(w).mean())
            stds = ordered.groupby("g").v.transform(lambda s: s.shift(2).rolling(w).std())
            want = ordered.assign(m=frames, sd=stds).sort_values("id").reset_index(drop=True)
            assert np.allclose(rolled[f"v_mean_2_{w}"].astype(float), want.m, equal_nan=True)
            assert np.allclose(rolled[f"v_std_2_{w}"].astype(float), want.sd, equal_nan=True, atol=1e-6)


def test_rolling_needs_a_full_frame_of_values(spark):
    rows = [(1, i, None if i == 4 else i) for i in range(10)]
    got = windows.rolling(spark.createDataFrame(rows, "g int, d int, v int"), ["g"], ["d"], "v", [0], [3], ["mean"], dense=True)
    seen = {r["d"]: r["v_mean_0_3"] for r in got.collect()}
    assert [d for d, v in sorted(seen.items()) if v is None] == [0, 1, 4, 5, 6] and seen[9] == 8.0


def test_nearest_join_ties_take_the_lower_value(spark):
    known = spark.createDataFrame([(1, 10, "a"), (1, 20, "b"), (2, 5, "c")], "g int, x int, p string")
    asked = spark.createDataFrame([(1, 1, 15), (2, 1, 16), (3, 1, 3), (4, 2, 99), (5, 3, 1)], "id int, g int, x int")
    got = {r["id"]: r["p"] for r in nearest_join(asked, known, "x", "p", ["g"], chunks=2).collect()}
    assert got == {1: "a", 2: "b", 3: "a", 4: "c", 5: None}


def test_ecdf_band_uses_each_rows_own_centre(spark):
    rows = [(1, 1, 10), (2, 1, 20), (3, 2, 15), (4, 3, 5), (5, 4, 50)]
    got = {r["id"]: r["x_ecdf_1"] for r in windows.ecdf_band(spark.createDataFrame(rows, "id int, g int, x int"), "g", "x", 1).collect()}
    assert got == {1: 1 / 3, 2: 1.0, 3: 3 / 4, 4: 1 / 3, 5: 1.0}


def test_auc_and_gini(spark, skewed):
    rows = skewed.assign(y=(skewed.v > 5).astype(int), p=skewed.x / 100.0)
    df = spark.createDataFrame(rows)
    pos, neg = rows[rows.y == 1].p.to_numpy(), rows[rows.y == 0].p.to_numpy()
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert metrics.auc(df, "y", "p").first()["auc"] == pytest.approx(want)
    assert metrics.auc(df.withColumn("p", -F.col("p")), "y", "p").first()["auc"] == pytest.approx(1 - want)
    assert metrics.gini(df, "y", "p").first()["gini"] == pytest.approx(2 * want - 1)
    assert metrics.norm_gini(df, "y", "y", ["id"]).first()["norm_gini"] == pytest.approx(1.0)


def test_top_k_with_one_hot_group(spark):
    df = spark.range(500).select((F.col("id") % 3 == 0).cast("int").alias("g"), F.col("id").alias("x"))
    got = windows.top_k(df, ["g"], [F.desc("x")], 3, salts=5).collect()
    assert sorted((r["g"], r["rank"], r["x"]) for r in got) == [(0, 1, 499), (0, 2, 497), (0, 3, 496), (1, 1, 498), (1, 2, 495), (1, 3, 492)]


def test_rank_insert_ties_take_the_first_place(spark):
    board = spark.createDataFrame([(1, 0.9), (1, 0.8), (1, 0.8), (1, 0.1)], "b int, s double")
    mine = spark.createDataFrame([(1, "x", 0.8), (1, "y", 1.0), (1, "z", 0.0)], "b int, who string, v double")
    got = {r["who"]: (r["rank"], r["percentile"]) for r in windows.rank_insert(board, mine, ["b"], "s", "v", "maximize").collect()}
    assert got == {"x": (2, 0.5), "y": (1, 0.25), "z": (5, 1.25)}
