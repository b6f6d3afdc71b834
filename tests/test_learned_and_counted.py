"""Boosting, counts of many key sets, chains and metrics against brute force on odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.functions import metrics
from tallyloom.operators import boosting, chains, group, learn, profile
from tallyloom.plans import jobs

SF = "/root/testdata/sf0.001"


# --- boosting for several classes -------------------------------------------------------------


def _points(spark, n=600, seed=1, shuffled=False):
    rng = np.random.default_rng(seed)
    x = rng.random((n, 3))
    y = (x[:, 0] > 0.5).astype(int) + (x[:, 0] > 0.5) * (x[:, 1] > 0.4) + 3 * ((x[:, 0] <= 0.5) & (x[:, 2] > 0.7))
    y = rng.permutation(y) if shuffled else y
    rows = [(i, Vectors.dense(p), int(k), bool(i % 3 == 0)) for i, (p, k) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ["id", "x", "y", "held"])


def _loss(model, rows):
    out = model.transform(rows).select("y", "probability", "prediction").collect()
    for r in out:
        assert abs(sum(r.probability) - 1) < 1e-9 and r.prediction == int(np.argmax(r.probability))
    return -float(np.mean([math.log(max(r.probability[r.y], 1e-15)) for r in out]))


def test_boosting_learns_what_a_shuffled_label_does_not(spark):
    def fitted(rows):
        booster = boosting.SoftmaxBooster(maxIter=6, maxDepth=3, stepSize=0.4).setFeaturesCol("x").setLabelCol("y")
        model = booster.fit(rows, {booster.validationIndicatorCol: "held"})
        return model, _loss(model, rows.where("held"))

    known, noise = _points(spark), _points(spark, shuffled=True)
    model, loss = fitted(known)
    assert loss < 0.35 and abs(loss - min(model.losses)) < 1e-9
    shares = known.where("held").groupBy("y").count().toPandas()["count"]
    chance = -float((shares / shares.sum() * np.log(shares / shares.sum())).sum())
    worse, loss = fitted(noise)
    assert loss > 0.9 * chance
    assert worse.rounds == 1 + worse.losses.index(min(worse.losses))  # the best round on the watched rows is the last one kept


def test_boosting_of_one_class_and_absent_classes(spark):
    rows = _points(spark, 60)
    booster = boosting.SoftmaxBooster(maxIter=2, maxDepth=2).setFeaturesCol("x").setLabelCol("y")
    assert _loss(booster.fit(rows.withColumn("y", F.lit(0))), rows.withColumn("y", F.lit(0))) == 0
    gap = rows.withColumn("y", F.when(F.col("y") > 0, 2).otherwise(0))
    model = booster.fit(gap)
    assert len(model.shares) == 3 and _loss(model, gap) < 0.6
    with pytest.raises(ValueError, match="labels"):
        booster.fit(rows.withColumn("y", F.lit(-1)))


def test_first_round_is_a_newton_step(spark):
    rows = spark.createDataFrame([(Vectors.dense([float(i % 2)]), int(i % 2 or i % 10 == 0)) for i in range(40)], ["x", "y"])
    model = boosting.SoftmaxBooster(maxIter=1, maxDepth=1, stepSize=1.0).setFeaturesCol("x").setLabelCol("y").fit(rows)
    p = 24 / 40
    left = [int(i % 10 == 0) for i in range(0, 40, 2)]
    steps = [np.clip((y - p) / (p * (1 - p)), -4, 4) for y in left]
    margins = [math.log(1 - p) - 0.5 * np.mean(steps), math.log(p) + 0.5 * np.mean(steps)]
    want = math.exp(margins[1]) / sum(map(math.exp, margins))
    got = model.transform(rows.where("x is not null")).where(F.col("y") == 0).select("probability").first()[0][1]
    assert abs(got - want) < 1e-9


def test_flags_of_fitted_models_fail_for_shuffled_labels(spark):
    from tallyloom.catalog import models_and_studies as m

    rows = m._ml_rows(spark, SF, 2)
    mixed = rows.select("o_orderkey", F.row_number().over(Window.orderBy(F.md5(F.col("o_orderkey").cast("string")))).alias("n"))
    other = rows.select("target", F.row_number().over(Window.orderBy("o_orderkey")).alias("n"))
    rows = rows.drop("target").join(mixed, "o_orderkey").join(other, "n").drop("n").withColumn("dear", m._dear()).persist()
    models = learn.fit_folds(rows, m.FEATURES, "dear", "binary", m.SMALL, k=2)
    preds = learn.predict(models, rows.where("split = 'train'"), m.FEATURES, ["o_orderkey"], "binary").join(rows.select("o_orderkey", "dear"), "o_orderkey")
    assert all(r.auc < 0.8 for r in metrics.auc(preds, "dear", "pred", ["fold"]).collect())
    out = learn.oof_features(rows, ["price_level"], [*m.FEATURES, "target"], ["o_orderkey"], 2, params=m.LEARNED)
    assert metrics.r2(out, "price_level", "price_level_oof").first().r2 < 0.5
    trials, preds = learn.random_search(rows, m.FEATURES, "target", "regression", ["o_orderkey"], "rmse", 1, 11, 2, m.SMALL_SPACE)
    spread = rows.where("split = 'train'").groupBy("fold").agg(F.stddev_pop("target").alias("spread"))
    assert trials.join(spread, "fold").where("score < 0.97 * spread").count() == 0


# --- counts of many key sets -------------------------------------------------------------------


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 1, 2, 3]), rng.choice(["x", "y", None]), rng.choice(["p", "p", "q"]), "one", None, "test" if i % 4 == 0 else "train") for i in range(300)]
    return spark.createDataFrame(rows, "id long, a int, b string, c string, d string, e string, split string")


@pytest.mark.parametrize("scope", ["all", "train"])
def test_access_counts(odd, scope):
    cats = ["a", "b", "c", "d", "e"]
    out = group.log_count(odd, cats, scope)
    out = group.usage_share(out, ["a", "c", "d", "e"], "b", scope, odd)
    for c in ("a", "c", "d", "e"):
        out = group.group_nunique(out, [c], ["b"], scope, odd)
    out = group.crosstab_encode(out, cats, scope, odd)
    new = [c for c in out.columns if c.endswith(("_count", "_share", "_nunique", "_n", "_log"))]
    want = profile.drop_constant(out, scope, new)
    got = jobs.access_counts(odd, cats, "b", scope)
    assert sorted(got.columns) == sorted(want.columns) and len(got.columns) < len(out.columns)
    assert sorted(got.select(sorted(got.columns)).collect(), key=repr) == sorted(want.select(sorted(got.columns)).collect(), key=repr)


def test_counts_by_hand(odd):
    rows = [r.asDict() for r in odd.collect()]
    counts = group.count_keys(odd, [["a", "b"], ["c", "b"], ["a"], ["a", "b", "c"], []])
    for keys in (["a"], ["b"], ["a", "b"], ["c", "a"], ["a", "b", "c"]):
        want = {}
        for r in rows:
            k = tuple(r[c] for c in keys)
            want[k] = want.get(k, 0) + 1
        assert {tuple(r)[:-1]: r["_n"] for r in counts.of(keys).select(*keys, "_n").collect()} == want
    assert len(counts.sets) == 1


def test_access_counts_read_the_facts_twice(spark):
    from tallyloom.catalog import QUERIES

    sc = spark.sparkContext
    sc.setJobGroup("access", "access")
    out = QUERIES["job_access_counts"](spark, SF)
    built = len(sc.statusTracker().getJobIdsForGroup("access"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # once for the counts, once for the result; what is built is the counts, their sizes and two looks for constants
    assert sum("Relation [l_orderkey#" in line for line in plan.splitlines()) == 1
    assert built <= 12  # with adaptive execution a stage is a job


# --- chains ------------------------------------------------------------------------------------


def naive_chains(edges):
    nxt = dict(edges)
    nodes = {x for e in edges for x in e}
    ring = {}
    for v in nodes:
        seen, at = [], v
        while at in nxt and at not in seen:
            seen.append(at)
            at = nxt[at]
        if at in seen:
            loop = seen[seen.index(at) :]
            ring.update({u: min(loop) for u in loop})
    cut = {a: b for a, b in edges if b not in ring or (a in ring and b != ring[b])}
    best = {}
    for start in nodes - set(cut.values()):
        at, n = start, 0
        while True:
            if at not in best or (-n, start) < best[at]:
                best[at] = (-n, start)
            if at not in cut:
                break
            at, n = cut[at], n + 1
    ended = {best[a][1] for a, b in edges if best[a][1] != best[b][1]}
    return sorted((best[v][1], v, -best[v][0], v in ring, best[v][1] in ended) for v in nodes)


@pytest.mark.parametrize(
    "edges",
    [
        [(1, 2), (2, 3), (10, 11), (11, 12), (12, 10)],
        [(5, 5)],
        [(1, 2), (2, 3), (3, 4), (9, 3), (8, 9), (7, 8), (20, 21), (21, 20), (22, 20), (30, 31)],
        [(a, b) for a, b in zip(range(100, 140), range(101, 141))] + [(141, 120), (142, 141)],
        [(i, (i * i + 1) % 97) for i in range(97)],
        [(i, 0) for i in range(1, 30)],
    ],
)
def test_chains_with_cycles_and_overlaps(spark, edges):
    got = chains.chain_paths(spark.createDataFrame(edges, "src long, dst long"))
    assert sorted(tuple(r) for r in got.collect()) == naive_chains(edges)


def test_chains_stop_when_the_cycles_are_known(spark, monkeypatch):
    written = []
    monkeypatch.setattr(chains, "stored", lambda df, label, write=chains.stored: written.append(label) or write(df, label), raising=False)
    pairs = [(i, i ^ 1) for i in range(3000)]
    got = chains.chain_paths(spark.createDataFrame(pairs + [(3000, 0), (3001, 3000)], "src long, dst long")).cache()
    assert 0 < written.count("jumps") <= 3  # not once for every doubling up to the number of nodes
    assert got.where("cycle").count() == 3000
    assert sorted(tuple(r) for r in got.where("not cycle").collect()) == [(3001, 3000, 1, False, True), (3001, 3001, 0, False, True)]
    # the plan that is left does not carry the rounds before
    assert len(got._jdf.queryExecution().analyzed().toString()) < 20_000


def test_chains_of_names_and_of_nothing(spark):
    got = chains.chain_paths(spark.createDataFrame([("b", "c"), ("c", "b"), ("a", "b"), (None, "a"), ("a", "b")], "src string, dst string"))
    assert sorted(tuple(r) for r in got.collect()) == [("a", "a", 0, False, True), ("b", "b", 0, True, False), ("b", "c", 1, True, False)]
    assert chains.chain_paths(spark.createDataFrame([], "src long, dst long")).count() == 0
    with pytest.raises(ValueError, match="rounds"):
        chains.chain_paths(spark.createDataFrame([(i, i + 1) for i in range(9)], "src long, dst long"), max_rounds=2)


# --- metrics -----------------------------------------------------------------------------------


def test_rows_without_a_label_or_a_prediction_do_not_count(spark):
    whole = [(1, 0.9), (0, 0.2), (1, 0.4), (0, 0.4)]
    rows = spark.createDataFrame([*whole, (None, 0.9), (1, None), (None, None)], "y int, p double")
    clean = spark.createDataFrame(whole, "y int, p double")
    for name in ("r2", "mse", "rmse", "mae", "rmsle", "logloss", "auc", "gini"):
        score, _ = metrics.metric(name)
        assert score(rows, "y", "p").first()[0] == pytest.approx(score(clean, "y", "p").first()[0])
    one = spark.createDataFrame([(1, 0.9), (None, 0.5)], "y int, p double")
    assert metrics.logloss(one, "y", "p").first()[0] == pytest.approx(-math.log(0.9))
    half = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, None)], "y int, p double")
    assert metrics.auc(half, "y", "p").first()[0] == 1


def test_errors_of_long_columns(spark):
    rows = spark.createDataFrame([(9 * 10**18, -9 * 10**18), (0, 4 * 10**9)], "y long, p long")
    out = metrics.mse_rmse_mae(rows, "y", "p").first()
    assert out.mse == pytest.approx((18e18**2 + 16e18) / 2) and out.mae == pytest.approx((18e18 + 4e9) / 2)
    assert metrics.r2(rows, "y", "p").first().r2 == pytest.approx(1 - (18e18**2 + 16e18) / (2 * 4.5e18**2))


@pytest.mark.parametrize("quadratic", [False, True])
def test_kappa(spark, quadratic):
    rng = random.Random(2)
    pairs = [(rng.randrange(5), rng.randrange(6)) for _ in range(200)]
    pairs += [(k, k) for k in range(5) for _ in range(20)]
    rows = spark.createDataFrame([*pairs, (None, 1), (2, None)], "y int, p int")
    seen = np.mean([(a - b) ** 2 if quadratic else a != b for a, b in pairs])
    chance = np.mean([[(a - b) ** 2 if quadratic else a != b for _, b in pairs] for a, _ in pairs])
    name = "quadratic_kappa" if quadratic else "cohens_kappa"
    score, direction = metrics.metric(name)
    assert direction == "maximize" and score(rows, "y", "p").first()[0] == pytest.approx(1 - seen / chance)
    assert score(spark.createDataFrame([(1, 1), (1, 1)], "y int, p int"), "y", "p").first()[0] is None


def test_partitions_of_a_fit_follow_the_rows(spark, monkeypatch):
    class Counts:
        def setFeaturesCol(self, _):
            return self

        setLabelCol = setFeaturesCol

        def hasParam(self, _):
            return False

        def fit(self, rows):
            return rows.rdd.getNumPartitions(), rows.count()

    monkeypatch.setattr(learn, "PART_ROWS", 100, raising=False)
    df = spark.range(1000).select(F.col("id").cast("double").alias("a"), F.lit("train").alias("split"), (F.col("id") % 2).alias("fold"), F.lit(1.0).alias("y")).coalesce(1)
    got = learn.fit_folds(df, ["a"], "y", "regression", k=2, trainer=learn.Trainer(lambda task, params: Counts(), {}, {}))
    assert got == {0: (10, 500), 1: (10, 500)}


def test_trees_of_a_round_read_steps_worked_out_once(spark, monkeypatch):
    """A tree reads its rows several times; steps and curvatures of all classes are held, not computed again by every pass."""
    from pyspark.ml.feature import VectorAssembler

    from tallyloom.operators.boosting import SoftmaxBooster

    held, tree = [], SoftmaxBooster._tree
    monkeypatch.setattr(SoftmaxBooster, "_tree", lambda self, rows, k, i: held.append(rows.storageLevel.useMemory and {"_z", "_c"} <= set(rows.columns)) or tree(self, rows, k, i))
    rows = VectorAssembler(inputCols=["a"], outputCol="x").transform(spark.range(60).selectExpr("cast(id as double) as a", "cast(id div 20 as double) as y"))
    model = SoftmaxBooster(maxIter=5, maxDepth=2).setFeaturesCol("x").setLabelCol("y").fit(rows)
    assert held == [True] * 15
    assert model.transform(rows).where("prediction = y").count() == 60
