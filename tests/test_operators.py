"""Small hand-computed frames and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.core import assert_unique, levels, small_keys, stat, work_dir
from tallyloom.functions import metrics, scalar
from tallyloom.operators import chains, clean, encode, folds, group, impute, learn, post, profile, relate, reshape, rowwise, study
from tallyloom.sources import tables
from tallyloom.spec import TableSpec, in_scope


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def people(spark):
    data = [
        (1, "train", "a", 1.0, 1, 0), (2, "train", "a", 3.0, 0, 1), (3, "train", "b", 5.0, 1, 0), (4, "train", None, None, 0, 1),
        (5, "test", "a", 100.0, None, None), (6, "test", "c", 7.0, None, None), (7, "test", None, None, None, None),
    ]
    return spark.createDataFrame(data, "id int, split string, k string, x double, y int, fold int")


def test_scope_train_ignores_test_rows(people):
    moved = people.withColumn("x", F.when(F.col("split") == "test", F.col("x") * 1000).otherwise(F.col("x")))
    for op in (lambda d: group.group_encode(d, [("x", ["k"], ["mean"])], "train"), lambda d: impute.standardize(d.select("id", "split", "x"), ["x"], "train")):
        a, b = (op(d).where("split = 'train'") for d in (people, moved))
        assert rows(a, a.columns[-1], "id") == rows(b, b.columns[-1], "id")
    both = rows(group.group_encode(people, [("x", ["k"], ["mean"])], "all"), "id", "x_k_mean")
    assert both[0] == (1, pytest.approx(104 / 3))


def test_group_statistics_of_small_groups(spark):
    df = spark.createDataFrame([("a", 2), ("a", 4), ("b", 5), ("c", None)], "k string, v int")
    got = {r["k"]: r for r in df.groupBy("k").agg(*[stat(df, "v", f).alias(f) for f in ("mean", "std", "std_pop", "size", "count")]).collect()}
    assert (got["a"]["mean"], got["a"]["std"], got["a"]["std_pop"]) == (3.0, math.sqrt(2), 1.0)
    assert (got["b"]["mean"], got["b"]["std"], got["b"]["std_pop"]) == (5.0, None, 0.0)
    assert (got["c"]["mean"], got["c"]["std"], got["c"]["size"], got["c"]["count"]) == (None, None, 1, 0)


def test_label_and_ordinal_codes(people):
    assert rows(encode.label_encode(people, ["k"], "train"), "id", "k_code") == [(1, 0), (2, 0), (3, 1), (4, -1), (5, 0), (6, -1), (7, -1)]
    assert rows(encode.ordinal_encode(people, ["k"], "train"), "id", "k_code") == [(1, 0), (2, 0), (3, 1), (4, 2), (5, 0), (6, 2), (7, 2)]
    hot = encode.one_hot(people, ["k"])
    assert rows(hot, "id", "k=a", "k=b")[5:] == [(6, 0, 0), (7, 0, 0)]


def test_out_of_fold_mean_excludes_the_own_fold(people):
    got = dict(rows(encode.target_mean_oof(people, ["k"], "y", "fold"), "id", "k_target"))
    # k = a: row 1 (fold 0) sees row 2 only and the other way round; b has no other fold; null and c use the mean.
    assert got == {1: 0.0, 2: 1.0, 3: 0.5, 4: 0.5, 5: 0.5, 6: 0.5, 7: 0.5}
    flipped = people.withColumn("y", F.when(F.col("id") == 1, 0).otherwise(F.col("y")))
    assert dict(rows(encode.target_mean_oof(flipped, ["k"], "y", "fold"), "id", "k_target"))[1] == 0.0


def test_likelihood_and_leave_one_out(people):
    got = dict(rows(encode.likelihood(people, ["k"], "y", "fold", m=30.0), "id", "k_likelihood"))
    # Fold 1 rows (2 and 4) are all zeros, fold 0 rows all ones.
    assert got[1] == pytest.approx((0 + 30 * 0.0) / 31) and got[2] == pytest.approx((1 + 30 * 1.0) / 31)
    assert got[5] == pytest.approx((1 + 30 * 0.5) / 32) and got[6] == pytest.approx(0.5)
    assert dict(rows(encode.leave_one_out(people, ["k"], "y"), "id", "k_loo")) == {1: 0.0, 2: 1.0, 3: 0.5, 4: 0.5, 5: 0.5, 6: 0.5, 7: 0.5}


def test_uniqueness_codes(spark):
    data = [(1, "train", 1, 1.0), (2, "train", 1, 1.0), (3, "train", 0, 1.0), (4, "train", 0, 2.0), (5, "test", None, 2.0), (6, "test", None, 3.0), (7, "test", None, 1.0), (8, "test", None, 1.0)]
    df = spark.createDataFrame(data, "id int, split string, y int, v double")
    got = dict(rows(encode.uniqueness_pattern(df, ["v"], "y", "id", "all"), "id", "v_pattern"))
    # Rows 5 and 6 hold values unique within test, so they count as real and 2.0 is seen twice.
    assert got == {1: 3, 2: 3, 3: 2, 4: 0, 5: 1, 6: 4, 7: 3, 8: 3}
    assert dict(rows(encode.uniqueness_pattern(df, ["v"], "y", "id", "train"), "id", "v_pattern"))[4] == 4
    assert dict(rows(encode.real_rows(df, ["v"], "id"), "id", "is_real")) == {1: None, 2: None, 3: None, 4: None, 5: 1, 6: 1, 7: 0, 8: 0}


def test_folds_partition_rows(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 3 == 0).cast("int")).withColumn("g", F.col("id") % 12)
    k = folds.kfold(df, ["id"], 5, 1)
    assert k.count() == 1000 and {r["fold"] for r in k.select("fold").distinct().collect()} == set(range(5))
    strat = folds.stratified(df, ["id"], "y", 5, 1).groupBy("y", "fold").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in strat if r["y"] == y]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    whole = folds.group_kfold(df, "g", 4).select("g", "fold").distinct()
    assert whole.count() == 12
    parts = folds.head_tail(df, ["id"], 0.75).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in parts} == {"train": 750, "val": 250}
    timed = folds.time_folds(df, "id", [(100, 150), (150, 200)], 50)
    assert rows(timed.groupBy("fold", "role").count(), "fold", "role", "count") == [(0, "train", 51), (0, "val", 50), (1, "train", 101), (1, "val", 50)]


def test_scaling_round_trips(spark):
    df = spark.createDataFrame([(i, "train", float(i * i + 1)) for i in range(20)], "id int, split string, t double")
    back = impute.unstandardize(impute.standardize(df, ["t"]), "t_std", df, "t", "b")
    assert all(abs(r["t"] - r["b"]) < 1e-9 for r in back.collect())
    for fn in ("log1p", "sqrt"):
        same = impute.inverse_target(impute.transform_target(df, "t", fn, "f"), "f", fn, "b")
        assert all(abs(r["t"] - r["b"]) < 1e-9 for r in same.collect())
    chain = post.inverse_chain(df.withColumn("p", (F.log1p("t") - 2) / 3), "p", [("log1p", {}), ("standardize", {"mean": 2.0, "std": 3.0})])
    assert all(abs(r["t"] - r["p"]) < 1e-9 for r in chain.collect())


def test_quantile_normal_is_monotone_and_normal(spark):
    df = spark.range(999).select(F.lit("train").alias("split"), (F.col("id") * F.col("id")).cast("double").alias("x"))
    got = impute.quantile_normal(df, ["x"], n=101).orderBy("x").toPandas().x_qn.to_numpy()
    assert (np.diff(got) > 0).all() and abs(np.median(got)) < 0.01
    assert got[int(999 * 0.8413)] == pytest.approx(1.0, abs=0.03) and got[0] == pytest.approx(-5.199, abs=0.01)


def test_inverse_normal(spark):
    p = spark.createDataFrame([(0.5,), (0.975,), (0.01,), (0.001,)], "p double")
    got = [r["z"] for r in p.select(impute.inverse_normal(F.col("p")).alias("z")).collect()]
    assert got == pytest.approx([0.0, 1.959964, -2.326348, -3.090232], abs=1e-5)


def test_iterative_imputation_finds_a_linear_rule(spark):
    df = spark.createDataFrame([(i, float(i % 17), None if i % 7 == 0 else 2.0 * (i % 17) + 3) for i in range(300)], "id int, a double, b double")
    got = impute.impute_iterative(df, ["a", "b"], rounds=2)
    assert all(abs(r["b"] - (2 * r["a"] + 3)) < 1e-6 for r in got.collect())


def test_pca_and_svd_agree_with_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4)) @ np.diag([5, 3, 1, 0.2]) + [1, 2, 3, 4]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double, d double")
    got = impute.pca(df, ["a", "b", "c", "d"], 2).orderBy("id").toPandas()[["pca_0", "pca_1"]].to_numpy()
    _, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs((x - x.mean(0)) @ vt[:2].T), atol=1e-6)
    raw = impute.svd(df, ["a", "b", "c", "d"], 2).orderBy("id").toPandas()[["svd_0", "svd_1"]].to_numpy()
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    want = x @ vt[:2].T
    want = (want - want.mean(0)) / want.std(0)
    assert np.allclose(np.abs(raw), np.abs(want), atol=1e-6)


def test_chains_with_a_cycle(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (200, 201), (201, 202), (202, 200)], "src long, dst long")
    got = rows(chains.chain_paths(edges), "chain", "node", "position")
    assert got == sorted([(1, i, i - 1) for i in range(1, 41)] + [(100, 100, 0), (100, 101, 1)] + [(200, 200, 0), (200, 201, 1), (200, 202, 2)], key=repr)
    assert sorted(r.node for r in chains.chain_paths(edges).where("cycle").collect()) == [200, 201, 202]


def test_link_edges_need_unique_keys(spark):
    df = spark.createDataFrame([(1, 5, 6, 7), (2, 4, 5, 6), (3, 0, 0, 0), (4, 0, 0, 0)], "id int, a int, b int, c int")
    assert rows(chains.link_edges(df, [["a", "b", "c"]], "id"), "src", "dst") == [(1, 2)]


def test_profile_drops(spark):
    df = spark.createDataFrame([(i, 1, "x" if i % 2 else None, None, i % 2) for i in range(10)], "id int, one int, xs string, none string, two int")
    assert profile.drop_constant(df).columns == ["id", "none", "two"]
    assert profile.drop_all_null(df).columns == ["id", "one", "xs", "two"]
    assert profile.drop_sparse(df, 0.4).columns == ["id", "one", "two"]
    assert profile.binary_cols(df) == ["two"]
    twin = df.withColumn("two_0", F.col("two")).withColumn("near", F.when(F.col("id") == 3, 5).otherwise(F.col("two")))
    assert profile.drop_duplicate_cols(twin, ["id"], ["two", "two_0", "near"]).columns == ["id", "one", "xs", "none", "two", "near"]


def test_clean_rules(spark):
    df = spark.createDataFrame([(1, 5, None), (2, -1, 3), (3, 99, 9)], "id int, a int, b int")
    assert rows(clean.clip(df, "a", 0, 50), "a") == [(0,), (5,), (50,)]
    assert rows(clean.sentinel_to_null(df, ["a"], [-1, 99]), "id", "a") == [(1, 5), (2, None), (3, None)]
    fixed = clean.repair(df, [("a", F.col("a") > 50, F.lit(4)), ("b", F.col("a") == 4, F.lit(0))])
    assert rows(fixed, "id", "a", "b") == [(1, 5, None), (2, -1, 3), (3, 4, 0)]
    assert [f.dataType.simpleString() for f in clean.narrow_types(df).schema] == ["tinyint"] * 3


def test_relations(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id int, k string")
    right = spark.createDataFrame([("a", 10), ("b", 20), ("c", 30), ("c", 31)], "k string, v int")
    assert rows(relate.unique_key_join(left, right, ["k"]), "id", "v") == [(1, 10), (2, None), (3, None)]
    with pytest.raises(ValueError):
        relate.left_join_keep(left, right, ["k"])
    assert rows(reshape.only_unique(right, ["k"]), "k", "v") == [("a", 10), ("b", 20)]
    assert rows(reshape.dedupe_first(right, ["k"], ["v"]), "k", "v") == [("a", 10), ("b", 20), ("c", 30)]
    dense = reshape.crosstab_dense(spark.createDataFrame([("x", 1), ("x", 1), ("y", 2)], "a string, b int"), "a", "b")
    assert rows(dense, "a", "b", "n") == [("x", 1, 2), ("x", 2, 0), ("y", 1, 0), ("y", 2, 1)]
    with pytest.raises(ValueError):
        levels(right, "v", 2)
    with pytest.raises(ValueError):
        assert_unique(right, ["k"])


def test_pivot_undoes_unpivot(spark):
    df = spark.createDataFrame([(1, 5, 6), (2, 7, 8)], "id int, a int, b int")
    long = reshape.unpivot(df, ["id"], ["a", "b"], "c", "v")
    assert rows(reshape.pivot(long, ["id"], "c", ["a", "b"], F.first("v")), "id", "a", "b") == rows(df, "id", "a", "b")


def test_rowwise_and_scalar(spark):
    df = spark.createDataFrame([(1, 0, 4, 8), (2, 0, 0, 0)], "id int, a int, b int, c int")
    got = rowwise.nonzero_stats(df, {"g": ["a", "b", "c"]}).orderBy("id").collect()
    assert (got[0]["g_mean"], got[0]["g_median"], got[0]["g_zeros"], got[0]["g_unique"]) == (6.0, 6.0, 1, 3)
    assert (got[1]["g_mean"], got[1]["g_median"], got[1]["g_low"], got[1]["g_zeros"]) == (None, None, None, 3)
    assert rows(scalar.ratios(df, [("r", "c", "a")]), "r") == [(0.0,), (0.0,)]
    assert rows(rowwise.precision_flag(df.select((F.col("b") / 3.0).alias("q")), ["q"]), "has_ugly") == [(0,), (1,)]
    with pytest.raises(ValueError):
        scalar.concat_r(df, ["id", "a", "b", "c"], 2, max_new=3)


def test_broadcast_only_when_measured_small(spark):
    df = spark.range(20000).withColumn("g", F.col("id") % 5)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100KB")
    try:
        assert small_keys(df, [["id"], ["g"]]) == {("id",): False, ("g",): True}
        plan = group.group_count(df, ["id"])._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_topk_ensemble_keeps_the_single_best_when_it_is_not_beaten(spark):
    preds = [(f, t, k, k % 2, (k % 2) if t == 0 else 1 - (k % 2)) for f in range(2) for t in range(3) for k in range(10)]
    p = spark.createDataFrame([(f, t, k, y, float(v)) for f, t, k, y, v in preds], "fold int, trial int, key int, y int, pred double")
    mse = lambda df, y, pr, by: metrics.mse_rmse_mae(df, y, pr, by).select(*by, "mse")
    trials = mse(p, "y", "pred", ["fold", "trial"]).withColumnRenamed("mse", "score")
    assert rows(learn.topk_ensemble(trials, p, ["key"], mse, "mse"), "fold", "k", "score") == [(0, 1, 0.0), (1, 1, 0.0)]
    assert rows(learn.first_n_best(trials, 2, "minimize"), "fold", "trial") == [(0, 0), (1, 0)]


def test_cache_reuses_and_overwrites(spark):
    where = work_dir(spark, "cache-test")
    spec = TableSpec(key=("id",), target="y")
    version = spec.version("fe", "all")
    tables.cache_features(spark.range(5), where, version)
    assert tables.cache_features(spark.range(9), where, version).count() == 5
    assert tables.cache_features(spark.range(9), where, version, overwrite=True).count() == 9
    assert version != spec.version("fe", "train") and spec.with_state("fe").states == ("fe",)


def test_results_do_not_depend_on_partitioning(spark):
    df = spark.range(3000).select((F.col("id") % 7).alias("k"), (F.col("id") * 37 % 1000).cast("decimal(12,2)").alias("x"), F.lit("train").alias("split"))
    op = lambda d: rows(group.stats_pack(d, ["x"], ["k"]).distinct(), "k", "x_by_k_mean", "x_by_k_std", "x_by_k_median")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    first = op(df)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        assert op(df.repartition(5)) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_gain_graph_shape():
    edges = study.default_edges()
    steps = 2 * 3 * 2 + 3 * 2 * 2 + 3 * 3 * 1  # along preparation, search and selection
    assert len(edges) == len(set(edges)) == steps and len({n for e in edges for n in e}) == 3 * 3 * 2


def test_unknown_scope_is_refused(people):
    with pytest.raises(ValueError):
        in_scope(people, "validation")


def test_statistics_beyond_bigint(spark):
    df = spark.createDataFrame([(9 * 10**18,), (9 * 10**18,), (-(9 * 10**18),)], "x long")
    row = df.agg(stat(df, "x", "mean").alias("mean"), stat(df, "x", "std").alias("std")).first()
    assert row.mean == 3e18 and abs(row.std / 1.0392304845413264e19 - 1) < 1e-12


def test_one_of_three_equal_columns_stays(spark):
    df = spark.createDataFrame([(1, 5, 5, 5, 6), (2, 7, 7, 7, 6)], "id long, x_0 long, y long, z long, other long")
    assert profile.drop_duplicate_cols(df, ["id"], ["x_0", "y", "z", "other"]).columns == ["id", "y", "other"]


def test_groups_of_any_number_share_one_rule(spark):
    df = spark.createDataFrame([(None,)] * 3 + [(g,) for g in range(11) for _ in range(g + 1)], "g long")
    out = folds.group_kfold(df, "g", 4)
    assert out.count() == 69 and out.where("fold is null").count() == 0 and out.select("g", "fold").distinct().count() == 12


def test_metric_by_name(spark):
    df = spark.createDataFrame([(0, 1.0, 0.5), (0, 0.0, 0.5), (1, 1.0, 1.0)], "g int, y double, p double")
    score, direction = metrics.metric("mae")
    assert direction == "minimize" and rows(score(df, "y", "p", ["g"]), "g", "mae") == [(0, 0.5), (1, 0.0)]
    assert metrics.metric("auc")[1] == "maximize"
    with pytest.raises(ValueError):
        metrics.metric("speed")


def test_a_trainer_of_ones_own(spark):
    df = spark.createDataFrame([(i, "train" if i % 4 else "test", float(i % 7), 3.0 * (i % 7) + 1, i % 2) for i in range(80)], "id int, split string, x double, y double, fold int")
    models = learn.fit_folds(df, ["x"], "y", "regression", {"regParam": 0.0}, k=2, trainer=learn.LINEAR)
    got = learn.predict(models, df, ["x"], ["id"], "regression").join(df.select("id", "y"), "id")
    assert got.count() == 60 + 2 * 20 and got.where("abs(pred - y) > 1e-6").count() == 0
    trials, preds = learn.random_search(df, ["x"], "y", "regression", ["id"], "rmse", 2, 5, 2, trainer=learn.LINEAR)
    assert rows(trials, "trial", "fold") == [(0, 0), (0, 1), (1, 0), (1, 1)] and preds.count() == 2 * 100
    assert set(trials.first().params) == set(learn.LINEAR.space)


def test_imputation_per_split_and_on_training_rows(spark):
    data = [(i, "train" if i < 40 else "test", float(i % 9), None if i % 5 == 0 else float(i % 9) * (2 if i < 40 else 7)) for i in range(80)]
    df = spark.createDataFrame(data, "id int, split string, a double, b double")
    own = dict(rows(impute.impute_iterative(df, ["a", "b"], 2, "split"), "id", "b"))
    train = dict(rows(impute.impute_iterative(df, ["a", "b"], 2, "train"), "id", "b"))
    assert all(own[i] == pytest.approx((i % 9) * (2 if i < 40 else 7)) for i in range(80))
    assert all(train[i] == pytest.approx((i % 9) * 2) for i in range(0, 80, 5))


def test_joined_levels_are_counted_by_their_parts(spark):
    df = spark.createDataFrame([("a_b", "c"), ("a", "b_c"), ("a", "b_c"), (None, "c"), (None, "c"), ("null", "c")], "t_1 string, t_2 string")
    got = rows(group.concat_count(df, "t_"), "t_1", "t_2", "combo", "combo_count")
    assert set(got) == {("a_b", "c", "a_b_c", 1), ("a", "b_c", "a_b_c", 2), (None, "c", "null_c", 2), ("null", "c", "null_c", 1)}
