"""Registered queries for model jobs, metrics, post-processing, studies and chains (inventories N to R)."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from tallyloom.catalog.fixtures import (
    AUTO, BASE, FXB, FXG, FXL, FXO, FXP, FXS, MODELS, fx_board, fx_entries, fx_grid, fx_lines,
    fx_orders, fx_preds, fx_scores, fx_trials, fx_weekly, table,
)
from tallyloom.catalog.registry import plain, query
from tallyloom.core import stored, with_scalars
from tallyloom.functions import metrics
from tallyloom.operators import chains, folds, learn, post, shifts, study
from tallyloom.operators.windows import lags
from tallyloom.spec import TRAIN

# --- N: model jobs ------------------------------------------------------------------------------------------

FEATURES = ["o_custkey", "nationkey", "acctbal", "month", "hash_mod", "price_level"]
SMALL = {"maxIter": 5, "maxDepth": 3}
LEARNED = {"maxIter": 10, "maxDepth": 4, "stepSize": 0.3}
SMALL_SPACE = {"maxIter": ("int", 3, 6), "maxDepth": ("int", 2, 4), "stepSize": ("log", 0.05, 0.5)}


def _fold_of(k: int) -> str:
    """The fold of an order in SQL, as ``folds.kfold`` with seed 3 gives it."""
    return f"CAST(('0x' || substr(md5(o_orderkey::VARCHAR || ':3'), 1, 8))::BIGINT % {k} AS INTEGER)"


def _per_fold(k: int, flag: str) -> str:
    return f"WITH {FXO} SELECT {_fold_of(k)} AS fold, COUNT(*) AS n, 1 AS {flag} FROM fxo WHERE split = 'train' GROUP BY 1"


def _scored(preds, scores, passed, flag):
    """Rows predicted per fold, and whether the fold's score passes a test that does not depend on the fit's last digits."""
    sizes = preds.groupBy("fold").agg(F.countDistinct("o_orderkey").alias("n"))
    return sizes.join(scores, "fold").select("fold", "n", passed.cast("int").alias(flag))


def _ml_rows(s, d, k=5):
    rows = folds.kfold(fx_orders(s, d), ["o_orderkey"], k, 3)
    noisy = F.col("total").cast("double") / 1000 + F.col("acctbal").cast("double") / 100
    return rows.select(
        "o_orderkey", "split", "y", F.col("o_custkey").cast("double").alias("o_custkey"), F.col("nationkey").cast("double").alias("nationkey"),
        F.col("acctbal").cast("double").alias("acctbal"), F.month("odate").cast("double").alias("month"),
        (F.col("o_orderkey") * 7919 % 1000).cast("double").alias("hash_mod"), noisy.alias("target"), "priority",
        F.floor(F.col("total") / 50000).cast("double").alias("price_level"), F.when(F.col("split") == TRAIN, F.col("fold")).alias("fold"),
    )


@query("fit_folds", _per_fold(5, "beats_mean"))
def fit_folds(s, d):
    """Boosted trees (regression) with early stop on the fold: rows per fold, and whether they beat the target's mean."""
    rows = _ml_rows(s, d)
    models = learn.fit_folds(rows, FEATURES, "target", "regression", SMALL, k=5)
    preds = learn.predict(models, rows.where("split = 'train'"), FEATURES, ["o_orderkey"], "regression").join(rows.select("o_orderkey", "target"), "o_orderkey")
    return _scored(preds, metrics.r2(preds, "target", "pred", ["fold"]), F.col("r2") > 0, "beats_mean")


@query("fit_folds_weighted", _per_fold(3, "separates"))
def fit_folds_weighted(s, d):
    """Binary boosted trees with balanced class weights: rows per fold, and whether they tell the classes apart."""
    rows = learn.class_weights(_ml_rows(s, d, 3).withColumn("dear", _dear()), "dear")
    models = learn.fit_folds(rows, FEATURES, "dear", "binary", SMALL, k=3, weight="class_weight")
    preds = learn.predict(models, rows.where("split = 'train'"), FEATURES, ["o_orderkey"], "binary").join(rows.select("o_orderkey", "dear"), "o_orderkey")
    return _scored(preds, metrics.auc(preds, "dear", "pred", ["fold"]), F.col("auc") > 0.8, "separates")


def _dear():
    return (F.col("target") > 300).cast("int")


def class_loss(preds, rows, by):
    """Log loss of class probabilities (``pred``, an array) against ``label``."""
    long = preds.join(rows.select("o_orderkey", "label"), "o_orderkey").select("o_orderkey", *by, "label", F.posexplode("pred").alias("class", "p"))
    return metrics.mlogloss(long.withColumn("hit", (F.col("class") == F.col("label")).cast("int")), ["o_orderkey"], "hit", "p", by)


@query("fit_folds_multiclass", _per_fold(3, "beats_forest"))
def fit_folds_multiclass(s, d):
    """Boosting over five classes: rows per fold, and whether its log loss is below that of a forest with as many trees per class."""
    level = F.greatest(F.least(F.floor(F.col("target") / 75), F.lit(4)), F.lit(0)).cast("int")
    rows = _ml_rows(s, d, 3).withColumn("label", level).persist()
    known = rows.where("split = 'train'")
    scores = []
    for trainer, name in ((learn.TREES, "boosted"), (learn.FOREST, "forest")):
        models = learn.fit_folds(rows, FEATURES, "label", "classification", {"maxIter": 5, "maxDepth": 3, "stepSize": 0.3}, k=3, trainer=trainer)
        preds = stored(learn.predict(models, known, FEATURES, ["o_orderkey"], "classification"), "class-predictions")
        scores.append(class_loss(preds, known, ["fold"]).withColumnRenamed("mlogloss", name))
    return _scored(preds, scores[0].join(scores[1], "fold"), F.col("boosted") < F.col("forest"), "beats_forest")


@query("oof_predict_feature", "SELECT o_orderkey, 1 AS acctbal_learned, 1 AS price_level_learned FROM orders")
def oof_predict_feature(s, d):
    """Every order with, for two of its columns, whether their out-of-fold predictions explain half of their spread over all orders."""
    rows = _ml_rows(s, d)
    targets = ["acctbal", "price_level"]
    out = learn.oof_features(rows, targets, [*FEATURES, "target"], ["o_orderkey"], 2, params=LEARNED)
    fits = {t: metrics.r2(out, t, f"{t}_oof").scalar() for t in targets}
    return out.select("o_orderkey", *[(F.col(f"{t}_oof").isNotNull() & (fits[t] > 0.5)).cast("int").alias(f"{t}_learned") for t in targets])


@query(
    "q_predict_batch",
    f"""WITH {FXO} SELECT o_orderkey, split, {_fold_of(2)} AS fold, 1 AS separates FROM fxo WHERE split = 'train'
    UNION ALL SELECT o_orderkey, split, f.fold, 1 FROM fxo CROSS JOIN (VALUES (0), (1)) f(fold) WHERE split = 'test'""",
)
def q_predict_batch(s, d):
    """Training rows by their own fold's model, test rows by every model; whether the rows of that model and split are told apart."""
    rows = _ml_rows(s, d, 2).withColumn("dear", _dear())
    models = learn.fit_folds(rows, FEATURES, "dear", "binary", SMALL, k=2)
    preds = learn.predict(models, rows, FEATURES, ["o_orderkey"], "binary")
    scores = metrics.auc(preds.join(rows.select("o_orderkey", "dear"), "o_orderkey"), "dear", "pred", ["split", "fold"])
    good = (F.col("auc") > 0.8) & F.col("pred").between(0, 1)
    return preds.join(scores, ["split", "fold"]).select("o_orderkey", "split", "fold", good.cast("int").alias("separates"))


@query(
    "random_search",
    f"""WITH {FXO}, n AS (SELECT f.fold, COUNT(*) FILTER (WHERE split = 'train' AND {_fold_of(2)} = f.fold) AS n_train, COUNT(*) FILTER (WHERE split = 'test') AS n_test
      FROM fxo CROSS JOIN (VALUES (0), (1)) f(fold) GROUP BY 1)
    SELECT t.trial, fold, 3 AS n_params, n_train, n_test, 1 AS beats_mean FROM n CROSS JOIN (VALUES (0), (1)) t(trial)""",
)
def random_search(s, d):
    """Trials by fold with the rows each of them predicted, and whether their error is below the spread of the fold's target."""
    rows = _ml_rows(s, d, 2)
    trials, preds = learn.random_search(rows, FEATURES, "target", "regression", ["o_orderkey"], "rmse", 2, 11, 2, SMALL_SPACE)
    sizes = preds.groupBy("trial", "fold").agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test"))
    spread = rows.where("split = 'train'").groupBy("fold").agg(F.stddev_pop("target").alias("spread"))
    out = trials.join(sizes, ["trial", "fold"]).join(spread, "fold")
    return out.select("trial", "fold", F.size("params").alias("n_params"), "n_train", "n_test", (F.col("score") < F.col("spread")).cast("int").alias("beats_mean"))


def _one_score(metric, name, df, y, pred, by):
    return metric(df, y, pred, by).select(*by, name)


_mse = partial(_one_score, metrics.mse_rmse_mae, "mse")


@query("q_class_weights", f"WITH {FXO}, c AS (SELECT status, COUNT(*) AS n FROM fxo GROUP BY 1) SELECT o_orderkey, (SELECT SUM(n) FROM c)::DOUBLE / ((SELECT COUNT(*) FROM c) * c.n) AS class_weight FROM fxo JOIN c USING (status)")
def q_class_weights(s, d):
    return learn.class_weights(fx_orders(s, d).select("o_orderkey", "status"), "status").drop("status")


@query("q_fold_average", f"WITH {FXP} SELECT o_orderkey, SUM(pred)::DOUBLE / COUNT(*) AS pred FROM fxp GROUP BY o_orderkey")
def q_fold_average(s, d):
    return learn.fold_average(fx_preds(s, d), ["o_orderkey"])


@query(
    "q_seed_average",
    f"WITH {FXP}, a AS (SELECT o_orderkey, trial % 3 AS seed, SUM(pred)::DOUBLE / COUNT(*) AS pred FROM fxp GROUP BY ALL) SELECT o_orderkey, round(AVG(pred), 6) AS pred FROM a GROUP BY 1",
)
def q_seed_average(s, d):
    return plain(learn.seed_average(fx_preds(s, d).withColumn("seed", F.col("trial") % 3), ["o_orderkey"]), 6)


TOPK = f"""WITH {FXP}, rk AS (SELECT fold, trial, row_number() OVER (PARTITION BY fold ORDER BY score, trial) AS rank FROM fxt),
gr AS (SELECT p.fold, r.rank AS k, p.y, AVG(p.pred::DOUBLE) OVER (PARTITION BY p.fold, p.o_orderkey ORDER BY r.rank ROWS UNBOUNDED PRECEDING) AS m FROM fxp p JOIN rk r ON r.fold = p.fold AND r.trial = p.trial WHERE r.rank <= 10),
sc AS (SELECT fold, k, SUM((y - m) * (y - m)) / COUNT(*) AS score FROM gr GROUP BY ALL),
b AS (SELECT fold, MAX(score) FILTER (WHERE k = 1) AS single, arg_min(k, score) FILTER (WHERE k > 1) AS ek, MIN(score) FILTER (WHERE k > 1) AS es FROM sc GROUP BY 1),
ch AS (SELECT fold, CASE WHEN round(es, 4) < round(single, 4) THEN ek ELSE 1 END AS k, CASE WHEN round(es, 4) < round(single, 4) THEN es ELSE single END AS score FROM b)"""


@query("q_topk_ensemble", f"{TOPK} SELECT fold, CAST(k AS INTEGER) AS k, round(score, 9) AS score FROM ch")
def q_topk_ensemble(s, d):
    chosen = learn.topk_ensemble(fx_trials(s, d), fx_preds(s, d).drop("split", "nation"), ["o_orderkey"], _mse, "mse")
    return plain(chosen, 9)


@query("q_topk_ensemble_preds", f"{TOPK} SELECT p.fold, p.o_orderkey, round(AVG(p.pred::DOUBLE), 6) AS pred FROM fxp p JOIN rk r ON r.fold = p.fold AND r.trial = p.trial JOIN ch ON ch.fold = p.fold WHERE r.rank <= ch.k GROUP BY ALL")
def q_topk_ensemble_preds(s, d):
    trials, preds = fx_trials(s, d), fx_preds(s, d).drop("split", "nation")
    chosen = learn.topk_ensemble(trials, preds, ["o_orderkey"], _mse, "mse")
    return plain(learn.ensemble_preds(trials, preds, chosen, ["o_orderkey"], "minimize"), 6)


@query("q_oneconfig", f"WITH {FXP}, m AS (SELECT arg_min(trial, score) AS trial FROM (SELECT trial, AVG(score) AS score FROM fxt GROUP BY 1)) SELECT p.trial, o_orderkey, SUM(pred)::DOUBLE / COUNT(*) AS pred FROM fxp p JOIN m ON m.trial = p.trial GROUP BY ALL")
def q_oneconfig(s, d):
    return learn.one_config(fx_trials(s, d), fx_preds(s, d), ["o_orderkey"], "minimize")


@query("q_first_n_trials", f"WITH {FXP} SELECT fold, arg_min(trial, score) AS trial, round(MIN(score), 9) AS score FROM fxt WHERE trial < 8 GROUP BY fold")
def q_first_n_trials(s, d):
    return plain(learn.first_n_best(fx_trials(s, d), 8, "minimize"), 9)


# --- O: metrics --------------------------------------------------------------------------------------------------


@query("q_m_r2", f"WITH {FXP} SELECT trial, round(1 - SUM((y - pred) * (y - pred))::DOUBLE / (SUM(y * y) - SUM(y) * SUM(y)::DOUBLE / COUNT(*)), 9) AS r2 FROM fxp GROUP BY trial")
def q_m_r2(s, d):
    return plain(metrics.r2(fx_preds(s, d), "y", "pred", ["trial"]), 9)


@query(
    "q_m_mse_rmse_mae",
    f"WITH {FXP} SELECT trial, round(SUM((y - pred) * (y - pred))::DOUBLE / COUNT(*), 9) AS mse, round(sqrt(SUM((y - pred) * (y - pred))::DOUBLE / COUNT(*)), 9) AS rmse, round(SUM(abs(y - pred))::DOUBLE / COUNT(*), 9) AS mae FROM fxp GROUP BY trial",
)
def q_m_mse_rmse_mae(s, d):
    return plain(metrics.mse_rmse_mae(fx_preds(s, d), "y", "pred", ["trial"]), 9)


@query("q_m_rmsle", f"WITH {FXP} SELECT trial, round(sqrt(AVG((ln(1 + pred::DOUBLE) - ln(1 + y::DOUBLE)) * (ln(1 + pred::DOUBLE) - ln(1 + y::DOUBLE)))), 9) AS rmsle FROM fxp GROUP BY trial")
def q_m_rmsle(s, d):
    return plain(metrics.rmsle(fx_preds(s, d), "y", "pred", ["trial"]), 9)


CLIP = "greatest(least({}, 1 - 1e-15), 1e-15)"


@query("q_m_logloss", f"WITH {FXP}, x AS (SELECT trial, y, {CLIP.format('pred::DOUBLE')} AS p FROM fxp) SELECT trial, round(-AVG(CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END), 9) AS logloss FROM x GROUP BY trial")
def q_m_logloss(s, d):
    return plain(metrics.logloss(fx_preds(s, d), "y", "pred", ["trial"]), 9)


MULTI = f"""{FXO}, c AS (SELECT o_orderkey, hfold, k.k AS class, (substr(priority, 1, 1) = k.k::VARCHAR)::INTEGER AS hit,
  ((o_orderkey * 7919 + k.k * 104729) % 997 + 1)::DOUBLE AS p FROM fxo CROSS JOIN (SELECT UNNEST(range(1, 6)) AS k) k)"""


def _class_rows(s, d):
    rows = fx_orders(s, d).withColumn("class", F.explode(F.sequence(F.lit(1), F.lit(5))))
    return rows.select(
        "o_orderkey", "hfold", "class", (F.substring("priority", 1, 1) == F.col("class").cast("string")).cast("int").alias("hit"),
        ((F.col("o_orderkey") * 7919 + F.col("class") * 104729) % 997 + 1).cast("double").alias("p"),
    )


@query("q_m_mlogloss", f"WITH {MULTI}, r AS (SELECT o_orderkey, hfold, SUM(p) AS t, SUM(CASE WHEN hit = 1 THEN p END) AS own FROM c GROUP BY ALL) SELECT hfold, round(-AVG(ln({CLIP.format('own / t')})), 9) AS mlogloss FROM r GROUP BY 1")
def q_m_mlogloss(s, d):
    return plain(metrics.mlogloss(_class_rows(s, d), ["o_orderkey"], "hit", "p", ["hfold"]), 9)


@query("q_m_multilabel", f"WITH {MULTI}, r AS (SELECT hfold, class, -AVG(CASE WHEN hit = 1 THEN ln(p / 1000) ELSE ln(1 - p / 1000) END) AS l FROM c GROUP BY ALL) SELECT hfold, round(AVG(l), 9) AS multilabel FROM r GROUP BY 1")
def q_m_multilabel(s, d):
    return plain(metrics.multilabel(_class_rows(s, d).withColumn("p", F.col("p") / 1000), "class", "hit", "p", ["hfold"]), 9)


AUC = f"""{FXP}, h AS (SELECT trial, pred, COUNT(*) FILTER (WHERE y = 1) AS p, COUNT(*) FILTER (WHERE y = 0) AS n FROM fxp GROUP BY ALL),
cu AS (SELECT *, SUM(p) OVER (PARTITION BY trial ORDER BY pred DESC) - p AS above FROM h), a AS (SELECT trial, SUM(n * (above + p / 2.0::DOUBLE)) / (SUM(p)::DOUBLE * SUM(n)) AS auc FROM cu GROUP BY 1)"""


@query("q_m_auc", f"WITH {AUC} SELECT trial, round(auc, 9) AS auc FROM a")
def q_m_auc(s, d):
    return plain(metrics.auc(fx_preds(s, d), "y", "pred", ["trial"]), 9)


@query("q_m_gini", f"WITH {AUC} SELECT trial, round(2 * auc - 1, 9) AS gini FROM a")
def q_m_gini(s, d):
    return plain(metrics.gini(fx_preds(s, d), "y", "pred", ["trial"]), 9)


@query(
    "q_m_kappa",
    f"""WITH {FXO}, x AS (SELECT hfold, CAST(substr(priority, 1, 1) AS INTEGER) AS a, CAST((o_orderkey * 7919 + CAST(substr(priority, 1, 1) AS INTEGER)) % 9 // 2 AS INTEGER) AS b FROM fxo WHERE o_orderkey % 17 <> 0),
    m AS (SELECT hfold, SUM((a - b) * (a - b)) AS seen, COUNT(*) AS n FROM x GROUP BY 1),
    c AS (SELECT p.hfold, SUM((p.a - q.b) * (p.a - q.b) * p.n::HUGEINT * q.n) AS chance FROM (SELECT hfold, a, COUNT(*) AS n FROM x GROUP BY ALL) p JOIN (SELECT hfold, b, COUNT(*) AS n FROM x GROUP BY ALL) q USING (hfold) GROUP BY 1),
    k0 AS (SELECT hfold, COUNT(*) FILTER (WHERE a <> b) AS seen, COUNT(*) AS n FROM x GROUP BY 1),
    c0 AS (SELECT p.hfold, SUM(p.n::HUGEINT * q.n) FILTER (WHERE p.a <> q.b) AS chance FROM (SELECT hfold, a, COUNT(*) AS n FROM x GROUP BY ALL) p JOIN (SELECT hfold, b, COUNT(*) AS n FROM x GROUP BY ALL) q USING (hfold) GROUP BY 1)
    SELECT hfold, round(1 - seen::DOUBLE * n / chance::DOUBLE, 9) AS quadratic_kappa, round(1 - s0::DOUBLE * n / c0::DOUBLE, 9) AS cohens_kappa
    FROM m JOIN c USING (hfold) JOIN (SELECT hfold, seen AS s0 FROM k0) USING (hfold) JOIN (SELECT hfold, chance AS c0 FROM c0) USING (hfold)""",
)
def q_m_kappa(s, d):
    """Quadratic and plain kappa of a rating; rows without a label or without a rating do not count."""
    own = F.substring("priority", 1, 1).cast("int")
    rows = fx_orders(s, d).select("hfold", F.when(F.col("o_orderkey") % 17 != 0, own).alias("a"), F.floor((F.col("o_orderkey") * 7919 + own) % 9 / 2).cast("int").alias("b"))
    both = [metrics.metric(name)[0](rows, "a", "b", ["hfold"]) for name in ("quadratic_kappa", "cohens_kappa")]
    return plain(both[0].join(both[1], "hfold"), 9)


def _lorenz(order: str, name: str) -> str:
    return (
        f"{name}0 AS (SELECT trial, y, SUM(y) OVER (PARTITION BY trial ORDER BY {order} DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS cum FROM fxp), "
        f"{name} AS (SELECT trial, (SUM(cum)::DOUBLE / SUM(y) - (COUNT(*) + 1) / 2.0::DOUBLE) / COUNT(*) AS g FROM {name}0 GROUP BY 1)"
    )


@query("q_m_norm_gini", f"WITH {FXP}, {_lorenz('pred', 'lp')}, {_lorenz('y', 'ly')} SELECT trial, round(lp.g / ly.g, 9) AS norm_gini FROM lp JOIN ly USING (trial)")
def q_m_norm_gini(s, d):
    return plain(metrics.norm_gini(fx_preds(s, d), "y", "pred", ["o_orderkey"], ["trial"]), 9)


# --- P: post-processing ---------------------------------------------------------------------------------------------


@query("q_rule_override", f"WITH {FXP} SELECT o_orderkey, trial, CASE WHEN total < 20000 OR bal_n < 0 OR (priority = '5-LOW' AND status = 'P') THEN 0 ELSE pred END::DOUBLE AS pred FROM fxp JOIN fxo USING (o_orderkey)")
def q_rule_override(s, d):
    raw = fx_orders(s, d).select("o_orderkey", "total", "bal_n", "priority", "status")
    preds = fx_preds(s, d).select("o_orderkey", "trial", F.col("pred").cast("double").alias("pred")).join(raw, "o_orderkey")
    rules = [F.col("total") < 20000, F.col("bal_n") < 0, (F.col("priority") == "5-LOW") & (F.col("status") == "P")]
    return post.override(preds, "pred", rules).select("o_orderkey", "trial", "pred")


@query("q_attach_submission", f"WITH {FXP} SELECT o.o_orderkey, p.pred FROM orders o LEFT JOIN (SELECT o_orderkey, round(SUM(pred)::DOUBLE / COUNT(*), 9) AS pred FROM fxp WHERE split = 'test' GROUP BY 1) p USING (o_orderkey)")
def q_attach_submission(s, d):
    """The mean of all trials for every test order; training orders have none."""
    preds = learn.seed_average(fx_preds(s, d).where("split = 'test'").withColumn("seed", F.lit(0)), ["o_orderkey"]).select("o_orderkey", "pred")
    return plain(post.attach_submission(table(s, d, "orders").select("o_orderkey"), preds, ["o_orderkey"]), 9)


@query("q_known_override", f"WITH {FXP} SELECT o_orderkey, trial, CASE WHEN split = 'train' THEN y::DOUBLE ELSE pred::DOUBLE END AS pred FROM fxp")
def q_known_override(s, d):
    known = fx_orders(s, d).where("split = 'train'").select("o_orderkey", F.col("y").cast("double").alias("y"))
    preds = fx_preds(s, d).select("o_orderkey", "trial", F.col("pred").cast("double").alias("pred"))
    return post.known_override(preds, known, ["o_orderkey"], "pred", "y")


PERIODS = ["201610", "201611", "201612", "201710", "201711", "201712"]


@query("q_broadcast_periods", f"WITH {FXP} SELECT o_orderkey, trial, " + ", ".join(f"pred::DOUBLE AS \"{p}\"" for p in PERIODS) + " FROM fxp")
def q_broadcast_periods(s, d):
    return plain(post.broadcast_periods(fx_preds(s, d).select("o_orderkey", "trial", "pred"), "pred", PERIODS))


@query(
    "q_inverse_chain",
    f"""WITH {FXP}, m AS (SELECT AVG(ln(1 + total::DOUBLE)) AS m, stddev_pop(ln(1 + total::DOUBLE)) AS sd FROM fxo WHERE split = 'train')
    SELECT o_orderkey, trial, round(exp((pred::DOUBLE * 4 - 2) * sd + m) - 1, 4) AS fitted, round(exp((pred::DOUBLE * 4 - 2) * 0.5 + 10) - 1, 4) AS stated FROM fxp CROSS JOIN m""",
)
def q_inverse_chain(s, d):
    score = F.col("pred").cast("double") * 4 - 2
    preds = fx_preds(s, d).select("o_orderkey", "trial", score.alias("fitted"), score.alias("stated"))
    train = fx_orders(s, d).where("split = 'train'")
    out = post.fitted_inverse(preds, "fitted", train, "total", "log1p")
    return plain(post.inverse_chain(out, "stated", [("log1p", {}), ("standardize", {"mean": 10.0, "std": 0.5})]), 4)


@query(
    "q_segment_blend",
    f"""WITH {FXP}, x AS (SELECT o_orderkey, (o_custkey % 3 = 0)::INTEGER AS seg, trial AS fold, pred::DOUBLE AS pred FROM fxp)
    SELECT o_orderkey, seg, round(COALESCE(CASE WHEN seg = 1 THEN AVG(pred) FILTER (WHERE fold >= 6) END, AVG(pred) FILTER (WHERE fold < 6)), 6) AS pred FROM x GROUP BY o_orderkey, seg""",
)
def q_segment_blend(s, d):
    rows = fx_preds(s, d).select(
        "o_orderkey", (F.col("o_custkey") % 3 == 0).cast("int").alias("seg"), F.col("trial").alias("fold"), F.col("pred").cast("double").alias("pred")
    )
    return plain(post.segment_blend(rows, ["o_orderkey"], "seg", "fold", "pred", 6), 6)


# --- Q: leaderboards and studies ---------------------------------------------------------------------------------------


def _rank(side: str) -> str:
    return f"r_{side} AS (SELECT e.s_suppkey, 1 + COUNT(b.board) AS r FROM fxentry e LEFT JOIN fxboard b ON b.board = e.board AND b.{side} < e.{side}_score GROUP BY 1)"


@query(
    "q_lb_percentile",
    f"WITH {FXB}, n AS (SELECT board, COUNT(*) AS n FROM fxboard GROUP BY 1), {_rank('public')}, {_rank('private')} SELECT e.s_suppkey, p.r AS public_rank, p.r::DOUBLE / n.n AS public_pct, q.r AS private_rank, q.r::DOUBLE / n.n AS private_pct "
    "FROM fxentry e JOIN n USING (board) JOIN r_public p ON p.s_suppkey = e.s_suppkey JOIN r_private q ON q.s_suppkey = e.s_suppkey",
)
def q_lb_percentile(s, d):
    out = study.lb_percentile(fx_board(s, d), fx_entries(s, d), ["board"], "minimize")
    return out.drop("board", "public_score", "private_score")


MINIMIZED = ["NATION_1", "NATION_7"]


@query(
    "q_results_matrix",
    f"WITH {FXS} SELECT dataset, " + ", ".join(f"round(AVG(CASE WHEN dataset IN ('NATION_1', 'NATION_7') THEN 1 - value ELSE value END) FILTER (WHERE model = '{m}'), 6) AS \"{m}\"" for m in MODELS) + " FROM fxc WHERE prep = 'none' AND hpo = 'light' GROUP BY dataset",
)
def q_results_matrix(s, d):
    return plain(study.results_matrix(fx_scores(s, d).where("prep = 'none' and hpo = 'light'"), MODELS, MINIMIZED), 6)


def _stage(p: str, h: str) -> str:
    return f"MAX(value) FILTER (WHERE prep = '{p}' AND hpo = '{h}')"


@query(
    "q_stage_gains",
    f"""WITH {FXS}, w AS (SELECT dataset, model, {_stage('none', 'default')} AS d, {_stage('none', 'light')} AS l, {_stage('none', 'extensive')} AS e, {_stage('fe', 'extensive')} AS f, {_stage('tta', 'extensive')} AS t FROM fxc GROUP BY ALL),
    b AS (SELECT dataset, model, greatest(0, d) AS b0, greatest(0, d, least(l, e)) AS b1, greatest(0, d, e) AS b2, greatest(0, d, e, f) AS b3, greatest(0, d, e, f, t) AS b4 FROM w)
    SELECT dataset, model, round(b0, 6) AS gain_default, round(b1 - b0, 6) AS gain_light, round(b2 - b1, 6) AS gain_extensive, round(b3 - b2, 6) AS gain_fe, round(b4 - b3, 6) AS gain_tta FROM b""",
)
def q_stage_gains(s, d):
    return plain(study.stage_gains(fx_scores(s, d)), 6)


@query("q_model_means", f"WITH {FXS} SELECT model, prep, hpo, round(SUM(value) / (SELECT COUNT(DISTINCT dataset) FROM fxc), 6) AS mean FROM fxc GROUP BY ALL")
def q_model_means(s, d):
    return plain(study.model_means(fx_scores(s, d)), 6)


SPEARMAN = f"""{FXS}, a AS (SELECT dataset, model, {_stage('none', 'default')} AS x, {_stage('tta', 'extensive')} AS z FROM fxc GROUP BY ALL)"""


def _spearman(rows: str) -> str:
    return f"""r AS (SELECT rank() OVER (ORDER BY x) + (COUNT(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY z) + (COUNT(*) OVER (PARTITION BY z) - 1) / 2.0::DOUBLE AS rz FROM ({rows}))
    SELECT round(corr(rx, rz), 9) AS spearman FROM r"""


def _two_regimes(s, d):
    return fx_scores(s, d).groupBy("dataset", "model").agg(study._cell("value", "none", "default").alias("x"), study._cell("value", "tta", "extensive").alias("z"))


@query("q_spearman", f"WITH {SPEARMAN}, {_spearman('SELECT x, z FROM a WHERE x IS NOT NULL AND z IS NOT NULL')}")
def q_spearman(s, d):
    return plain(study.spearman(_two_regimes(s, d), "x", "z"), 9)


@query("q_spearman_filled", f"WITH {SPEARMAN}, {_spearman('SELECT COALESCE(x, 0.5) AS x, COALESCE(z, 0.5) AS z FROM a')}")
def q_spearman_filled(s, d):
    return plain(study.spearman(_two_regimes(s, d), "x", "z", fill=0.5), 9)


@query("q_spearman_lines", f"WITH {FXL}, {_spearman('SELECT price AS x, qty AS z FROM fxl')}")
def q_spearman_lines(s, d):
    return plain(study.spearman(fx_lines(s, d), "price", "qty"), 9)


@query(
    "q_best_model",
    f"""WITH {FXS}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset, prep, hpo ORDER BY value DESC, model) AS rn FROM fxc WHERE model <> 'Auto')
    SELECT r.dataset, r.prep, r.hpo, r.model AS best_model, round(r.value, 3) AS best_single, round(a.value, 3) AS automl FROM r JOIN fxc a ON a.dataset = r.dataset AND a.prep = r.prep AND a.hpo = r.hpo AND a.model = 'Auto' WHERE rn = 1""",
)
def q_best_model(s, d):
    return study.best_model(fx_scores(s, d), AUTO)


@query("q_near_best", f"WITH {FXS} SELECT dataset, model, prep, hpo, round(value, 6) AS value, (value > MAX(value) OVER (PARTITION BY dataset, prep, hpo) - 0.01)::INTEGER AS is_near_best FROM fxc")
def q_near_best(s, d):
    return plain(study.near_best(fx_scores(s, d)), 6)


COMBOS = f"""{FXS}, cb AS (SELECT dataset, prep, hpo, s.s AS selection, round(MAX(value) FILTER (WHERE s.s = 1 OR model = 'Base'), 4) AS value FROM fxc CROSS JOIN (VALUES (0), (1)) s(s) GROUP BY ALL),
gr AS (SELECT d.dataset, p.p AS prep, h.h AS hpo, s.s AS selection FROM (SELECT DISTINCT dataset FROM fxc) d, (VALUES ('none'), ('fe'), ('tta')) p(p), (VALUES ('default'), ('light'), ('extensive')) h(h), (VALUES (0), (1)) s(s))"""


@query("q_gain_combos", f"WITH {COMBOS} SELECT gr.*, cb.value FROM gr LEFT JOIN cb USING (dataset, prep, hpo, selection)")
def q_gain_combos(s, d):
    return study.gain_combos(fx_scores(s, d), BASE)


@query(
    "q_gain_edges",
    f"""WITH {COMBOS}, nd AS (SELECT list_position(['none', 'fe', 'tta'], prep) AS p, list_position(['default', 'light', 'extensive'], hpo) AS h, selection AS s, concat_ws('/', prep, hpo, selection::VARCHAR) AS node,
      round(100 - SUM(CAST(value * 100 AS DECIMAL(12,2)))::DOUBLE / COUNT(value), 1) AS v FROM cb GROUP BY ALL)
    SELECT a.node AS src, b.node AS dst, round(a.v - b.v, 3) AS gain FROM nd a JOIN nd b ON b.p >= a.p AND b.h >= a.h AND b.s >= a.s AND b.p + b.h + b.s = a.p + a.h + a.s + 1""",
)
def q_gain_edges(s, d):
    return study.gain_edges(study.gain_combos(fx_scores(s, d), BASE))


@query(
    "q_design_matrix",
    f"""WITH {FXS}, b AS (SELECT dataset, prep, hpo, MAX(value) AS top FROM fxc WHERE model <> 'Base' GROUP BY ALL)
    SELECT f.dataset, f.model, round(f.value, 6) AS target, (f.hpo = 'default')::INTEGER AS "default", (f.hpo = 'light')::INTEGER AS light, (f.hpo = 'extensive')::INTEGER AS extensive,
      (f.prep <> 'none')::INTEGER AS feature_engineering, (f.prep = 'tta')::INTEGER AS test_time_adaptation, CASE WHEN f.model = 'Base' THEN -1 ELSE (f.value = b.top)::INTEGER END AS model_selection
    FROM fxc f JOIN b USING (dataset, prep, hpo)""",
)
def q_design_matrix(s, d):
    return plain(study.design_matrix(fx_scores(s, d), BASE), 6)


FACTORS = ["light", "extensive", "feature_engineering", "test_time_adaptation", "model_selection"]


@query(
    "fixed_effects",
    "SELECT factor, 1 AS p_in_bounds, 1 AS orthogonal FROM (VALUES " + ", ".join(f"('{f}')" for f in FACTORS) + ") f(factor)",
)
def fixed_effects(s, d):
    """Every factor with its p-value inside 0 and 1 and the residuals, centred by dataset, orthogonal to it."""
    design = study.design_matrix(fx_scores(s, d), BASE)
    found = study.fixed_effects(design, FACTORS).collect()
    means = design.groupBy("dataset").agg(*[F.avg(c).alias(f"m_{c}") for c in ["target", *FACTORS]])
    centred = design.join(means, "dataset").select(*[(F.col(c) - F.col(f"m_{c}")).alias(c) for c in ["target", *FACTORS]])
    rest = F.col("target") - sum((F.lit(r.effect) * F.col(r.factor) for r in found), F.lit(0.0))
    tests = [F.struct(F.lit(r.factor).alias("factor"), F.lit(int(0 <= r.p_value <= 1)).alias("p_in_bounds"), (F.abs(F.sum(rest * F.col(r.factor))) < 1e-6).cast("int").alias("orthogonal")) for r in found]
    return centred.agg(F.array(*tests).alias("t")).select(F.inline("t"))


@query("q_score_histogram", f"WITH {FXS} SELECT prep, hpo, CAST(least(floor(value * 50), 49) AS INTEGER) AS bin, COUNT(*) AS n FROM fxc GROUP BY ALL")
def q_score_histogram(s, d):
    return study.histogram(fx_scores(s, d), ["prep", "hpo"], "value", 50)


def _density(rows: str, by: str, bins: int) -> str:
    """Kernel density in SQL: linear bins between three bandwidths beyond the ends, a normal kernel over all bins."""
    return f"""v AS ({rows}), st AS (SELECT {by}, COUNT(*) AS n, MIN(x) AS lo, MAX(x) AS hi, stddev_samp(x) * pow(COUNT(*), -0.2) AS h FROM v GROUP BY ALL HAVING COUNT(*) > 1 AND MIN(x) < MAX(x)),
    gr AS (SELECT *, lo - 3 * h AS a, (hi - lo + 6 * h) / {bins - 1} AS step FROM st), b AS (SELECT {by}, n, h, a, step, floor((x - a) / step) AS j, (x - a) / step - floor((x - a) / step) AS f FROM v JOIN gr USING ({by})),
    w AS (SELECT {by}, n, h, a, step, j, SUM(m) AS m FROM (SELECT * EXCLUDE f, 1 - f AS m FROM b UNION ALL SELECT * EXCLUDE (f, j), j + 1 AS j, f AS m FROM b) GROUP BY ALL)
    SELECT {by}, i::INTEGER AS bin, round(a + i * step, 6) AS x, round(SUM(m * exp(-0.5 * pow((i - j) * step / h, 2))) / (n * sqrt(2 * pi())) * step / h, 9) AS mass FROM w CROSS JOIN range(0, {bins}) r(i) GROUP BY {by}, i, n, h, a, step"""


@query("q_score_density", f"WITH {FXS}, {_density('SELECT prep, hpo, value::DOUBLE AS x FROM fxc WHERE value IS NOT NULL', 'prep, hpo', 100)}")
def q_score_density(s, d):
    return _mass(study.density(fx_scores(s, d), ["prep", "hpo"], "value", 100), ["prep", "hpo"])


@query("q_price_density", f"WITH {_density('SELECT l_returnflag, l_linestatus, l_extendedprice AS x FROM lineitem', 'l_returnflag, l_linestatus', 200)}")
def q_price_density(s, d):
    by = ["l_returnflag", "l_linestatus"]
    return _mass(study.density(table(s, d, "lineitem"), by, "l_extendedprice", 200), by)


def _mass(found, by):
    return plain(found.select(*by, "bin", F.round("x", 6).alias("x"), F.round(F.col("density") * F.col("step"), 9).alias("mass")))


@query(
    "random_intercept",
    "SELECT factor, 1 AS orthogonal, 1 AS best_ratio FROM (VALUES ('intercept'), " + ", ".join(f"('{f}')" for f in FACTORS) + ") f(factor)",
)
def random_intercept(s, d):
    """Every factor, whether the residuals, weighted by the fitted variances, are orthogonal to it, and whether the variances beat neighbouring ones.

    With the ratio r of the variances the weighted residual of a row is its residual minus r n / (1 + r n) times the mean residual of its dataset.
    """
    design = study.design_matrix(fx_scores(s, d), BASE).withColumn("intercept", F.lit(1.0))
    found = study.random_intercept(design, FACTORS).collect()
    ratio = found[0].var_dataset / found[0].var_residual
    near = study.reml(study.intercept_moments(design, FACTORS), FACTORS, [ratio, ratio * 1.05, ratio / 1.05, ratio + 0.01])
    best = int(min(near, key=lambda fit: fit.criterion).ratio == ratio)
    rest = F.col("target") - sum((F.lit(r.effect) * F.col(r.factor) for r in found), F.lit(0.0))
    rows = design.dropna(subset=["target"]).withColumn("_r", rest)
    sums = rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.sum("_r").alias("t"), *[F.sum(F.col(r.factor) * F.col("_r")).alias(f"xr_{r.factor}") for r in found], *[F.sum(r.factor).alias(f"x_{r.factor}") for r in found])
    shrink = ratio / (1 + ratio * F.col("n"))
    tests = [F.struct(F.lit(r.factor).alias("factor"), (F.abs(F.sum(F.col(f"xr_{r.factor}") - shrink * F.col(f"x_{r.factor}") * F.col("t"))) < 1e-6).cast("int").alias("orthogonal"), F.lit(best).alias("best_ratio")) for r in found]
    return sums.agg(F.array(*tests).alias("t")).select(F.inline("t"))


@query(
    "q_adtm",
    f"""WITH {FXB}, b AS (SELECT CASE WHEN private > 9900 THEN private * 4 ELSE private END::DOUBLE AS v FROM fxboard), q AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM b),
    m AS (SELECT MIN(v) AS lo, MAX(v) AS hi FROM b, q WHERE v >= q.a - 1.5 * (q.b - q.a) AND v <= q.b + 1.5 * (q.b - q.a)) SELECT s_suppkey, round((private_score::DOUBLE - lo) / (hi - lo), 9) AS adtm FROM fxentry CROSS JOIN m""",
)
def q_adtm(s, d):
    v = F.col("private")
    board = fx_board(s, d).select(F.when(v > 9900, v * 4).otherwise(v).cast("double").alias("v"))
    return plain(study.adtm(fx_entries(s, d).select("s_suppkey", "private_score"), board, "private_score", "v").drop("private_score"), 9)


@query(
    "q_regime_uplift",
    f"""WITH {FXS}, b AS (SELECT dataset, {_stage('fe', 'extensive')} AS x, {_stage('tta', 'extensive')} AS z FROM fxc WHERE model IN ('Net', 'Linear') AND dataset IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_5') GROUP BY 1)
    SELECT round(AVG(x), 6) AS before, round(AVG(z), 6) AS after, round(AVG(z) - AVG(x), 6) AS uplift FROM b""",
)
def q_regime_uplift(s, d):
    out = study.regime_uplift(fx_scores(s, d), ["Net", "Linear"], "extensive", "fe", "tta", ["NATION_1", "NATION_2", "NATION_3", "NATION_5"])
    return plain(out, 6)


@query("q_coalesce_regime", f"WITH {FXS} SELECT f.dataset, f.model, f.hpo, round(COALESCE(t.value, f.value), 6) AS value FROM (SELECT * FROM fxc WHERE prep = 'fe') f LEFT JOIN (SELECT * FROM fxc WHERE prep = 'tta') t USING (dataset, model, hpo)")
def q_coalesce_regime(s, d):
    scores = fx_scores(s, d)
    return plain(study.coalesce_regime(scores.where("prep = 'tta'").drop("prep"), scores.where("prep = 'fe'").drop("prep"), ["dataset", "model", "hpo"]), 6)


@query("q_tail_std", f"WITH {FXB}, q AS (SELECT quantile_cont(private::DOUBLE, 0.99) AS q FROM fxboard) SELECT round(stddev_samp(private::DOUBLE), 6) AS tail_std FROM fxboard, q WHERE private::DOUBLE > q")
def q_tail_std(s, d):
    return plain(study.tail_std(fx_board(s, d), "private"), 6)


# --- R: chains ---------------------------------------------------------------------------------------------------------------

SERIES = ["s0", "s1", "s2", "s3", "s4", "s5"]
FXM = FXG + """, fxm AS (SELECT sid * 100000 + w AS id, """ + ", ".join(f"COALESCE(LAG(sales, {i}) OVER (PARTITION BY sid ORDER BY w), 0) AS s{i}" for i in range(6)) + " FROM fxg WHERE sales IS NOT NULL)"


def _matrix(s, d, width=len(SERIES)):
    """One row per supplier and week holding this and the weeks before: row t + 1 is row t shifted.

    Weeks and grid are written first, since the grid reads the weeks and the lags read the grid more than once.
    """
    weekly = stored(fx_weekly(s, d).select("sid", "w", "sold"), "weeks")
    grid = stored(fx_grid(s, d, weekly).select("sid", "w", "sales").where("sales is not null"), "grid")
    wide = lags(grid, ["sid"], ["w"], "sales", list(range(1, width)), dense=True)
    return wide.select(
        (F.col("sid") * 100000 + F.col("w")).alias("id"),
        *[F.coalesce(F.col("sales" if i == 0 else f"sales_lag_{i}"), F.lit(0)).cast("decimal(18,2)").alias(f"s{i}") for i in range(width)],
    )


def _tuple(cols) -> str:
    return "concat_ws('|', " + ", ".join(f"{c}::VARCHAR" for c in cols) + ")"


EDGES = FXM + f""", h1 AS (SELECT id, {_tuple(SERIES[:-1])} AS h FROM fxm QUALIFY COUNT(*) OVER (PARTITION BY h) = 1), h2 AS (SELECT id, {_tuple(SERIES[1:])} AS h FROM fxm QUALIFY COUNT(*) OVER (PARTITION BY h) = 1),
ed AS (SELECT h1.id AS src, h2.id AS dst FROM h1 JOIN h2 USING (h) WHERE h1.id <> h2.id)"""


@query("q_link_edges", f"WITH {EDGES} SELECT src, dst FROM ed")
def q_link_edges(s, d):
    return chains.link_edges(_matrix(s, d), [SERIES], "id")


def _event_edges(s, d):
    rows = table(s, d, "events").select("event_id", "user_id", "ts")
    linked = lags(rows, ["user_id"], ["ts", "event_id"], "event_id", [1]).where("event_id_lag_1 is not null")
    return linked.select(F.col("event_id_lag_1").alias("src"), F.col("event_id").alias("dst"))


@query(
    "chain_paths",
    "SELECT first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS chain, event_id AS node, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position FROM events QUALIFY COUNT(*) OVER (PARTITION BY user_id) > 1",
)
def chain_paths(s, d):
    return chains.chain_paths(_event_edges(s, d)).select("chain", "node", "position")


@query(
    "chain_paths_mixed",
    """WITH RECURSIVE n AS (SELECT COUNT(*) AS n FROM customer),
    e AS (SELECT c_custkey - 1 AS src, ((c_custkey - 1) * (c_custkey - 1) + 1) % n AS dst FROM customer, n WHERE c_custkey % 13 <> 0),
    nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
    walk AS (SELECT src AS node, dst AS spot FROM e UNION SELECT w.node, e.dst FROM walk w JOIN e ON e.src = w.spot),
    ring AS (SELECT node FROM walk WHERE node = spot), label AS (SELECT node, MIN(spot) AS low FROM walk JOIN ring USING (node) GROUP BY node),
    cut AS (SELECT e.src, e.dst FROM e LEFT JOIN label a ON a.node = e.src LEFT JOIN label b ON b.node = e.dst WHERE b.node IS NULL OR (a.node IS NOT NULL AND e.dst <> b.low)),
    path AS (SELECT node AS chain, node, 0::BIGINT AS position FROM nodes WHERE node NOT IN (SELECT dst FROM cut) UNION ALL SELECT p.chain, c.dst, p.position + 1 FROM path p JOIN cut c ON c.src = p.node),
    best AS (SELECT * FROM path QUALIFY row_number() OVER (PARTITION BY node ORDER BY position DESC, chain) = 1),
    ended AS (SELECT DISTINCT a.chain FROM e JOIN best a ON a.node = e.src JOIN best b ON b.node = e.dst WHERE a.chain <> b.chain)
    SELECT chain, node, position, node IN (SELECT node FROM ring) AS cycle, chain IN (SELECT chain FROM ended) AS overlapped FROM best""",
)
def chain_paths_mixed(s, d):
    """Customers linked by squaring their number: chains that meet, cycles, chains that run into cycles, chains that end."""
    rows = with_scalars(table(s, d, "customer").select("c_custkey"), table(s, d, "customer"), {"n": F.count(F.lit(1))})
    src = F.col("c_custkey") - 1
    edges = rows.where("c_custkey % 13 <> 0").select(src.alias("src"), ((src * src + 1) % F.col("_s.n")).alias("dst"))
    return chains.chain_paths(edges)


@query(
    "find_column_chains",
    f"""WITH RECURSIVE {FXO}, t AS (SELECT date_diff('day', DATE '1995-01-01', odate) // 7 AS w, SUM(total)::DOUBLE AS t FROM fxo GROUP BY 1),
    cells AS (SELECT c.c, r.r, COALESCE(t.t, 0) AS x FROM (SELECT UNNEST(range(0, (SELECT MAX(w) FROM t) + 1)) AS c) c CROSS JOIN range(0, 24) r(r) LEFT JOIN t ON t.w = c.c + r.r),
    k AS (SELECT c, list(x ORDER BY r) FILTER (r < 23) AS h, list(x ORDER BY r) FILTER (r > 0) AS g FROM cells GROUP BY c),
    e AS (SELECT a.c AS src, b.c AS dst FROM (SELECT c, h FROM k QUALIFY COUNT(*) OVER (PARTITION BY h) = 1) a JOIN (SELECT c, g FROM k QUALIFY COUNT(*) OVER (PARTITION BY g) = 1) b ON a.h = b.g WHERE a.c <> b.c),
    path AS (SELECT src AS chain, src AS node, 0::BIGINT AS position FROM e WHERE src NOT IN (SELECT dst FROM e) UNION ALL SELECT p.chain, e.dst, p.position + 1 FROM path p JOIN e ON e.src = p.node)
    SELECT 'c' || chain AS chain, 'c' || node AS node, position FROM path QUALIFY COUNT(*) OVER (PARTITION BY chain) >= 40""",
)
def find_column_chains(s, d):
    """Chains among the columns of a lag matrix of all sales: column c is column c + 1 one row later."""
    week = F.floor(F.datediff("odate", F.lit("1995-01-01").cast("date")) / 7).cast("int")
    weekly = fx_orders(s, d).groupBy(week.alias("w")).agg(F.sum("total").cast("double").alias("t"))
    weeks = weekly.agg(F.max("w")).first()[0] + 1  # one column per week of the calendar
    rolled = weekly.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(23)))).withColumn("col", F.col("w") - F.col("row"))
    matrix = rolled.groupBy("row").pivot("col", list(range(weeks))).agg(F.max("t")).na.fill(0.0)
    names = [f"c{i}" for i in range(weeks)]
    return shifts.column_chains(matrix.toDF("row", *names), "row", names, min_len=40)


OFFSETS = [2, 3, 4]


def _offset(o: int) -> str:
    return (
        f"a{o} AS (SELECT id, {_tuple(SERIES[:-o])} AS h FROM fxm QUALIFY COUNT(*) OVER (PARTITION BY h) = 1), "
        f"b{o} AS (SELECT {_tuple(SERIES[o:])} AS h, s{o - 2} AS v FROM fxm WHERE s{o - 2} <> 0 QUALIFY COUNT(*) OVER (PARTITION BY h) = 1), v{o} AS (SELECT a.id, b.v FROM a{o} a JOIN b{o} b USING (h))"
    )


FAR = 40
LOOKUP = f"""WITH {FXG}, m AS (SELECT sid * 100000 + w AS id, [{", ".join(f"COALESCE(LAG(sales, {i}) OVER (PARTITION BY sid ORDER BY w), 0)" for i in range(FAR))}] AS a FROM fxg WHERE sales IS NOT NULL),
    x AS (SELECT id, o, md5(a[1:{FAR} - o]::VARCHAR) AS h, md5(a[o + 1:{FAR}]::VARCHAR) AS g, a[o - 1] AS v FROM m CROSS JOIN range(2, {FAR - 1}) r(o)),
    s AS (SELECT id, o, h FROM x QUALIFY COUNT(*) OVER (PARTITION BY o, h) = 1), z AS (SELECT o, g, v FROM x WHERE v <> 0 QUALIFY COUNT(*) OVER (PARTITION BY o, g) = 1),
    hit AS (SELECT s.id, arg_min(z.v, o) AS v FROM s JOIN z USING (o) WHERE s.h = z.g GROUP BY 1)
    SELECT m.id, COALESCE(hit.v, 0)::DOUBLE AS looked_up FROM m LEFT JOIN hit USING (id)"""


def _lookup(s, d):
    """All offsets from 2 to 38 of forty weeks of sales, as the original looks them up."""
    series = [f"s{i}" for i in range(FAR)]
    return plain(shifts.offset_lookup(_matrix(s, d, FAR), [series], "id", list(range(2, FAR - 1))).select("id", "looked_up"))


@query("q_offset_lookup", LOOKUP)
def q_offset_lookup(s, d):
    return _lookup(s, d)


@query("q_offset_lookup_far", LOOKUP)
def q_offset_lookup_far(s, d):
    return _lookup(s, d)
