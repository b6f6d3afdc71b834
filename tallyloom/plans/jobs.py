"""End-to-end feature jobs: compositions of the operators over a table with a ``split`` column.

Each job is ``DataFrame (+ scope) -> DataFrame`` and is planned by Spark as one query, apart from the
small profile jobs that fitted operators run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.core import stored
from tallyloom.functions import metrics, scalar
from tallyloom.operators import chains, clean, encode, folds, group, impute, learn, post, profile, relate, rowwise, shifts, study, windows
from tallyloom.spec import SPLIT, TRAIN, TableSpec


def standardized(df: DataFrame, spec: TableSpec, scope: str = "train") -> DataFrame:
    """The minimal preparation: binary levels to 0/1, known domains, mean fill, no constants, log target."""
    two = profile.binary_cols(df, spec.cat)
    rest = [c for c in spec.cat if c not in two]
    out = clean.restrict_domain(encode.binary_encode(df, two).drop(*two), rest, scope)
    out = impute.impute_mean(out, spec.num, scope)
    out = profile.drop_constant(out, scope, [c for c in out.columns if c not in (*spec.key, SPLIT, spec.target)])
    return impute.transform_target(out, spec.target, "log1p") if spec.heavy_tailed else out


def entity_features(df: DataFrame, scope: str = "all") -> DataFrame:
    """Transactions with a synthetic client key: frequency, mean/std and distinct-count features per key.

    Requests that share a key share one aggregation, and all of them are learned from ``base``, the
    rows before any feature was joined.
    """
    base = scalar.entity_id(df, ["o_custkey", "segment"], "day", "age")
    base = scalar.concat_pair(scalar.subtract_elapsed(base, ["age"], "secs"), "nation", "segment")
    base = scalar.date_parts(base, "odate", ["month", "weekday"])
    out = scalar.flag(base, "big_urgent", (F.col("total") > 300000) & (F.col("priority") == "1-URGENT"))
    out = scalar.fraction(out, "total", "cents")
    out = group.freq_encode(out, ["nation", "nation_segment", "uid"], scope, base)
    keys = [["nation"], ["nation_segment"], ["o_custkey"], ["uid"]]
    wanted = [("total", ks, ["mean", "std"]) for ks in keys] + [("age", ["o_custkey"], ["mean"])]
    out = group.group_encode(out, wanted, scope, source=base)
    out = group.group_nunique(out, ["o_custkey"], ["priority", "odate_month"], scope, base)
    out = encode.label_encode(out, ["priority", "nation_segment"], scope, base)
    out = impute.shift_nonnegative(out, ["age"], scope, base)
    return out.drop("secs", "day", "nation", "segment", "nation_segment", "priority", "odate", "total")


def demand_grid(grid: DataFrame, weekly: DataFrame, key_sets: Sequence[Sequence[str]], hide: Column, ranges, first: int) -> DataFrame:
    """Dense period grid: release filter, price ratios, lags, rolling windows, target encodings, time folds.

    Grid and weeks are written first, since every part of the job reads them.
    """
    grid, weekly = stored(grid, "grid"), stored(weekly, "weekly")
    released = weekly.groupBy("sid").agg((F.min("w") + 2).alias("release"))
    unit = F.try_divide(F.col("revenue").cast("double"), F.col("sold").cast("double"))
    priced = group.norm_by(weekly.withColumn("unit", unit), ["sid"], "unit", "max")
    priced = windows.momentum(priced, ["sid"], ["w"], "unit").select("sid", "w", "unit_over_sid_max", "unit_momentum")
    out = windows.lags(grid, ["sid"], ["w"], "sales", [4, 8], dense=True)
    rolled = windows.rolling(grid.select("sid", "w", "sales"), ["sid"], ["w"], "sales", [4], [4, 13], ["mean", "std"], dense=True).drop("sales")
    # a compressed file says little about the rows in it, so neither side is sent to every task on its account
    out = relate.left_join(relate.left_join(out, rolled.hint("merge"), ["sid", "w"]), priced.hint("merge"), ["sid", "w"])
    out = encode.mean_std_encode(out, key_sets, "sales", hide, grid)
    out = relate.join_where(out, released, ["sid"], F.col("w") >= F.col("release")).drop("release")
    return folds.time_folds(out, "w", ranges, first)


def access_counts(df: DataFrame, cats: Sequence[str], resource: str, scope: str = "all") -> DataFrame:
    """All-categorical rows: log counts, shares of a resource, distinct resources, pair counts."""
    return group.access_pack(df, cats, resource, scope, df)


def uniqueness(df: DataFrame, cols: Sequence[str], y: str, key: str, scope: str = "all") -> DataFrame:
    """Codes for repeated values and shared-value copies of anonymous numeric columns, and real-row flags."""
    coded = encode.uniqueness_pattern(df, cols, y, key, scope)
    shared = encode.unique_to_mean(df, cols, y, key, scope).select(key, *[f"{c}_shared" for c in cols])
    return encode.real_rows(relate.glue([coded, shared], [key]), cols, key)


def row_profile(df: DataFrame, cols: Sequence[str], band: str, value: str, target: str) -> DataFrame:
    """Sparse wide rows: zero and value counts, percentile of a value in neighbouring bands, ratios, modulo flags."""
    out = rowwise.count_zero(df, cols)
    out = rowwise.count_value(out, cols, [3, 6, 9])
    out = windows.ecdf_band(windows.ecdf(out, band, value), band, value, 1)
    out = scalar.ratios(out, [(f"{a}_per_{b}", a, b) for a, b in zip(cols, cols[1:])])
    out = rowwise.mod_flags(out, cols, 3)
    return profile.drop_low_support(out, target, [f"{c}_mod3" for c in cols])


def combo_levels(df: DataFrame, cats: Sequence[str], nums: Sequence[str], y: str, fold: str) -> DataFrame:
    """Level combinations and number steps, label encoded, then out-of-fold target means."""
    combined = scalar.concat_r(df, cats, 2)
    pairs = [c for c in combined.columns if c not in df.columns]
    levelled = scalar.truncate_level(scalar.pair_sum(combined, nums), nums, 0.001)
    levels = [*pairs, *[f"{n}_level" for n in nums]]
    coded = encode.label_encode(levelled, levels, source=levelled)
    return encode.target_mean_oof(coded, levels, y, fold, levelled)


def group_stats(df: DataFrame, targets: Sequence[str], groups: Sequence[str], token: str, scope: str = "all") -> DataFrame:
    """Statistics of every target by every group, counts of the combined level, products and ratios.

    The rows are written first, since every set of statistics reads them.
    """
    df = stored(df, "grouped")
    out = group.concat_count(df, token, scope)
    out = group.stats_pack(out, targets, groups, scope, source=df)
    out = encode.count_encode(out, groups, scope, df)
    return scalar.pair_product_ratio(out, targets)


def property_clean(df: DataFrame, scope: str = "all") -> DataFrame:
    """Repair, flag and fill property records, then densities and area statistics; the rows are written first."""
    df = stored(df, "properties")
    out = clean.missing_flags(df, ["size"])
    out = clean.repair(out, [("floor", F.col("top") < F.col("floor"), F.col("top")), ("size", F.col("size") > 45, F.lit(None).cast("double"))])
    out = impute.impute_cascade(out, ["size"], [["brand", "kind"], ["brand"]])
    out = scalar.ratios(out, [("price_per_size", "price", "size"), ("floor_share", "floor", "top")], on_bad=None)
    return group.stats_by(out, "brand", "price", scope, df)


def chain_lookup(df: DataFrame, series: Sequence[str], key: str, offsets: Sequence[int]) -> DataFrame:
    """Rows that continue each other: chain number and position, values read along the chain, row statistics.

    The rows are written first, since links, lookups and statistics read them; statistics come last, so no join moves them.
    """
    df = stored(df, "series")
    path = chains.chain_paths(chains.link_edges(df, [series], key)).select("chain", F.col("node").alias(key), "position")
    out = relate.left_join(shifts.offset_lookup(df, [series], key, offsets), path, [key])
    out = rowwise.first_last_nonzero(rowwise.log_mean(rowwise.nonzero_stats(out, {"all": series}), series), series)
    return out.select(key, *[c for c in out.columns if c not in (key, "chain", "position")], "chain", "position")


def study_summary(scores: DataFrame, base: str, automl: str) -> DataFrame:
    """Per dataset: best single model, automatic tool, gain over the default base model, cells near the best."""
    best = study.best_model(scores, automl).where("prep = 'fe' and hpo = 'extensive'").select("dataset", "best_model", "best_single", "automl")
    combos = study.gain_combos(scores, base)
    ends = combos.groupBy("dataset").agg(
        F.max(F.when((F.col("prep") == "none") & (F.col("hpo") == "default") & (F.col("selection") == 0), F.col("value"))).alias("start"),
        F.max(F.when((F.col("prep") == "fe") & (F.col("hpo") == "extensive") & (F.col("selection") == 1), F.col("value"))).alias("end"),
    )
    close = study.near_best(scores).groupBy("dataset").agg(F.sum("is_near_best").alias("near_best_cells"))
    return relate.glue([best, ends.withColumn("gain", F.round(F.col("end") - F.col("start"), 4)), close], ["dataset"])




def experiment(
    df: DataFrame, spec: TableSpec, features: Sequence[str], trials: int, seed: int, k: int, best: int = 10,
    space: dict | None = None, trainer: learn.Trainer = learn.TREES,
) -> DataFrame:
    """From rows with folds to final predictions (key, split, pred) of all rows, in the target's own scale.

    Drawn parameter sets are fitted per fold, the best trials of each fold are averaged where that beats the single
    best one, test rows take the mean over folds, and a heavy-tailed target is learned as its logarithm.
    """
    key, fn = list(spec.key), "log1p" if spec.heavy_tailed else "identity"
    rows = impute.transform_target(df, spec.target, fn)
    scores, preds = learn.random_search(rows, features, spec.target, spec.task, key, spec.metric, trials, seed, k, space, trainer)
    scores = stored(scores, "trials")
    score, direction = metrics.metric(spec.metric)
    truth = rows.where(F.col(SPLIT) == TRAIN).select(*key, F.col(spec.target).alias("y"))
    chosen = learn.topk_ensemble(scores, preds.join(truth, key), key, score, spec.metric, best)
    blended = learn.ensemble_preds(scores, preds, chosen, [*key, SPLIT], direction)
    return post.inverse_chain(learn.fold_average(blended, [*key, SPLIT]), "pred", [(fn, {})])
