"""Registered end-to-end jobs over the test tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tallyloom.catalog.encoders_and_folds import RANGES, UNI, UNI_COLS, _anonymous, _pattern
from tallyloom.catalog.fixtures import (
    AUTO, BASE, EPOCH, FXG, FXL, FXO, FXS, FXW, WIDE, fx_grid, fx_lines, fx_orders, fx_scores, fx_weekly, fx_wide, table,
)
from tallyloom.catalog.joins_and_groups import _pack, mean, std
from tallyloom.catalog.models_and_studies import EDGES, FEATURES, OFFSETS, SERIES, SMALL_SPACE, _matrix, _ml_rows, _offset
from tallyloom.catalog.registry import plain, query
from tallyloom.catalog.sequences_and_scalars import _rolled
from tallyloom.core import stored
from tallyloom.functions import metrics
from tallyloom.plans import jobs
from tallyloom.spec import FeatureJob, TableSpec

ORDERS = TableSpec(key=("o_orderkey",), target="total", cat=("seg_n", "nation", "is_f"), num=("bal_n", "acctbal"), heavy_tailed=True)


@query(
    "job_standardized",
    f"""WITH {FXO}, m AS (SELECT {mean('bal_n')} AS b, {mean('acctbal')} AS a FROM fxo WHERE split = 'train')
    SELECT o_orderkey, split, round(ln(1 + total::DOUBLE), 6) AS total, COALESCE(seg_n, 'nan') AS seg_n, nation, (status <> 'F')::INTEGER::DOUBLE AS is_f_bin,
      round(COALESCE(bal_n::DOUBLE, b), 6) AS bal_n, round(acctbal::DOUBLE, 6) AS acctbal FROM fxo CROSS JOIN m""",
)
def job_standardized(s, d):
    rows = fx_orders(s, d).select(
        "o_orderkey", "split", "total", "seg_n", "nation", F.when(F.col("status") == "F", "yes").otherwise("no").alias("is_f"),
        "bal_n", "acctbal", F.lit("same").alias("constant"),
    )
    return plain(jobs.standardized(rows, ORDERS), 6)


def _transactions(s, d):
    day = F.datediff("odate", F.lit(EPOCH).cast("date"))
    return fx_orders(s, d).select(
        "o_orderkey", "split", "y", "o_custkey", "nation", "segment", "priority", "total", "odate", day.alias("day"),
        (F.col("o_custkey") % 300).alias("age"), (day.cast("bigint") * 86400).alias("secs"),
    )


ENTITY_JOB = FeatureJob("entity_features", TableSpec(key=("o_orderkey",), target="y", task="binary", metric="auc"), _transactions, jobs.entity_features)


@query(
    "job_entity_features",
    f"""WITH {FXO}, x AS (SELECT o_orderkey, split, y, o_custkey, priority, total, odate, nation, nation || '_' || segment AS ns,
      date_diff('day', DATE '1995-01-01', odate) AS day, o_custkey % 300 AS age0, segment FROM fxo),
    z AS (SELECT *, concat_ws('_', o_custkey::VARCHAR, segment, (day - age0)::VARCHAR) AS uid, CAST(age0 - day AS BIGINT) AS age FROM x),
    an AS (SELECT nation, {mean('total')} AS m, {std('total')} AS sd, COUNT(*) AS n FROM z GROUP BY 1), ans AS (SELECT ns, {mean('total')} AS m, {std('total')} AS sd, COUNT(*) AS n FROM z GROUP BY 1),
    ac AS (SELECT o_custkey, {mean('total')} AS m, {std('total')} AS sd, {mean('age')} AS am, COUNT(DISTINCT priority) AS np, COUNT(DISTINCT month(odate)) AS nm FROM z GROUP BY 1),
    au AS (SELECT uid, {mean('total')} AS m, {std('total')} AS sd, COUNT(*) AS n FROM z GROUP BY 1), t AS (SELECT COUNT(*) AS n, MIN(age) AS age FROM z)
    SELECT o_orderkey, split, y, z.o_custkey, z.uid, z.age - t.age AS age, month(odate)::INTEGER AS odate_month, (isodow(odate) - 1)::INTEGER AS odate_weekday,
      (total > 300000 AND priority = '1-URGENT')::INTEGER AS big_urgent, (total - floor(total))::DOUBLE AS cents,
      an.n::DOUBLE / t.n AS nation_freq, ans.n::DOUBLE / t.n AS nation_segment_freq, au.n::DOUBLE / t.n AS uid_freq,
      an.m AS total_nation_mean, an.sd AS total_nation_std, ans.m AS total_nation_segment_mean, ans.sd AS total_nation_segment_std,
      ac.m AS total_o_custkey_mean, ac.sd AS total_o_custkey_std, au.m AS total_uid_mean, au.sd AS total_uid_std, ac.am AS age_o_custkey_mean,
      ac.np AS priority_o_custkey_nunique, ac.nm AS odate_month_o_custkey_nunique,
      dense_rank() OVER (ORDER BY priority) - 1 AS priority_code, dense_rank() OVER (ORDER BY z.ns) - 1 AS nation_segment_code
    FROM z CROSS JOIN t JOIN an USING (nation) JOIN ans ON ans.ns = z.ns JOIN ac ON ac.o_custkey = z.o_custkey JOIN au ON au.uid = z.uid""",
)
def job_entity_features(s, d):
    return plain(ENTITY_JOB.run(s, d))


GRID_KEYS = [["sid"], ["nation"], ["regionkey"]]


@query(
    "job_demand_grid",
    f"""WITH {FXG}, x AS (SELECT *, CASE WHEN NOT (w > 300) THEN sales END AS v FROM fxg), u AS (SELECT sid, w, revenue::DOUBLE / sold::DOUBLE AS unit FROM fxs),
    p AS (SELECT sid, w, unit / MAX(unit) OVER (PARTITION BY sid) AS a, unit / NULLIF(LAG(unit) OVER (PARTITION BY sid ORDER BY w), 0) AS b FROM u), r AS (SELECT sid, MIN(w) + 2 AS release FROM fxs GROUP BY 1),
    {", ".join(f"e{i} AS (SELECT {', '.join(ks)}, {mean('v')} AS m, {std('v')} AS sd FROM x GROUP BY ALL)" for i, ks in enumerate(GRID_KEYS))},
    g AS (SELECT *, LAG(sales, 4) OVER (PARTITION BY sid ORDER BY w)::DOUBLE AS l4, LAG(sales, 8) OVER (PARTITION BY sid ORDER BY w)::DOUBLE AS l8, {", ".join(_rolled(4, w, a) for w in (4, 13) for a in ("mean", "std"))} FROM x),
    f AS (SELECT * FROM (VALUES {", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(RANGES))}) t(fold, a, b))
    SELECT g.sid, g.w, g.sales::DOUBLE AS sales, l4 AS sales_lag_4, l8 AS sales_lag_8, sales_mean_4_4, sales_std_4_4, sales_mean_4_13, sales_std_4_13, p.a AS unit_over_sid_max, p.b AS unit_momentum,
      {", ".join(f"e{i}.m AS enc_{ks[0]}_mean, e{i}.sd AS enc_{ks[0]}_std" for i, ks in enumerate(GRID_KEYS))}, fold, CASE WHEN g.w BETWEEN 100 AND f.a THEN 'train' ELSE 'val' END AS role
    FROM g JOIN r ON r.sid = g.sid AND g.w >= r.release LEFT JOIN p ON p.sid = g.sid AND p.w = g.w {" ".join(f"JOIN e{i} ON e{i}.{ks[0]} = g.{ks[0]}" for i, ks in enumerate(GRID_KEYS))}
    JOIN f ON g.w BETWEEN 100 AND f.a OR (g.w > f.a AND g.w <= f.b)""",
)
def job_demand_grid(s, d):
    out = jobs.demand_grid(fx_grid(s, d), fx_weekly(s, d), GRID_KEYS, F.col("w") > 300, RANGES, 100)
    return plain(out.drop("nation", "regionkey"))


ACCESS = ["part50", "l_suppkey", "flag", "ls"]


@query(
    "job_access_counts",
    f"WITH {FXL}, x AS (SELECT l_orderkey, l_linenumber, l_partkey % 50 AS part50, l_suppkey, flag, ls FROM fxl) SELECT l_orderkey, l_linenumber, part50, l_suppkey, "
    + ", ".join(f"round(ln(1 + COUNT(*) OVER (PARTITION BY {c})), 6) AS {c}_log_count" for c in ACCESS) + ", "
    + ", ".join(f"round(COUNT(*) OVER (PARTITION BY {c}, flag)::DOUBLE / COUNT(*) OVER (PARTITION BY {c}), 6) AS {c}_flag_share" for c in ACCESS if c != "flag") + ", "
    + ", ".join(f"COUNT(*) OVER (PARTITION BY {a}, {b}) AS {a}_{b}_n, round(ln(1 + COUNT(*) OVER (PARTITION BY {a}, {b})), 6) AS {a}_{b}_log" for a, b in combinations(ACCESS, 2))
    + " FROM x",
)
def job_access_counts(s, d):
    rows = fx_lines(s, d).select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 50).alias("part50"), "l_suppkey", "flag", "ls", "split")
    return plain(jobs.access_counts(rows, ACCESS, "flag").drop("flag", "ls", "split"), 6)


@query(
    "job_uniqueness",
    f"WITH {UNI}, m AS (SELECT AVG(v0) AS v0, AVG(v1) AS v1 FROM x WHERE split = 'train'), " + ", ".join(
        f"t_{c} AS (SELECT {c}, COUNT(*) FILTER (WHERE y = 1) AS n1, COUNT(*) FILTER (WHERE y = 0) AS n0 FROM x WHERE split = 'train' GROUP BY 1), r_{c} AS (SELECT {c}, COUNT(*) AS n FROM rf GROUP BY 1)" for c in UNI_COLS
    ) + f" SELECT o_orderkey, split, y, {', '.join(_pattern(c) for c in UNI_COLS)}, "
    + ", ".join(f"round(CASE WHEN COALESCE(r_{c}.n, 0) >= 2 THEN x.{c} ELSE m.{c} END, 6) AS {c}_shared" for c in UNI_COLS)
    + ", CASE WHEN split = 'test' THEN (o_orderkey IN (SELECT o_orderkey FROM u))::INTEGER END AS is_real FROM x CROSS JOIN m "
    + " ".join(f"LEFT JOIN t_{c} ON t_{c}.{c} = x.{c} LEFT JOIN r_{c} ON r_{c}.{c} = x.{c}" for c in UNI_COLS),
)
def job_uniqueness(s, d):
    return plain(jobs.uniqueness(_anonymous(s, d), UNI_COLS, "y", "o_orderkey").drop(*UNI_COLS), 6)


def _share(k: int) -> str:
    return f"""(SELECT centre, b, t, rk / MAX(rk) OVER (PARTITION BY centre) AS p FROM (SELECT centre, b, t, rank() OVER (PARTITION BY centre ORDER BY t) + (COUNT(*) OVER (PARTITION BY centre, t) - 1) / 2.0::DOUBLE AS rk
      FROM (SELECT DISTINCT b AS centre FROM x) c JOIN x ON abs(x.b - c.centre) <= {k}))"""


PAIRED = list(zip(WIDE, WIDE[1:]))


@query(
    "job_row_profile",
    f"""WITH {FXW}, x AS (SELECT fxw.*, o_orderkey % 100 AS b, CAST(o_totalprice AS DECIMAL(12,2)) AS t, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM fxw JOIN orders ON o_orderkey = l_orderkey),
    e0 AS (SELECT DISTINCT centre, t, p FROM {_share(0)} WHERE b = centre), e1 AS (SELECT DISTINCT centre, t, p FROM {_share(1)} WHERE b = centre)
    SELECT l_orderkey, CAST({" + ".join(f"(w{i} = 0)::INTEGER" for i in range(1, 8))} AS INTEGER) AS n_zero,
      {", ".join(f"CAST({' + '.join(f'(w{i} = {v})::INTEGER' for i in range(1, 8))} AS INTEGER) AS n_eq_{v}" for v in (3, 6, 9))},
      CAST({" + ".join(f"(w{i} IN (3, 6, 9))::INTEGER" for i in range(1, 8))} AS INTEGER) AS n_eq_any, e0.p AS t_ecdf, e1.p AS t_ecdf_1,
      {", ".join(f"COALESCE({a}::DOUBLE / NULLIF({b}::DOUBLE, 0), 0) AS {a}_per_{b}" for a, b in PAIRED)}, {", ".join(f"(w{i} % 3 = 0)::INTEGER AS w{i}_mod3" for i in range(1, 8))}
    FROM x JOIN e0 ON e0.centre = x.b AND e0.t = x.t JOIN e1 ON e1.centre = x.b AND e1.t = x.t""",
)
def job_row_profile(s, d):
    o = table(s, d, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 100).alias("b"), F.col("o_totalprice").cast("decimal(12,2)").alias("t"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"),
    )
    out = jobs.row_profile(fx_wide(s, d).join(o, "l_orderkey"), WIDE, "b", "t", "y")
    return out.drop(*WIDE, "split", "b", "t", "y")


COMBO = ["priority", "segment"]


def _combo_target(c: str) -> str:
    return f"round(COALESCE((l_{c}.t - COALESCE(f_{c}.t, 0)) / NULLIF(l_{c}.n - COALESCE(f_{c}.n, 0), 0), g.m), 6) AS {c}_target"


COMBO_COLS = ["priority_segment", "acctbal_level", "total_level"]


@query(
    "job_combo_levels",
    f"""WITH {FXO}, x AS (SELECT o_orderkey, split, CASE WHEN split = 'train' THEN hfold END AS fold, y, concat_ws('_', priority, segment) AS priority_segment,
      CAST(CAST(floor(acctbal::DOUBLE * 0.001::DOUBLE) AS BIGINT) AS VARCHAR) AS acctbal_level, CAST(CAST(floor(total::DOUBLE * 0.001::DOUBLE) AS BIGINT) AS VARCHAR) AS total_level, acctbal::DOUBLE + total::DOUBLE AS acctbal_plus_total FROM fxo),
    tr AS (SELECT * FROM x WHERE split = 'train'), g AS (SELECT SUM(y)::DOUBLE / COUNT(*) AS m FROM tr),
    {", ".join(f"l_{c} AS (SELECT {c}, SUM(y)::DOUBLE AS t, COUNT(*) AS n FROM tr GROUP BY 1), f_{c} AS (SELECT {c}, fold, SUM(y)::DOUBLE AS t, COUNT(*) AS n FROM tr GROUP BY ALL)" for c in COMBO_COLS)}
    SELECT o_orderkey, x.priority_segment, x.acctbal_level, x.total_level, round(acctbal_plus_total, 6) AS acctbal_plus_total,
      {", ".join(f"dense_rank() OVER (ORDER BY x.{c}) - 1 AS {c}_code" for c in COMBO_COLS)}, {", ".join(_combo_target(c) for c in COMBO_COLS)}
    FROM x CROSS JOIN g {" ".join(f"LEFT JOIN l_{c} ON l_{c}.{c} = x.{c} LEFT JOIN f_{c} ON f_{c}.{c} = x.{c} AND f_{c}.fold = x.fold" for c in COMBO_COLS)}""",
)
def job_combo_levels(s, d):
    rows = fx_orders(s, d).withColumn("fold", F.when(F.col("split") == "train", F.col("hfold")))
    rows = rows.select("o_orderkey", "split", "fold", "y", *COMBO, "acctbal", "total")
    return plain(jobs.combo_levels(rows, COMBO, ["acctbal", "total"], "y", "fold").drop("split", "fold", "y", *COMBO, "acctbal", "total"), 6)


STAT_T, STAT_G = ["price", "size"], ["brand_ind", "kind_ind"]


@query(
    "job_group_stats",
    f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_extendedprice AS DECIMAL(12,2)) AS price, CAST(p_size AS DECIMAL(12,2)) AS size, p_brand AS brand_ind, p_type AS kind_ind FROM lineitem JOIN part ON p_partkey = l_partkey),
    {", ".join(f"g_{g} AS (SELECT {g}, COUNT(*) AS {g}_count, " + ", ".join(_pack(t, g, "COALESCE({}, 0.0)") for t in STAT_T) + f" FROM x GROUP BY {g})" for g in STAT_G)}
    SELECT l_orderkey, l_linenumber, l_partkey, {", ".join(f"g_{g}.* EXCLUDE ({g})" for g in STAT_G)}, x.brand_ind || '_' || x.kind_ind AS combo, COUNT(*) OVER (PARTITION BY x.brand_ind, x.kind_ind) AS combo_count,
      price::DOUBLE * size::DOUBLE AS price_x_size, price::DOUBLE / size::DOUBLE AS price_div_size
    FROM x {" ".join(f"JOIN g_{g} ON g_{g}.{g} = x.{g}" for g in STAT_G)}""",
)
def job_group_stats(s, d):
    part = table(s, d, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("decimal(12,2)").alias("size"), F.col("p_brand").alias("brand_ind"), F.col("p_type").alias("kind_ind")
    )
    rows = fx_lines(s, d).select("l_orderkey", "l_linenumber", "l_partkey", "price", "split").join(part, "l_partkey")
    out = plain(jobs.group_stats(rows, STAT_T, STAT_G, "_ind").drop(*STAT_T, *STAT_G, "split"))
    return out.withColumns({c: F.round(c, 4) for c in out.columns if c.endswith("_median")})


@query(
    "job_property_clean",
    f"""WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_extendedprice AS DECIMAL(12,2)) AS price, p_brand AS brand, p_type AS kind, l_linenumber AS top, CASE WHEN l_partkey % 7 <> 0 THEN p_size::DOUBLE END AS size, l_partkey % 5 AS floor FROM lineitem JOIN part ON p_partkey = l_partkey),
    b AS (SELECT * REPLACE (CASE WHEN top < floor THEN top ELSE floor END AS floor, CASE WHEN size > 45 THEN NULL ELSE size END AS size), (size IS NULL)::INTEGER AS size_missing FROM a),
    f AS (SELECT brand, kind, median(size) AS m FROM b GROUP BY ALL), c AS (SELECT brand, median(size) AS m FROM b GROUP BY 1), g AS (SELECT brand, {_pack('price', 'brand', '{}')} FROM b GROUP BY 1),
    z AS (SELECT b.* REPLACE (COALESCE(size, f.m, c.m) AS size) FROM b JOIN f ON f.brand = b.brand AND f.kind = b.kind JOIN c ON c.brand = b.brand)
    SELECT l_orderkey, l_linenumber, l_partkey, size_missing, round(size, 4) AS size, CAST(floor AS BIGINT) AS floor, price::DOUBLE / NULLIF(size, 0) AS price_per_size, floor::DOUBLE / NULLIF(top, 0) AS floor_share, g.* FROM z JOIN g USING (brand)""",
)
def job_property_clean(s, d):
    part = table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), "p_size")
    rows = fx_lines(s, d).select("l_orderkey", "l_linenumber", "l_partkey", "price", "split").join(part, "l_partkey")
    rows = rows.withColumns(
        {"size": F.when(F.col("l_partkey") % 7 != 0, F.col("p_size").cast("double")), "floor": F.col("l_partkey") % 5, "top": F.col("l_linenumber")}
    ).drop("p_size")
    out = plain(jobs.property_clean(rows).drop("kind", "top", "price", "split"))
    return out.withColumns({"size": F.round("size", 4), "price_by_brand_median": F.round("price_by_brand_median", 4)})


@query(
    "job_chain_lookup",
    f"""WITH RECURSIVE {EDGES}, {", ".join(_offset(o) for o in OFFSETS)}, st AS (SELECT src FROM ed WHERE src NOT IN (SELECT dst FROM ed)),
    ch AS (SELECT src AS chain, src AS id, 0::BIGINT AS position FROM st UNION ALL SELECT ch.chain, ed.dst, ch.position + 1 FROM ch JOIN ed ON ed.src = ch.id),
    x AS (SELECT *, [{", ".join(f"{c}::DOUBLE" for c in SERIES)}] AS a, list_filter([{", ".join(f"{c}::DOUBLE" for c in SERIES)}], lambda v: v <> 0) AS z FROM fxm)
    SELECT x.id, COALESCE(v2.v, v3.v, v4.v, 0)::DOUBLE AS looked_up, list_max(a) AS all_high, round(list_avg(z), 6) AS all_mean, list_min(z) AS all_low, round(list_median(z), 6) AS all_median, round(list_sum(a), 6) AS all_sum,
      round(list_stddev_samp(a), 6) AS all_std, CAST(len(list_distinct(a)) AS INTEGER) AS all_unique, CAST(6 - len(z) AS INTEGER) AS all_zeros, round(exp(list_avg(list_transform(z, lambda v: ln(1 + v)))) - 1, 6) AS log_mean,
      round(ln(1 + COALESCE({", ".join(f"NULLIF({c}, 0)" for c in SERIES)})::DOUBLE), 6) AS row_first_nz, round(ln(1 + COALESCE({", ".join(f"NULLIF({c}, 0)" for c in reversed(SERIES))})::DOUBLE), 6) AS row_last_nz, ch.chain, ch.position
    FROM x LEFT JOIN v2 USING (id) LEFT JOIN v3 USING (id) LEFT JOIN v4 USING (id) LEFT JOIN ch USING (id)""",
)
def job_chain_lookup(s, d):
    return plain(jobs.chain_lookup(_matrix(s, d), SERIES, "id", OFFSETS).drop(*SERIES), 6)


@query(
    "job_study",
    f"""WITH {FXS}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY value DESC, model) AS rn FROM fxc WHERE model <> 'Auto' AND prep = 'fe' AND hpo = 'extensive'),
    n AS (SELECT dataset, SUM(k)::BIGINT AS near_best_cells FROM (SELECT dataset, (value > MAX(value) OVER (PARTITION BY dataset, prep, hpo) - 0.01)::INTEGER AS k FROM fxc) GROUP BY 1),
    e AS (SELECT dataset, round(MAX(value) FILTER (WHERE prep = 'none' AND hpo = 'default' AND model = 'Base'), 4) AS a, round(MAX(value) FILTER (WHERE prep = 'fe' AND hpo = 'extensive'), 4) AS b FROM fxc GROUP BY 1)
    SELECT r.dataset, r.model AS best_model, round(r.value, 3) AS best_single, round(t.value, 3) AS automl, e.a AS start, e.b AS "end", round(e.b - e.a, 4) AS gain, n.near_best_cells
    FROM r JOIN fxc t ON t.dataset = r.dataset AND t.prep = 'fe' AND t.hpo = 'extensive' AND t.model = 'Auto' JOIN e ON e.dataset = r.dataset JOIN n ON n.dataset = r.dataset WHERE rn = 1""",
)
def job_study(s, d):
    return jobs.study_summary(fx_scores(s, d), BASE, AUTO)


PREDICTED = TableSpec(key=("o_orderkey",), target="target", metric="rmse", num=tuple(FEATURES), heavy_tailed=True)


@query(
    "job_experiment",
    f"WITH {FXO} SELECT o_orderkey, split, 1 AS predicted, 1 AS beats_mean FROM fxo",
)
def job_experiment(s, d):
    """Every order with a prediction, and whether those of the training rows beat the target's mean (the numbers depend on the fit)."""
    rows = _ml_rows(s, d, 2).withColumn("target", F.col("target") + 100)  # no negative target under the logarithm
    preds = jobs.experiment(rows, PREDICTED, FEATURES, 3, 11, 2, space=SMALL_SPACE)
    joined = stored(preds.join(rows.select("o_orderkey", "target"), "o_orderkey"), "experiment")
    train = joined.where("split = 'train'")
    error = metrics.mse_rmse_mae(train, "target", "pred").select("rmse").scalar()
    out = joined.withColumns({"_e": error, "_s": train.agg(F.stddev_pop("target")).scalar()})
    return out.select("o_orderkey", "split", F.col("pred").isNotNull().cast("int").alias("predicted"), (F.col("_e") < F.col("_s")).cast("int").alias("beats_mean"))
