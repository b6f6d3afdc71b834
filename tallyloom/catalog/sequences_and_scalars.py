"""Registered queries for ordered, row-wise and scalar features and sorting (inventories G, H, I, U)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tallyloom.catalog.fixtures import (
    FXB, FXG, FXG0, FXL, FXO, FXP, FXS, FXW, WIDE, fx_board, fx_entries, fx_grid, fx_lines, fx_orders, fx_scores,
    fx_trials, fx_weekly, fx_wide, table,
)
from tallyloom.catalog.joins_and_groups import mean, std
from tallyloom.catalog.registry import plain, query
from tallyloom.functions import scalar
from tallyloom.operators import rowwise, windows

# --- G: ordered features -----------------------------------------------------------------------------

LAGS = [28, 29, 30, 35, 42]


@query(
    "q_lags",
    f"WITH {FXG} SELECT sid, w, sales::DOUBLE AS sales, " + ", ".join(f"LAG(sales, {k}) OVER (PARTITION BY sid ORDER BY w)::DOUBLE AS sales_lag_{k}" for k in LAGS) + " FROM fxg",
)
def q_lags(s, d):
    return plain(windows.lags(fx_grid(s, d).select("sid", "w", "sales"), ["sid"], ["w"], "sales", LAGS, dense=True))


@query(
    "q_lags_events",
    "SELECT event_id, LAG(event_id, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS event_id_lag_1, LAG(event_id, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS event_id_lag_3 FROM events",
)
def q_lags_events(s, d):
    rows = table(s, d, "events").select("event_id", "user_id", "ts")
    return windows.lags(rows, ["user_id"], ["ts", "event_id"], "event_id", [1, 3]).drop("user_id", "ts")


def _rolled(shift: int, w: int, agg: str) -> str:
    over = f" OVER (PARTITION BY sid ORDER BY w ROWS BETWEEN {shift + w - 1} PRECEDING AND {shift} PRECEDING)"
    value = mean("sales", over) if agg == "mean" else std("sales", over)
    return f"CASE WHEN COUNT(sales){over} = {w} THEN {value} END AS sales_{agg}_{shift}_{w}"


@query("q_shift_rolling", f"WITH {FXG} SELECT sid, w, " + ", ".join(_rolled(28, w, a) for w in (7, 14, 30, 60, 180) for a in ("mean", "std")) + " FROM fxg")
def q_shift_rolling(s, d):
    grid = fx_grid(s, d).select("sid", "w", "sales")
    return windows.rolling(grid, ["sid"], ["w"], "sales", [28], [7, 14, 30, 60, 180], ["mean", "std"], dense=True).drop("sales")


@query("q_sliding_rolling", f"WITH {FXG} SELECT sid, w, " + ", ".join(_rolled(k, w, "mean") for k in (1, 7, 14) for w in (7, 14, 30, 60)) + " FROM fxg")
def q_sliding_rolling(s, d):
    grid = fx_grid(s, d).select("sid", "w", "sales")
    return windows.rolling(grid, ["sid"], ["w"], "sales", [1, 7, 14], [7, 14, 30, 60], ["mean"], dense=True).drop("sales")


@query(
    "q_momentum",
    f"WITH {FXG0} SELECT sid, w, sold::DOUBLE / NULLIF(LAG(sold) OVER (PARTITION BY sid ORDER BY w)::DOUBLE, 0) AS sold_momentum FROM fxs",
)
def q_momentum(s, d):
    return windows.momentum(fx_weekly(s, d).select("sid", "w", "sold"), ["sid"], ["w"], "sold").drop("sold")


def _banded(k: int, scope: str = "TRUE") -> str:
    return f"""c AS (SELECT DISTINCT qty AS centre FROM x), r AS (
      SELECT c.centre, x.id, x.qty, x.price, rank() OVER (PARTITION BY c.centre ORDER BY x.price) + (COUNT(*) OVER (PARTITION BY c.centre, x.price) - 1) / 2.0::DOUBLE AS rk
      FROM c JOIN x ON abs(x.qty - c.centre) <= {k} WHERE {scope}), t AS (SELECT *, MAX(rk) OVER (PARTITION BY centre) AS top FROM r)"""


XQ = f"{FXL}, x AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(qty AS BIGINT) AS qty, price, hash(l_orderkey, l_linenumber, l_partkey, l_suppkey, price, shipdate) AS id FROM fxl)"


def _lines_by_qty(s, d):
    return fx_lines(s, d).select("l_orderkey", "l_linenumber", "l_partkey", F.col("qty").cast("bigint").alias("qty"), "price", "split")


@query(
    "q_ecdf_in_group",
    f"WITH {XQ}, {_banded(0)} SELECT x.l_orderkey, x.l_linenumber, x.l_partkey, t.rk / t.top AS price_ecdf FROM t JOIN x ON x.id = t.id AND t.centre = x.qty",
)
def q_ecdf_in_group(s, d):
    return windows.ecdf(_lines_by_qty(s, d), "qty", "price").drop("qty", "price", "split")


@query(
    "q_ecdf_in_band",
    f"WITH {XQ}, {_banded(2)} SELECT x.l_orderkey, x.l_linenumber, x.l_partkey, t.rk / t.top AS price_ecdf_2 FROM t JOIN x ON x.id = t.id AND t.centre = x.qty",
)
def q_ecdf_in_band(s, d):
    return windows.ecdf_band(_lines_by_qty(s, d), "qty", "price", 2).drop("qty", "price", "split")


@query(
    "q_ecdf_in_band_train",
    """WITH p AS (SELECT p_partkey, p_size, CAST(p_retailprice AS DECIMAL(12,2)) AS price, p_partkey % 5 <> 0 AS train FROM part),
    c AS (SELECT DISTINCT p_size AS centre FROM p),
    r AS (SELECT centre, price, rank() OVER (PARTITION BY centre ORDER BY price) + (COUNT(*) OVER (PARTITION BY centre, price) - 1) / 2.0::DOUBLE AS rk FROM c JOIN p ON abs(p_size - centre) <= 1 WHERE train),
    t AS (SELECT DISTINCT centre, price, rk / MAX(rk) OVER (PARTITION BY centre) AS pct FROM r),
    n AS (SELECT p.p_partkey, t.pct, row_number() OVER (PARTITION BY p.p_partkey ORDER BY abs(t.price - p.price), t.price) AS rn FROM p JOIN t ON t.centre = p.p_size)
    SELECT p_partkey, pct AS price_ecdf_1 FROM n WHERE rn = 1""",
)
def q_ecdf_in_band_train(s, d):
    rows = table(s, d, "part").select(
        "p_partkey", "p_size", F.col("p_retailprice").cast("decimal(12,2)").alias("price"),
        F.when(F.col("p_partkey") % 5 == 0, "test").otherwise("train").alias("split"),
    )
    return windows.ecdf_band(rows, "p_size", "price", 1, "train").select("p_partkey", "price_ecdf_1")


@query("q_row_number", "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS row_id FROM orders")
def q_row_number(s, d):
    return windows.row_id(table(s, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"])


@query(
    "q_gini_cumsum",
    f"""WITH {FXP}, o AS (SELECT trial, y, row_number() OVER (PARTITION BY trial ORDER BY pred DESC, o_orderkey) AS pos FROM fxp),
    c AS (SELECT trial, y, SUM(y) OVER (PARTITION BY trial ORDER BY pos) AS cum FROM o) SELECT trial, round((SUM(cum)::DOUBLE / SUM(y) - (COUNT(*) + 1) / 2.0) / COUNT(*), 9) AS gini FROM c GROUP BY trial""",
)
def q_gini_cumsum(s, d):
    from tallyloom.catalog.fixtures import fx_preds

    return plain(windows.gini_sum(fx_preds(s, d), "y", "pred", ["o_orderkey"], ["trial"]), 9)


@query(
    "q_rank_insert",
    f"""WITH {FXB}, n AS (SELECT board, COUNT(*) AS n FROM fxboard GROUP BY 1)
    SELECT e.s_suppkey, 1 + COUNT(b.public) AS rank, n.n AS board_size, (1 + COUNT(b.public))::DOUBLE / n.n AS percentile
    FROM fxentry e JOIN n ON n.board = e.board LEFT JOIN fxboard b ON b.board = e.board AND b.public > e.public_score GROUP BY e.s_suppkey, n.n""",
)
def q_rank_insert(s, d):
    out = windows.rank_insert(fx_board(s, d), fx_entries(s, d), ["board"], "public", "public_score", "maximize")
    return out.select("s_suppkey", "rank", "board_size", "percentile")


@query(
    "q_topk_per_group",
    f"WITH {FXP} SELECT fold, trial, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY fold ORDER BY score, trial) AS INTEGER) AS rank FROM fxt QUALIFY rank <= 5",
)
def q_topk_per_group(s, d):
    return plain(windows.top_k(fx_trials(s, d), ["fold"], [F.col("score"), F.col("trial")], 5), 9)


@query(
    "q_topk_lines",
    "SELECT l_suppkey, l_orderkey, l_extendedprice, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_partkey) AS INTEGER) AS rank FROM lineitem QUALIFY rank <= 10",
)
def q_topk_lines(s, d):
    rows = table(s, d, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_extendedprice")
    return windows.top_k(rows, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_partkey")], 10).drop("l_partkey")


# --- U: sorts and limits -------------------------------------------------------------------------------


@query("q_sort_multi", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def q_sort_multi(s, d):
    return windows.sort_multi(table(s, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query("q_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 600")
def q_topk(s, d):
    return windows.top_n(table(s, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 600)


@query("q_arg_best", f"WITH {FXP} SELECT fold, arg_min(trial, score) AS trial, round(MIN(score), 9) AS score FROM fxt GROUP BY fold")
def q_arg_best(s, d):
    return plain(windows.arg_best(fx_trials(s, d), ["fold"], "trial", "score", "minimize"), 9)


# --- H: row-wise features ---------------------------------------------------------------------------------


def _sum(parts):
    return " + ".join(parts)


@query("q_row_zero_count", f"WITH {FXW} SELECT l_orderkey, CAST({_sum(f'(w{i} = 0)::INTEGER' for i in range(1, 8))} AS INTEGER) AS n_zero FROM fxw")
def q_row_zero_count(s, d):
    return rowwise.count_zero(fx_wide(s, d), WIDE).select("l_orderkey", "n_zero")


@query("q_row_null_count", f"WITH {FXO} SELECT o_orderkey, (bal_n IS NULL)::INTEGER + (seg_n IS NULL)::INTEGER AS n_null FROM fxo")
def q_row_null_count(s, d):
    return rowwise.count_null(fx_orders(s, d), ["bal_n", "seg_n", "total"]).select("o_orderkey", "n_null")


VALUES = [0, 3, 6, 9]


@query(
    "q_row_value_count",
    f"WITH {FXW} SELECT l_orderkey, " + ", ".join(f"CAST({_sum(f'(w{i} = {v})::INTEGER' for i in range(1, 8))} AS INTEGER) AS n_eq_{v}" for v in VALUES)
    + f", CAST({_sum(f'(w{i} IN (0, 3, 6, 9))::INTEGER' for i in range(1, 8))} AS INTEGER) AS n_eq_any FROM fxw",
)
def q_row_value_count(s, d):
    return rowwise.count_value(fx_wide(s, d), WIDE, VALUES).drop(*WIDE, "split")


LIST = "[" + ", ".join(f"w{i}::DOUBLE" for i in range(1, 8)) + "]"
NZ = f"list_filter({LIST}, lambda x: x <> 0)"


@query(
    "q_row_stats",
    f"WITH {FXW} SELECT l_orderkey, round(list_avg({LIST}), 6) AS row_mean, round(list_stddev_samp({LIST}), 6) AS row_std, list_min({LIST}) AS row_min, list_max({LIST}) AS row_max FROM fxw",
)
def q_row_stats(s, d):
    return plain(rowwise.row_stats(fx_wide(s, d), WIDE).drop(*WIDE, "split"), 6)


@query(
    "q_row_nonzero_stats",
    f"""WITH {FXW} SELECT l_orderkey, list_max({LIST}) AS w_high, round(list_avg({NZ}), 6) AS w_mean, list_min({NZ}) AS w_low, round(list_median({NZ}), 6) AS w_median,
    list_sum({LIST}) AS w_sum, round(list_stddev_samp({LIST}), 6) AS w_std, CAST(len(list_distinct({LIST})) AS INTEGER) AS w_unique, CAST(7 - len({NZ}) AS INTEGER) AS w_zeros FROM fxw""",
)
def q_row_nonzero_stats(s, d):
    return plain(rowwise.nonzero_stats(fx_wide(s, d), {"w": WIDE}).drop(*WIDE, "split"), 6)


@query(
    "q_row_first_last_nonzero",
    f"WITH {FXW} SELECT l_orderkey, round(ln(1 + COALESCE({', '.join(f'NULLIF(w{i}, 0)' for i in range(1, 8))})), 6) AS row_first_nz, round(ln(1 + COALESCE({', '.join(f'NULLIF(w{i}, 0)' for i in range(7, 0, -1))})), 6) AS row_last_nz FROM fxw",
)
def q_row_first_last_nonzero(s, d):
    return plain(rowwise.first_last_nonzero(fx_wide(s, d), WIDE).drop(*WIDE, "split"), 6)


@query("q_row_log_mean", f"WITH {FXW} SELECT l_orderkey, round(exp(list_avg(list_transform({NZ}, lambda x: ln(1 + x)))) - 1, 6) AS log_mean FROM fxw")
def q_row_log_mean(s, d):
    return plain(rowwise.log_mean(fx_wide(s, d), WIDE).drop(*WIDE, "split"), 6)


@query("q_row_any_flag", f"WITH {FXW} SELECT l_orderkey, (w1 > 40 OR w2 > 40 OR w3 > 40)::INTEGER AS any_flag FROM fxw")
def q_row_any_flag(s, d):
    flags = fx_wide(s, d).select("l_orderkey", *[(F.col(c) > 40).alias(f"{c}_big") for c in WIDE[:3]])
    return rowwise.any_flag(flags, ["w1_big", "w2_big", "w3_big"]).select("l_orderkey", "any_flag")


@query("q_row_sum_group", f"WITH {FXW} SELECT l_orderkey, w1 + w2 + w3 AS first_three FROM fxw")
def q_row_sum_group(s, d):
    return rowwise.row_sum(fx_wide(s, d), WIDE[:3], "first_three").select("l_orderkey", "first_three")


@query("q_mod_flags", f"WITH {FXW} SELECT l_orderkey, " + ", ".join(f"(w{i} % 3 = 0)::INTEGER AS w{i}_mod3" for i in range(1, 8)) + " FROM fxw")
def q_mod_flags(s, d):
    return rowwise.mod_flags(fx_wide(s, d), WIDE, 3).drop(*WIDE, "split")


@query(
    "q_precision_flag",
    "SELECT l_orderkey, l_linenumber, l_partkey, (abs(u * 100 - round_even(u * 100, 0)) > 1e-6 AND u > 0)::INTEGER AS has_ugly FROM (SELECT *, l_extendedprice / l_quantity AS u FROM lineitem)",
)
def q_precision_flag(s, d):
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_tax", (F.col("l_extendedprice") / F.col("l_quantity")).alias("u"))
    return rowwise.precision_flag(rows, ["u", "l_tax"]).drop("u", "l_tax")


@query("q_row_hash_key", f"WITH {FXW} SELECT l_orderkey, md5(concat_ws('|', {', '.join(f'chr(118) || w{i}' for i in range(1, 8))})) AS tuple_key FROM fxw")
def q_row_hash_key(s, d):
    return rowwise.tuple_key(fx_wide(s, d), WIDE).select("l_orderkey", "tuple_key")


@query("q_first_nonzero_of_preds", f"WITH {FXW} SELECT l_orderkey, COALESCE(NULLIF(w7, 0), NULLIF(w5, 0), NULLIF(w3, 0), 0) AS picked FROM fxw")
def q_first_nonzero_of_preds(s, d):
    return rowwise.first_nonzero(fx_wide(s, d), ["w7", "w5", "w3"], "picked").select("l_orderkey", "picked")


# --- I: scalar features -------------------------------------------------------------------------------------

NUMS = ["price", "qty", "disc"]
LINE = "l_orderkey, l_linenumber, l_partkey"


def _line_cols(s, d, *cols):
    return fx_lines(s, d).select("l_orderkey", "l_linenumber", "l_partkey", *cols)


@query(
    "q_pair_product_ratio",
    f"WITH {FXL} SELECT {LINE}, " + ", ".join(f"{a}::DOUBLE * {b}::DOUBLE AS {a}_x_{b}, CASE WHEN {b} = 0 THEN 0 ELSE {a}::DOUBLE / NULLIF({b}::DOUBLE, 0) END AS {a}_div_{b}" for a, b in combinations(NUMS, 2)) + " FROM fxl",
)
def q_pair_product_ratio(s, d):
    return scalar.pair_product_ratio(_line_cols(s, d, *NUMS), NUMS).drop(*NUMS)


@query("q_pair_sum", f"WITH {FXL} SELECT {LINE}, " + ", ".join(f"{a}::DOUBLE + {b}::DOUBLE AS {a}_plus_{b}" for a, b in combinations(NUMS, 2)) + " FROM fxl")
def q_pair_sum(s, d):
    return scalar.pair_sum(_line_cols(s, d, *NUMS), NUMS).drop(*NUMS)


@query(
    "q_ratio_list",
    f"WITH {FXW} SELECT l_orderkey, " + ", ".join(f"COALESCE({a}::DOUBLE / NULLIF({b}::DOUBLE, 0), 0) AS {a}_{b}" for a, b in (("w1", "w3"), ("w2", "w5"), ("w7", "w1"))) + " FROM fxw",
)
def q_ratio_list(s, d):
    triples = [(f"{a}_{b}", a, b) for a, b in (("w1", "w3"), ("w2", "w5"), ("w7", "w1"))]
    return scalar.ratios(fx_wide(s, d), triples).drop(*WIDE, "split")


@query(
    "q_density_ratios",
    f"""WITH {FXL}, a AS (SELECT {LINE}, price::DOUBLE AS p, qty::DOUBLE AS q, (price * (1 - disc))::DOUBLE AS net, (price * disc)::DOUBLE AS cut, tax::DOUBLE AS t FROM fxl)
    SELECT {LINE}, p / NULLIF(q, 0) AS per_unit, net / NULLIF(q, 0) AS net_per_unit, cut / NULLIF(p, 0) AS cut_share, net / NULLIF(t, 0) AS net_per_tax FROM a""",
)
def q_density_ratios(s, d):
    p, x = F.col("price"), F.col("disc")
    rows = _line_cols(s, d, "price", "qty", "tax", (p * (1 - x)).alias("net"), (p * x).alias("cut"))
    triples = [("per_unit", "price", "qty"), ("net_per_unit", "net", "qty"), ("cut_share", "cut", "price"), ("net_per_tax", "net", "tax")]
    return scalar.ratios(rows, triples, on_bad=None).drop("price", "qty", "tax", "net", "cut")


@query("q_logic_flag", f"WITH {FXL} SELECT {LINE}, (flag = 'R' AND ls = 'F')::INTEGER AS both_set, (abs(disc - tax) > 0.03)::INTEGER AS far_apart FROM fxl")
def q_logic_flag(s, d):
    rows = scalar.flag(_line_cols(s, d, "flag", "ls", "disc", "tax"), "both_set", (F.col("flag") == "R") & (F.col("ls") == "F"))
    return scalar.flag(rows, "far_apart", F.abs(F.col("disc") - F.col("tax")) > 0.03).drop("flag", "ls", "disc", "tax")


@query("q_concat_pairs", f"WITH {FXL} SELECT {LINE}, l_suppkey || '_' || flag AS l_suppkey_flag, flag || '_' || ls AS flag_ls FROM fxl")
def q_concat_pairs(s, d):
    rows = scalar.concat_pair(_line_cols(s, d, "l_suppkey", "flag", "ls"), "l_suppkey", "flag")
    return scalar.concat_pair(rows, "flag", "ls").drop("l_suppkey", "flag", "ls")


R_COLS = ["status", "priority", "seg_n", "nation"]


@query(
    "q_concat_r_way",
    f"WITH {FXO}, k AS (SELECT o_orderkey, " + ", ".join(f"concat_ws('_', {', '.join(f'COALESCE({c}, chr(110) || chr(97) || chr(110))' for c in g)}) AS {'_'.join(g)}" for g in combinations(R_COLS, 3) if "seg_n" in g)
    + " FROM fxo) SELECT k.*, dense_rank() OVER (ORDER BY status_priority_seg_n) - 1 AS status_priority_seg_n_code FROM k",
)
def q_concat_r_way(s, d):
    from tallyloom.operators.encode import label_encode

    rows = scalar.concat_r(fx_orders(s, d).select("o_orderkey", *R_COLS, "split"), R_COLS, 3, "seg_n")
    return label_encode(rows, ["status_priority_seg_n"]).drop(*R_COLS, "split")


@query("q_int_concat", f"WITH {FXL} SELECT {LINE}, TRY_CAST(l_suppkey::VARCHAR || l_linenumber::VARCHAR AS BIGINT) AS both_keys FROM fxl")
def q_int_concat(s, d):
    return scalar.int_concat(_line_cols(s, d, "l_suppkey"), "l_suppkey", "l_linenumber", "both_keys").drop("l_suppkey")


@query("q_numeric_to_level", f"WITH {FXL} SELECT {LINE}, CAST(CAST(floor(price::DOUBLE * 0.01::DOUBLE) AS BIGINT) AS VARCHAR) AS price_level FROM fxl")
def q_numeric_to_level(s, d):
    return scalar.truncate_level(_line_cols(s, d, "price"), ["price"], 0.01).drop("price")


@query("q_round", f"WITH {FXL} SELECT {LINE}, round_even(price::DOUBLE / qty::DOUBLE, 3) AS unit FROM fxl")
def q_round(s, d):
    rows = _line_cols(s, d, (F.col("price").cast("double") / F.col("qty").cast("double")).alias("unit"))
    return scalar.round_half_even(rows, ["unit"], 3)


@query(
    "q_math_transforms",
    f"""WITH {FXO}, x AS (SELECT o_orderkey, acctbal::DOUBLE AS b FROM fxo) SELECT o_orderkey, round(CASE WHEN b > 0 THEN ln(b) END, 6) AS acctbal_log,
    round(CASE WHEN b > -1 THEN ln(1 + b) END, 6) AS acctbal_log1p, round(CASE WHEN b >= 0 THEN sqrt(b) END, 6) AS acctbal_sqrt,
    round(CASE WHEN b >= 0 THEN 1 / (1 + exp(-sqrt(b))) END, 6) AS acctbal_sigmoid_sqrt, round(CASE WHEN b >= 0 THEN pow(b, 0.25) END, 6) AS acctbal_pow, round(abs(b), 6) AS acctbal_abs FROM x""",
)
def q_math_transforms(s, d):
    rows = fx_orders(s, d).select("o_orderkey", "acctbal")
    for fn in ("log", "log1p", "sqrt", "sigmoid_sqrt", "abs"):
        rows = scalar.math(rows, ["acctbal"], fn)
    return plain(scalar.power(rows, ["acctbal"], 0.25).drop("acctbal"), 6)


@query("q_hinge_power", f"WITH {FXO} SELECT o_orderkey, round(pow(greatest(total::DOUBLE - 1000, 0) / 400000, 0.25), 6) AS total_hinge FROM fxo")
def q_hinge_power(s, d):
    return plain(scalar.hinge_power(fx_orders(s, d).select("o_orderkey", "total"), "total", 1000, 400000).drop("total"), 6)


@query("q_fraction_part", f"WITH {FXO} SELECT o_orderkey, (total - floor(total))::DOUBLE AS total_cents FROM fxo")
def q_fraction_part(s, d):
    return plain(scalar.fraction(fx_orders(s, d).select("o_orderkey", "total"), "total").drop("total"))


@query(
    "q_epoch_month",
    "SELECT o_orderkey, CAST(year(x) * 12 + month(x) AS INTEGER) AS secs_month, secs // 86400 AS secs_day FROM (SELECT *, DATE '2017-11-30' + CAST(secs // 86400 AS INTEGER) AS x FROM (SELECT o_orderkey, (o_orderkey * 7919) % 15811131 AS secs FROM orders))",
)
def q_epoch_month(s, d):
    rows = table(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 7919 % 15811131).alias("secs"))
    return scalar.epoch_parts(rows, "secs", "2017-11-30").drop("secs")


@query("q_elapsed_normalise", "SELECT o_orderkey, (o_custkey % 300) - ((o_orderkey * 7919) % 15811131) // 86400 AS d1 FROM orders")
def q_elapsed_normalise(s, d):
    rows = table(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 300).alias("d1"), (F.col("o_orderkey") * 7919 % 15811131).alias("secs"))
    return scalar.subtract_elapsed(rows, ["d1"], "secs").drop("secs")


@query("q_entity_id", "SELECT o_orderkey, concat_ws('_', o_custkey::VARCHAR, o_orderstatus, CAST(CAST(floor((o_orderkey % 180)::DOUBLE - (o_custkey % 300)::DOUBLE) AS BIGINT) AS VARCHAR)) AS uid FROM orders")
def q_entity_id(s, d):
    rows = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", (F.col("o_orderkey") % 180).alias("day"), (F.col("o_custkey") % 300).alias("age"))
    return scalar.entity_id(rows, ["o_custkey", "o_orderstatus"], "day", "age").select("o_orderkey", "uid")


@query(
    "q_date_parts",
    f"""WITH {FXO} SELECT o_orderkey, day(odate)::INTEGER AS odate_day, week(odate)::INTEGER AS odate_week, month(odate)::INTEGER AS odate_month, (year(odate) - 1995)::INTEGER AS odate_year,
    CAST(ceil(day(odate) / 7.0) AS INTEGER) AS odate_week_of_month, (isodow(odate) - 1)::INTEGER AS odate_weekday, (isodow(odate) >= 6)::INTEGER AS odate_weekend FROM fxo""",
)
def q_date_parts(s, d):
    parts = ["day", "week", "month", "year", "week_of_month", "weekday", "weekend"]
    return scalar.date_parts(fx_orders(s, d).select("o_orderkey", "odate"), "odate", parts, 1995).drop("odate")


@query(
    "q_date_parts_ext",
    f"""WITH {FXO} SELECT o_orderkey, quarter(odate)::INTEGER AS odate_quarter, day(last_day(odate))::INTEGER AS odate_days_in_month,
    ((year(odate) - 1995) * 12 + month(odate) - 1)::INTEGER AS odate_month_index, ((year(odate) - 1995) * 4 + quarter(odate) - 1)::INTEGER AS odate_quarter_index, (isodow(odate) - 1)::INTEGER AS odate_weekday FROM fxo""",
)
def q_date_parts_ext(s, d):
    parts = ["quarter", "days_in_month", "month_index", "quarter_index", "weekday"]
    text = fx_orders(s, d).select("o_orderkey", F.col("odate").cast("string").alias("odate"))
    return scalar.date_parts(text, "odate", parts, 1995).drop("odate")


@query(
    "q_month_shift",
    f"WITH {FXO}, x AS (SELECT o_orderkey, CAST(odate - INTERVAL 1 MONTH AS DATE) AS m FROM fxo) SELECT o_orderkey, day(m)::INTEGER AS odate_shift_day, month(m)::INTEGER AS odate_shift_month, year(m)::INTEGER AS odate_shift_year, week(m)::INTEGER AS odate_shift_week FROM x",
)
def q_month_shift(s, d):
    return scalar.month_shift(fx_orders(s, d).select("o_orderkey", "odate"), "odate", -1, ["day", "month", "year", "week"]).drop("odate")


@query("q_days_since", f"WITH {FXO} SELECT o_orderkey, date_diff('day', odate, DATE '2015-03-23')::INTEGER AS odate_days, CAST(floor(date_diff('day', odate, DATE '2015-03-23') / 365.0) AS INTEGER) AS odate_years FROM fxo")
def q_days_since(s, d):
    return scalar.days_since(fx_orders(s, d).select("o_orderkey", "odate"), "odate", "2015-03-23").drop("odate")


@query("q_substring_parse", "SELECT p_partkey, CAST(substr(p_brand, 7) AS BIGINT) AS brand_no, substr(p_type, 1, 1) AS type_letter FROM part")
def q_substring_parse(s, d):
    rows = scalar.parse_suffix(table(s, d, "part").select("p_partkey", "p_brand", "p_type"), "p_brand", 7, "brand_no")
    return scalar.first_character(rows, "p_type", "type_letter").drop("p_brand", "p_type")
