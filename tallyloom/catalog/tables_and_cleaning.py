"""Registered queries for sources, cleaning and profiling (inventories A, B, C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.catalog.fixtures import FXL, FXO, FXW, WIDE, fx_lines, fx_orders, fx_wide, table
from tallyloom.catalog.registry import plain, query
from tallyloom.core import work_dir
from tallyloom.operators import clean, profile
from tallyloom.ordered import row_index
from tallyloom.sources import tables as src

# --- A: sources ----------------------------------------------------------------------------------


@query("q_scan", "SELECT * REPLACE (CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS l_shipdate) FROM lineitem")
def q_scan(s, d):
    return plain(src.load(s, f"{d}/lineitem.parquet"))


@query("q_scan_keyed", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def q_scan_keyed(s, d):
    return src.load_keyed(s, f"{d}/orders.parquet", ["o_orderkey"]).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("q_scan_pruned", "SELECT l_orderkey, l_quantity FROM lineitem")
def q_scan_pruned(s, d):
    return src.load_cols(s, f"{d}/lineitem.parquet", ["l_orderkey", "l_quantity"])


@query("q_head_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000")
def q_head_n(s, d):
    return src.head_n(table(s, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 1000)


@query(
    "q_slice_sample",
    f"WITH {FXO} SELECT month, o_orderkey FROM (SELECT CAST(month(odate) AS INTEGER) AS month, o_orderkey, "
    "row_number() OVER (PARTITION BY month(odate) ORDER BY o_orderkey) AS rn FROM fxo) WHERE rn <= 50",
)
def q_slice_sample(s, d):
    rows = fx_orders(s, d).select(F.month("odate").alias("month"), "o_orderkey")
    return src.slice_sample(rows, ["month"], ["o_orderkey"], 50)


@query(
    "q_scan_dates",
    "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS odate, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders",
)
def q_scan_dates(s, d):
    path = work_dir(s, "dates")
    table(s, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy/MM/dd").alias("odate")).write.csv(path, header=True)
    rows = src.load_dates(s, path, ["odate"], "yyyy/MM/dd", "o_orderkey bigint, odate string")
    return plain(rows.withColumn("y", F.year("odate")))


@query("q_cache_features", f"WITH {FXO} SELECT o_orderkey, total::DOUBLE AS total, split, y FROM fxo")
def q_cache_features(s, d):
    rows, where = fx_orders(s, d).select("o_orderkey", "total", "split", "y"), work_dir(s, "cache")
    src.cache_features(rows, where, "fe-all-full")
    return plain(src.cache_features(rows, where, "fe-all-full"))  # second call reads the first one's files


@query(
    "q_stage_blocks",
    f"WITH {FXO} SELECT o_orderkey, total::DOUBLE AS total, CAST(year(odate) AS INTEGER) AS odate_year, segment FROM fxo",
)
def q_stage_blocks(s, d):
    rows = fx_orders(s, d)
    blocks = {
        "money": rows.select("o_orderkey", "total"),
        "dates": rows.select("o_orderkey", F.year("odate").alias("odate_year")),
        "levels": rows.select("o_orderkey", "segment"),
    }
    return plain(src.stage_blocks(blocks, ["o_orderkey"], work_dir(s, "blocks")))


@query("q_write_predictions", f"WITH {FXO} SELECT o_orderkey, total::DOUBLE AS pred FROM fxo WHERE split = 'test'")
def q_write_predictions(s, d):
    path = work_dir(s, "preds")
    preds = fx_orders(s, d).where("split = 'test'").select("o_orderkey", F.col("total").alias("pred"))
    src.write_predictions(preds, path)
    return src.load(s, path, "o_orderkey bigint, pred double")


@query(
    "q_leaderboard_scan",
    'SELECT CAST(row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS INTEGER) AS "Rank", s_acctbal AS "PublicScore", s_acctbal - 1 AS "PrivateScore" FROM supplier',
)
def q_leaderboard_scan(s, d):
    path = work_dir(s, "board")
    entries = row_index(table(s, d, "supplier").withColumn("_neg", -F.col("s_acctbal")), [], ["_neg", "s_suppkey"], "Rank")
    entries.select("Rank", F.col("s_acctbal").alias("PublicScore"), (F.col("s_acctbal") - 1).alias("PrivateScore")).write.csv(path, header=True)
    return src.load_leaderboard(s, path)


# --- B: cleaning ---------------------------------------------------------------------------------


@query("q_split_xy", f"WITH {FXO} SELECT status, priority, segment, nation FROM fxo")
def q_split_xy(s, d):
    rows = fx_orders(s, d).select("o_orderkey", "y", "status", "priority", "segment", "nation")
    return clean.split_xy(rows, "y", ["o_orderkey"])[0]


@query("q_select_list", f"WITH {FXO} SELECT o_orderkey, segment, total::DOUBLE AS total FROM fxo")
def q_select_list(s, d):
    return plain(clean.keep(fx_orders(s, d), ["o_orderkey", "segment", "total"]))


@query("q_drop_by_pattern", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_tax FROM lineitem")
def q_drop_by_pattern(s, d):
    return clean.drop_matching(clean.drop_matching(clean.drop_matching(table(s, d, "lineitem"), "l_ret", "status"), contains="disc"), "l_ship", "price")


@query("q_nullify_by_pattern", f"WITH {FXL} SELECT l_orderkey, l_linenumber, price::DOUBLE AS price, CAST(NULL AS DOUBLE) AS tax FROM fxl")
def q_nullify_by_pattern(s, d):
    return plain(clean.nullify_matching(fx_lines(s, d).select("l_orderkey", "l_linenumber", "price", "tax"), "tax"))


@query("q_sentinel_to_null", f"WITH {FXO} SELECT o_orderkey, CASE WHEN total_s NOT IN (-1, -999999) THEN total_s END::DOUBLE AS total_s FROM fxo")
def q_sentinel_to_null(s, d):
    return plain(clean.sentinel_to_null(fx_orders(s, d).select("o_orderkey", "total_s"), ["total_s"], [-1, -999999]))


@query("q_null_to_sentinel", f"WITH {FXO} SELECT o_orderkey, COALESCE(bal_n, -999)::DOUBLE AS bal_n, COALESCE(seg_n, 'none') AS seg_n FROM fxo")
def q_null_to_sentinel(s, d):
    return plain(clean.null_to(fx_orders(s, d).select("o_orderkey", "bal_n", "seg_n"), {"bal_n": -999, "seg_n": "none"}))


@query(
    "q_range_recode",
    f"""WITH {FXL} SELECT l_orderkey, l_linenumber, price::DOUBLE AS price,
    CASE WHEN qty BETWEEN 1 AND 5 THEN 0 WHEN qty BETWEEN 45 AND 50 THEN 99 WHEN qty = 7 THEN -7 ELSE qty END::DOUBLE AS qty FROM fxl""",
)
def q_range_recode(s, d):
    rows = fx_lines(s, d).select("l_orderkey", "l_linenumber", "price", "qty")
    return plain(clean.recode(rows, "qty", [(1, 5, 0), (45, 50, 99), (7, 7, -7)]))


@query("q_zero_to_missing_listed", f"WITH {FXW} SELECT l_orderkey, CASE WHEN w6 = 0 THEN -999 ELSE w6 END AS w6, CASE WHEN w7 = 0 THEN -999 ELSE w7 END AS w7, w1 FROM fxw")
def q_zero_to_missing_listed(s, d):
    return clean.zero_to(fx_wide(s, d).select("l_orderkey", "w6", "w7", "w1"), ["w6", "w7"], -999)


@query("q_clip", f"WITH {FXO} SELECT o_orderkey, CASE WHEN acctbal < 0 THEN 0 WHEN acctbal > 5000 THEN 5000 ELSE acctbal END::DOUBLE AS acctbal FROM fxo")
def q_clip(s, d):
    return plain(clean.clip(fx_orders(s, d).select("o_orderkey", "acctbal"), "acctbal", 0, 5000))


@query("q_cap_target", f"WITH {FXO} SELECT o_orderkey, CASE WHEN total > 400000 THEN 400000 ELSE total END::DOUBLE AS total FROM fxo")
def q_cap_target(s, d):
    return plain(clean.cap_to(fx_orders(s, d).select("o_orderkey", "total"), "total", 400000, 400000))


@query(
    "q_segment_scale",
    f"WITH {FXO} SELECT o_orderkey, total::DOUBLE * (CASE WHEN segment = 'BUILDING' THEN 0.969 WHEN segment = 'MACHINERY' THEN 1.05 ELSE 1.0 END)::DOUBLE AS total FROM fxo",
)
def q_segment_scale(s, d):
    rows = fx_orders(s, d).select("o_orderkey", "segment", "total")
    return clean.segment_scale(rows, "total", "segment", {"BUILDING": 0.969, "MACHINERY": 1.05}).drop("segment")


@query("q_rename_align", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def q_rename_align(s, d):
    other = table(s, d, "orders").select(F.col("o_custkey").alias("cust"), F.col("o_totalprice").alias("O_TOTALPRICE"), F.col("o_orderkey").alias("O_OrderKey"))
    return clean.align_names(other, ["o_orderkey", "o_custkey", "o_totalprice"], {"cust": "O_CUSTKEY"})


@query(
    "q_rare_to_other",
    f"""WITH {FXO}, k AS (SELECT nation FROM fxo WHERE split = 'train' GROUP BY nation HAVING COUNT(*) >= 480)
    SELECT o_orderkey, CASE WHEN k.nation IS NULL THEN 'Other' ELSE fxo.nation END AS nation,
      CASE WHEN priority IN ('1-URGENT', '2-HIGH') THEN priority ELSE 'Other' END AS priority
    FROM fxo LEFT JOIN k ON k.nation = fxo.nation""",
)
def q_rare_to_other(s, d):
    rows = fx_orders(s, d).select("o_orderkey", "nation", "priority", "split")
    listed = clean.rare_to_other(rows, "priority", keep=["1-URGENT", "2-HIGH"])
    return clean.rare_to_other(listed, "nation", min_count=480).drop("split")


@query(
    "q_level_recode",
    f"""WITH {FXO} SELECT o_orderkey, CASE WHEN segment = 'MACHINERY' THEN 'BUILDING' ELSE segment END AS segment,
    CASE priority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 3 ELSE 0 END AS priority_rank FROM fxo""",
)
def q_level_recode(s, d):
    rows = fx_orders(s, d).select("o_orderkey", "segment", "priority")
    ranked = clean.map_levels(rows, "priority", {"1-URGENT": 5, "2-HIGH": 4, "3-MEDIUM": 3}, 0, "priority_rank")
    return clean.map_levels(ranked, "segment", {"MACHINERY": "BUILDING"}).drop("priority")


@query("q_missing_flags", f"WITH {FXO} SELECT o_orderkey, (bal_n IS NULL)::INTEGER AS bal_n_missing, (seg_n IS NULL)::INTEGER AS seg_n_missing FROM fxo")
def q_missing_flags(s, d):
    return clean.missing_flags(fx_orders(s, d).select("o_orderkey", "bal_n", "seg_n"), ["bal_n", "seg_n"]).drop("bal_n", "seg_n")


@query("q_presence_flag", f"WITH {FXO} SELECT o_orderkey, (o_orderkey % 3 = 0)::INTEGER AS pool, segment FROM fxo")
def q_presence_flag(s, d):
    rows = fx_orders(s, d).select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "yes").alias("pool"), "segment")
    return clean.presence_flags(rows, ["pool", "segment"])


@query(
    "q_cross_field_fix",
    f"""WITH {FXL}, a AS (SELECT l_orderkey, price, CASE WHEN qty > 40 THEN disc * 100 ELSE qty END AS qty, tax * 100 AS tax FROM fxl),
    b AS (SELECT l_orderkey, price, qty, CASE WHEN qty < tax THEN qty ELSE tax END AS tax FROM a)
    SELECT l_orderkey, price::DOUBLE AS price, CASE WHEN tax = qty THEN 0 ELSE qty END::DOUBLE AS qty, tax::DOUBLE AS tax FROM b""",
)
def q_cross_field_fix(s, d):
    rows = fx_lines(s, d).select("l_orderkey", "price", "disc", "qty", (F.col("tax") * 100).alias("tax"))
    rules = [
        ("qty", F.col("qty") > 40, F.col("disc") * 100),
        ("tax", F.col("qty") < F.col("tax"), F.col("qty")),
        ("qty", F.col("tax") == F.col("qty"), F.lit(0)),
    ]
    return plain(clean.repair(rows, rules).drop("disc"))


@query("q_cap_outlier_to_zero", f"WITH {FXL} SELECT l_orderkey, l_linenumber, CASE WHEN u > 2000 OR u < 950 THEN 0 ELSE u END AS unit FROM (SELECT *, price::DOUBLE / qty::DOUBLE AS u FROM fxl)")
def q_cap_outlier_to_zero(s, d):
    rows = fx_lines(s, d).select("l_orderkey", "l_linenumber", F.try_divide(F.col("price").cast("double"), F.col("qty").cast("double")).alias("unit"))
    return clean.zero_if(rows, "unit", (F.col("unit") > 2000) | (F.col("unit") < 950))


def _narrowed(col: str, table_name: str) -> str:
    return (
        f"SELECT '{col}' AS \"column\", CASE WHEN MIN({col}) >= -128 AND MAX({col}) <= 127 THEN 'tinyint' "
        f"WHEN MIN({col}) >= -32768 AND MAX({col}) <= 32767 THEN 'smallint' "
        f"WHEN MIN({col}) >= -2147483648 AND MAX({col}) <= 2147483647 THEN 'int' ELSE 'bigint' END AS type FROM {table_name}"
    )


NARROW = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@query(
    "q_narrow_types",
    " UNION ALL ".join(_narrowed(c, "lineitem") for c in NARROW)
    + " UNION ALL SELECT 'l_quantity', CASE WHEN MIN((l_quantity::FLOAT::DOUBLE = l_quantity)::INTEGER) = 1 THEN 'float' ELSE 'double' END FROM lineitem"
    + " UNION ALL SELECT 'l_extendedprice', CASE WHEN MIN((l_extendedprice::FLOAT::DOUBLE = l_extendedprice)::INTEGER) = 1 THEN 'float' ELSE 'double' END FROM lineitem",
)
def q_narrow_types(s, d):
    rows = clean.narrow_types(table(s, d, "lineitem").select(*NARROW, "l_quantity", "l_extendedprice"))
    return rows.agg(
        F.array(*[F.struct(F.lit(c).alias("column"), F.max(F.typeof(F.col(c))).alias("type")) for c in rows.columns]).alias("t")
    ).select(F.inline("t"))


@query(
    "q_category_domain",
    f"""WITH {FXO}, x AS (SELECT o_orderkey, split, seg_n, CASE WHEN split = 'test' AND o_orderkey % 2 = 0 THEN 'NEW_' || nation ELSE nation END AS place FROM fxo)
    SELECT o_orderkey, COALESCE(CASE WHEN place IN (SELECT place FROM x WHERE split = 'train') THEN place END, 'nan') AS place,
      COALESCE(CASE WHEN seg_n IN (SELECT seg_n FROM x WHERE split = 'train' AND seg_n IS NOT NULL) THEN seg_n END, 'nan') AS seg_n FROM x""",
)
def q_category_domain(s, d):
    new = F.when((F.col("split") == "test") & (F.col("o_orderkey") % 2 == 0), F.concat(F.lit("NEW_"), "nation")).otherwise(F.col("nation"))
    rows = fx_orders(s, d).select("o_orderkey", "split", "seg_n", new.alias("place"))
    return clean.restrict_domain(rows, ["place", "seg_n"], "train").drop("split")


# --- C: profile-driven selection -------------------------------------------------------------------


def _odd_columns(s, d):
    key = F.col("o_orderkey")
    return fx_orders(s, d).select(
        "o_orderkey", "status", F.lit(7).alias("seven"), F.when(key % 3 != 0, "z").alias("only_z"),
        F.lit(None).cast("double").alias("nothing"), F.when(key % 97 == 0, key).alias("sparse"), "split",
    )


ODD = f"""{FXO}, odd AS (SELECT o_orderkey, status, 7 AS seven, CASE WHEN o_orderkey % 3 <> 0 THEN 'z' END AS only_z,
  CAST(NULL AS DOUBLE) AS nothing, CASE WHEN o_orderkey % 97 = 0 THEN o_orderkey END AS sparse, split FROM fxo)"""


@query("q_drop_constant", f"WITH {ODD} SELECT o_orderkey, status, nothing, sparse, split FROM odd")
def q_drop_constant(s, d):
    return profile.drop_constant(_odd_columns(s, d), "train")


@query("q_drop_all_null", f"WITH {ODD} SELECT o_orderkey, status, seven, only_z, sparse, split FROM odd")
def q_drop_all_null(s, d):
    return profile.drop_all_null(_odd_columns(s, d))


@query("q_drop_sparse", f"WITH {ODD} SELECT o_orderkey, status, seven, only_z, split FROM odd")
def q_drop_sparse(s, d):
    return profile.drop_sparse(_odd_columns(s, d), 0.98)


@query("q_drop_single_value", f"WITH {ODD} SELECT o_orderkey, status, nothing, sparse, split FROM odd")
def q_drop_single_value(s, d):
    return profile.drop_single_value(_odd_columns(s, d))


def _profiled(cols, source):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", COUNT(*) AS n_rows, COUNT({c}) AS n_values, (COUNT({c}) > 0 AND MIN({c}) = MAX({c}))::INTEGER AS is_constant, "
        f"(COUNT(*) - COUNT({c}))::DOUBLE / COUNT(*) AS missing, COUNT(DISTINCT {c}) AS n_distinct FROM {source}"
        for c in cols
    )


@query("q_column_profile", f"WITH {FXO} " + _profiled(["status", "segment", "nation", "bal_n", "seg_n", "total"], "fxo"))
def q_column_profile(s, d):
    return profile.column_profile(fx_orders(s, d), ["status", "segment", "nation", "bal_n", "seg_n", "total"])


@query("q_drop_duplicate_cols", f"WITH {FXL} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, qty::DOUBLE AS qty, price::DOUBLE AS price, disc::DOUBLE AS twice FROM fxl")
def q_drop_duplicate_cols(s, d):
    rows = fx_lines(s, d).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "qty", F.col("qty").alias("qty_0"), "price", F.col("price").alias("price_0"), F.col("disc").alias("twice"))
    key = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return plain(profile.drop_duplicate_cols(rows, key, ["qty", "qty_0", "price", "price_0", "twice"], "_0"))


@query(
    "q_drop_low_support",
    f"WITH {FXW}, t AS (SELECT fxw.*, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM fxw JOIN orders ON o_orderkey = l_orderkey) "
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", COALESCE(SUM(CASE WHEN {c} <> 0 THEN y END), 0)::BIGINT AS support FROM t" for c in WIDE),
)
def q_drop_low_support(s, d):
    y = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"))
    return profile.support(fx_wide(s, d).join(y, "l_orderkey"), "y", WIDE)


@query("q_drop_low_support_rows", f"WITH {FXW}, t AS (SELECT fxw.*, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM fxw JOIN orders ON o_orderkey = l_orderkey) SELECT l_orderkey, y, w1, w2 FROM t")
def q_drop_low_support_rows(s, d):
    y = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"))
    rows = fx_wide(s, d).join(y, "l_orderkey").select("l_orderkey", "y", "w1", "w2", (F.col("y") * 0).alias("never"))
    return profile.drop_low_support(rows, "y", ["w1", "w2", "never"])


@query("q_detect_binary", f"WITH {FXL} SELECT l_orderkey, l_linenumber, ls FROM fxl")
def q_detect_binary(s, d):
    rows = fx_lines(s, d)
    found = profile.binary_cols(rows, ["flag", "ls", "disc", "qty"])
    return rows.select("l_orderkey", "l_linenumber", *found)


@query("q_detect_categorical", f"WITH {FXO} SELECT o_orderkey, status, priority, segment, nation, nationkey FROM fxo")
def q_detect_categorical(s, d):
    rows = fx_orders(s, d).select("o_orderkey", "status", "priority", "total", "segment", "nation", "nationkey", "split", "hfold")
    return rows.select("o_orderkey", *profile.categorical_cols(rows.drop("split"), 100, ["fold"]))


@query(
    "q_cardinality_class",
    f"WITH {FXO}, p AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", COUNT(DISTINCT {c}) AS n_distinct FROM fxo" for c in ("y", "status", "priority", "nation", "segment"))
    + ") SELECT *, CASE WHEN n_distinct <= 2 THEN 'binary' WHEN n_distinct < 5 THEN 'low' ELSE 'high' END AS kind FROM p",
)
def q_cardinality_class(s, d):
    return profile.cardinality_class(fx_orders(s, d), ["y", "status", "priority", "nation", "segment"])


@query(
    "q_skew_gate",
    f"WITH {FXO} SELECT o_orderkey, total::DOUBLE AS total_gated, round(ln(1 + cubed), 6) AS cubed_gated FROM (SELECT *, (total::DOUBLE / 1000) * (total::DOUBLE / 1000) * (total::DOUBLE / 1000) AS cubed FROM fxo)",
)
def q_skew_gate(s, d):
    k = F.col("total").cast("double") / 1000
    rows = fx_orders(s, d).select("o_orderkey", "total", (k * k * k).alias("cubed"))
    out = profile.skew_gate(rows, ["total", "cubed"])
    return out.select("o_orderkey", "total_gated", F.round("cubed_gated", 6).alias("cubed_gated"))


@query(
    "q_iqr_filter",
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_extendedprice * l_extendedprice * l_extendedprice AS v FROM lineitem),
    q AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM x)
    SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM x, q WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)""",
)
def q_iqr_filter(s, d):
    p = F.col("l_extendedprice")
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", (p * p * p).alias("v"))
    return profile.iqr_filter(rows, "v").drop("v")
