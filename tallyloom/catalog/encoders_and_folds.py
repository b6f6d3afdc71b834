"""Registered queries for encoders, imputation and scaling, candidates and folds (inventories J, K, L, M)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.catalog.fixtures import FXG, FXL, FXO, fx_grid, fx_lines, fx_orders, table
from tallyloom.catalog.joins_and_groups import mean, std
from tallyloom.catalog.registry import plain, query
from tallyloom.operators import encode, folds, impute, search

# --- J: encoders -----------------------------------------------------------------------------------------


TRAIN = "split = 'train'"


def _codes(c: str, where: str) -> str:
    return f"c_{c} AS (SELECT {c}, row_number() OVER (ORDER BY {c}) - 1 AS code FROM (SELECT DISTINCT {c} FROM fxo WHERE {c} IS NOT NULL AND {where}))"


@query(
    "q_label_encode",
    f"WITH {FXO}, {_codes('seg_n', 'TRUE')}, {_codes('nation', 'TRUE')}, {_codes('o_custkey', 'TRUE')} SELECT o_orderkey, COALESCE(c_seg_n.code, -1) AS seg_n_code, c_nation.code AS nation_code, c_o_custkey.code AS o_custkey_code "
    "FROM fxo LEFT JOIN c_seg_n USING (seg_n) LEFT JOIN c_nation USING (nation) LEFT JOIN c_o_custkey USING (o_custkey)",
)
def q_label_encode(s, d):
    cols = ["seg_n", "nation", "o_custkey"]
    return encode.label_encode(fx_orders(s, d).select("o_orderkey", *cols, "split"), cols).drop(*cols, "split")


@query(
    "q_ordinal_unknown_bucket",
    f"WITH {FXO}, {_codes('seg_n', TRAIN)}, c_cust AS (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) - 1 AS code FROM (SELECT DISTINCT o_custkey FROM fxo WHERE split = 'train')) "
    "SELECT o_orderkey, COALESCE(c_seg_n.code, (SELECT COUNT(*) FROM c_seg_n)) AS seg_n_code, COALESCE(c_cust.code, (SELECT COUNT(*) FROM c_cust)) AS o_custkey_code FROM fxo LEFT JOIN c_seg_n USING (seg_n) LEFT JOIN c_cust USING (o_custkey)",
)
def q_ordinal_unknown_bucket(s, d):
    cols = ["seg_n", "o_custkey"]
    return encode.ordinal_encode(fx_orders(s, d).select("o_orderkey", *cols, "split"), cols).drop(*cols, "split")


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("q_one_hot", f"WITH {FXO} SELECT o_orderkey, " + ", ".join(f"COALESCE((seg_n = '{v}')::INTEGER, 0) AS \"seg_n={v}\"" for v in SEGMENTS) + " FROM fxo")
def q_one_hot(s, d):
    return encode.one_hot(fx_orders(s, d).select("o_orderkey", "seg_n", "split"), ["seg_n"]).drop("seg_n", "split")


@query(
    "q_count_encode",
    f"WITH {FXO}, c AS (SELECT o_custkey, COUNT(*) AS n FROM fxo WHERE split = 'train' GROUP BY 1), p AS (SELECT priority, COUNT(*) AS n FROM fxo WHERE split = 'train' GROUP BY 1) "
    "SELECT o_orderkey, COALESCE(c.n, 0) AS o_custkey_count, COALESCE(p.n, 0) AS priority_count FROM fxo LEFT JOIN c USING (o_custkey) LEFT JOIN p USING (priority)",
)
def q_count_encode(s, d):
    cols = ["o_custkey", "priority"]
    return encode.count_encode(fx_orders(s, d).select("o_orderkey", *cols, "split"), cols).drop(*cols, "split")


# The target sums of the encoders: level totals (l), own-fold totals (f), per-fold totals (p), all training rows (g).
OOF = f"""{FXO}, x AS (SELECT o_orderkey, split, o_custkey, seg_n, total, y, CASE WHEN split = 'train' THEN hfold END AS fold FROM fxo), tr AS (SELECT * FROM x WHERE split = 'train'),
g AS (SELECT SUM(total) AS t, COUNT(*) AS n, SUM(y) AS yt FROM tr), pf AS (SELECT fold, SUM(y) AS t, COUNT(*) AS n FROM tr GROUP BY 1)"""


def _level(c: str, y: str) -> str:
    return (
        f"l_{c} AS (SELECT {c}, SUM({y}) AS t, COUNT(*) AS n FROM tr WHERE {c} IS NOT NULL GROUP BY 1), "
        f"f_{c} AS (SELECT {c}, fold, SUM({y}) AS t, COUNT(*) AS n FROM tr WHERE {c} IS NOT NULL GROUP BY ALL)"
    )


def _oof_join(c: str) -> str:
    return f"LEFT JOIN l_{c} ON l_{c}.{c} = x.{c} LEFT JOIN f_{c} ON f_{c}.{c} = x.{c} AND f_{c}.fold = x.fold"


def _rest(c: str) -> tuple[str, str]:
    return f"(l_{c}.t - COALESCE(f_{c}.t, 0))::DOUBLE", f"(l_{c}.n - COALESCE(f_{c}.n, 0))"


def _oof_rows(s, d):
    rows = fx_orders(s, d).withColumn("fold", F.when(F.col("split") == "train", F.col("hfold")))
    return rows.select("o_orderkey", "split", "o_custkey", "seg_n", "total", "y", "fold")


@query(
    "q_target_mean_oof",
    f"WITH {OOF}, {_level('o_custkey', 'total')}, {_level('seg_n', 'total')} SELECT o_orderkey, "
    + ", ".join("round(COALESCE({} / NULLIF({}, 0), g.t::DOUBLE / g.n), 6) AS {}_target".format(*_rest(c), c) for c in ("o_custkey", "seg_n"))
    + f" FROM x CROSS JOIN g {_oof_join('o_custkey')} {_oof_join('seg_n')}",
)
def q_target_mean_oof(s, d):
    out = encode.target_mean_oof(_oof_rows(s, d), ["o_custkey", "seg_n"], "total", "fold")
    return plain(out.select("o_orderkey", "o_custkey_target", "seg_n_target"), 6)


@query(
    "q_likelihood_smooth",
    f"WITH {OOF}, {_level('o_custkey', 'y')}, z AS (SELECT x.*, (g.yt - COALESCE(pf.t, 0))::DOUBLE / (g.n - COALESCE(pf.n, 0)) AS prior FROM x CROSS JOIN g LEFT JOIN pf ON pf.fold = x.fold) "
    "SELECT o_orderkey, round((COALESCE({0}, 0) + 30.0::DOUBLE * prior) / (COALESCE({1}, 0) + 30.0::DOUBLE), 9) AS o_custkey_likelihood FROM z x {2}".format(*_rest("o_custkey"), _oof_join("o_custkey")),
)
def q_likelihood_smooth(s, d):
    return plain(encode.likelihood(_oof_rows(s, d), ["o_custkey"], "y", "fold").select("o_orderkey", "o_custkey_likelihood"), 9)


@query(
    "q_leave_one_out",
    f"WITH {OOF}, {_level('o_custkey', 'total')} SELECT o_orderkey, round(COALESCE((l_o_custkey.t - CASE WHEN split = 'train' THEN total ELSE 0 END)::DOUBLE / NULLIF(l_o_custkey.n - (split = 'train')::INTEGER, 0), g.t::DOUBLE / g.n), 6) AS o_custkey_loo "
    "FROM x CROSS JOIN g LEFT JOIN l_o_custkey ON l_o_custkey.o_custkey = x.o_custkey",
)
def q_leave_one_out(s, d):
    return plain(encode.leave_one_out(_oof_rows(s, d), ["o_custkey"], "total").select("o_orderkey", "o_custkey_loo"), 6)


KEY_SETS = [["nation"], ["regionkey"], ["sid"], ["regionkey", "woy"], ["nation", "woy"], ["sid", "woy"], ["woy"]]


@query(
    "q_mean_std_encode",
    f"WITH {FXG}, x AS (SELECT *, w % 52 AS woy, CASE WHEN NOT (w > 300) THEN sales END AS v FROM fxg), "
    + ", ".join(f"e{i} AS (SELECT {', '.join(ks)}, {mean('v')} AS m, {std('v')} AS sd FROM x GROUP BY ALL)" for i, ks in enumerate(KEY_SETS))
    + " SELECT x.sid, x.w, " + ", ".join(f"e{i}.m AS enc_{'_'.join(ks)}_mean, e{i}.sd AS enc_{'_'.join(ks)}_std" for i, ks in enumerate(KEY_SETS))
    + " FROM x " + " ".join(f"JOIN e{i} ON " + " AND ".join(f"e{i}.{k} = x.{k}" for k in ks) for i, ks in enumerate(KEY_SETS)),
)
def q_mean_std_encode(s, d):
    grid = fx_grid(s, d).withColumn("woy", F.col("w") % 52)
    return encode.mean_std_encode(grid, KEY_SETS, "sales", F.col("w") > 300).drop("sales", "nation", "regionkey", "woy")


@query("q_binary_to_float", "SELECT l_orderkey, l_linenumber, l_partkey, (l_linestatus = (SELECT MIN(l_linestatus) FROM lineitem))::INTEGER::DOUBLE AS l_linestatus_bin FROM lineitem")
def q_binary_to_float(s, d):
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus")
    return encode.binary_encode(rows, ["l_linestatus"]).drop("l_linestatus")


# Orders with two anonymous numeric columns for the uniqueness features.
UNI = f"""{FXO}, x AS (SELECT o_orderkey, split, y, floor(total::DOUBLE / 20) AS v0, acctbal::DOUBLE AS v1 FROM fxo),
u AS (SELECT o_orderkey FROM (SELECT *, COUNT(*) OVER (PARTITION BY v0) AS n0, COUNT(*) OVER (PARTITION BY v1) AS n1 FROM x WHERE split = 'test') WHERE n0 = 1 OR n1 = 1),
rf AS (SELECT * FROM x WHERE split = 'train' OR o_orderkey IN (SELECT o_orderkey FROM u))"""
UNI_COLS = ["v0", "v1"]


def _anonymous(s, d):
    rows = fx_orders(s, d)
    return rows.select("o_orderkey", "split", "y", F.floor(F.col("total").cast("double") / 20).cast("double").alias("v0"), F.col("acctbal").cast("double").alias("v1"))


def _pattern(c: str) -> str:
    return f"""CASE WHEN COALESCE(r_{c}.n, 0) < 2 THEN 4 ELSE
      2 * (COALESCE(t_{c}.n1, 0) - (split = 'train' AND y = 1)::INTEGER > 0)::INTEGER + (COALESCE(t_{c}.n0, 0) - (split = 'train' AND y = 0)::INTEGER > 0)::INTEGER END AS {c}_pattern"""


@query(
    "q_uniqueness_pattern",
    f"WITH {UNI}, " + ", ".join(
        f"t_{c} AS (SELECT {c}, COUNT(*) FILTER (WHERE y = 1) AS n1, COUNT(*) FILTER (WHERE y = 0) AS n0 FROM x WHERE split = 'train' GROUP BY 1), r_{c} AS (SELECT {c}, COUNT(*) AS n FROM rf GROUP BY 1)" for c in UNI_COLS
    ) + f" SELECT o_orderkey, {', '.join(_pattern(c) for c in UNI_COLS)} FROM x " + " ".join(f"LEFT JOIN t_{c} USING ({c}) LEFT JOIN r_{c} USING ({c})" for c in UNI_COLS),
)
def q_uniqueness_pattern(s, d):
    out = encode.uniqueness_pattern(_anonymous(s, d), UNI_COLS, "y", "o_orderkey")
    return out.drop("split", "y", *UNI_COLS)


@query(
    "q_unique_to_mean",
    f"WITH {UNI}, m AS (SELECT AVG(v0) AS v0, AVG(v1) AS v1 FROM x WHERE split = 'train'), " + ", ".join(f"r_{c} AS (SELECT {c}, COUNT(*) AS n FROM rf GROUP BY 1)" for c in UNI_COLS)
    + " SELECT o_orderkey, " + ", ".join(f"round(CASE WHEN COALESCE(r_{c}.n, 0) >= 2 THEN x.{c} ELSE m.{c} END, 6) AS {c}_shared" for c in UNI_COLS)
    + " FROM x CROSS JOIN m " + " ".join(f"LEFT JOIN r_{c} ON r_{c}.{c} = x.{c}" for c in UNI_COLS),
)
def q_unique_to_mean(s, d):
    out = encode.unique_to_mean(_anonymous(s, d), UNI_COLS, "y", "o_orderkey")
    return plain(out.drop("split", "y", *UNI_COLS), 6)


@query("q_real_row_detect", f"WITH {UNI} SELECT o_orderkey, CASE WHEN split = 'test' THEN (o_orderkey IN (SELECT o_orderkey FROM u))::INTEGER END AS is_real FROM x")
def q_real_row_detect(s, d):
    return encode.real_rows(_anonymous(s, d), UNI_COLS, "o_orderkey").select("o_orderkey", "is_real")


@query(
    "q_ordered_category_align",
    f"WITH {FXO}, x AS (SELECT o_orderkey, split, CASE WHEN split = 'test' AND o_orderkey % 2 = 0 THEN '9-NEW' ELSE priority END AS priority FROM fxo), "
    "c AS (SELECT priority, row_number() OVER (ORDER BY priority) - 1 AS code FROM (SELECT DISTINCT priority FROM x WHERE split = 'train')) SELECT o_orderkey, COALESCE(code, -1) AS priority_code FROM x LEFT JOIN c USING (priority)",
)
def q_ordered_category_align(s, d):
    new = F.when((F.col("split") == "test") & (F.col("o_orderkey") % 2 == 0), "9-NEW").otherwise(F.col("priority"))
    rows = fx_orders(s, d).select("o_orderkey", "split", new.alias("priority"))
    return encode.align_categories(rows, ["priority"]).drop("split", "priority")


# --- K: imputation and scaling -------------------------------------------------------------------------------


@query("q_impute_mean", f"WITH {FXO}, m AS (SELECT {mean('bal_n')} AS m FROM fxo WHERE split = 'train') SELECT o_orderkey, COALESCE(bal_n::DOUBLE, m) AS bal_n FROM fxo CROSS JOIN m")
def q_impute_mean(s, d):
    return impute.impute_mean(fx_orders(s, d).select("o_orderkey", "bal_n", "split"), ["bal_n"]).drop("split")


@query(
    "q_impute_mode",
    f"WITH {FXO}, m AS (SELECT seg_n FROM fxo WHERE split = 'train' AND seg_n IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, seg_n LIMIT 1) SELECT o_orderkey, COALESCE(fxo.seg_n, m.seg_n) AS seg_n, priority FROM fxo CROSS JOIN m",
)
def q_impute_mode(s, d):
    return impute.impute_mode(fx_orders(s, d).select("o_orderkey", "seg_n", "priority", "split"), ["seg_n", "priority"]).drop("split")


@query(
    "q_impute_cascade",
    f"""WITH {FXO}, x AS (SELECT *, CASE WHEN o_orderkey % 7 <> 0 AND NOT (nationkey < 3 AND priority = '1-URGENT') THEN acctbal END AS b FROM fxo),
    f AS (SELECT nation, priority, median(b::DOUBLE) AS m FROM x GROUP BY ALL), c AS (SELECT nation, median(b::DOUBLE) AS m FROM x GROUP BY 1)
    SELECT o_orderkey, round(COALESCE(b::DOUBLE, f.m, c.m), 4) AS b FROM x JOIN f USING (nation, priority) JOIN c ON c.nation = x.nation""",
)
def q_impute_cascade(s, d):
    hole = (F.col("o_orderkey") % 7 != 0) & ~((F.col("nationkey") < 3) & (F.col("priority") == "1-URGENT"))
    rows = fx_orders(s, d).select("o_orderkey", "nation", "priority", F.when(hole, F.col("acctbal")).alias("b"))
    return plain(impute.impute_cascade(rows, ["b"], [["nation", "priority"], ["nation"]]).select("o_orderkey", "b"), 4)


@query("q_standardize_target", f"WITH {FXO}, m AS (SELECT {mean('total')} AS m, {std('total', ddof=0)} AS sd FROM fxo WHERE split = 'train') SELECT o_orderkey, (total::DOUBLE - m) / sd AS total_std, round(total::DOUBLE, 4) AS back FROM fxo CROSS JOIN m")
def q_standardize_target(s, d):
    rows = fx_orders(s, d).select("o_orderkey", "total", "split")
    scaled = impute.standardize(rows, ["total"])
    back = impute.unstandardize(scaled, "total_std", rows.where("split = 'train'"), "total", "back")
    return back.select("o_orderkey", "total_std", F.round("back", 4).alias("back"))


@query(
    "q_minmax",
    f"""WITH {FXO}, m AS (SELECT MIN(acctbal)::DOUBLE AS lo, MAX(acctbal)::DOUBLE AS hi FROM fxo WHERE split = 'train'), x AS (SELECT o_orderkey, (acctbal::DOUBLE - lo) / (hi - lo) AS v FROM fxo CROSS JOIN m)
    SELECT o_orderkey, v AS acctbal_mm, round(ln(1 + greatest(v, 0)), 6) AS acctbal_log, round(sqrt(greatest(v, 0)), 6) AS acctbal_sqrt FROM x""",
)
def q_minmax(s, d):
    rows = fx_orders(s, d).select("o_orderkey", "acctbal", "split")
    out = impute.minmax(rows, ["acctbal"])
    out = impute.minmax(impute.minmax(out, ["acctbal"], then="log1p", suffix="_log"), ["acctbal"], then="sqrt", suffix="_sqrt")
    return out.select("o_orderkey", "acctbal_mm", F.round("acctbal_log", 6).alias("acctbal_log"), F.round("acctbal_sqrt", 6).alias("acctbal_sqrt"))


@query(
    "q_positive_max_scale",
    f"""WITH {FXO}, x AS (SELECT o_orderkey, split, acctbal::DOUBLE AS many, CASE WHEN o_orderkey % 11 = 0 THEN -5 ELSE total::DOUBLE END AS one, CASE WHEN o_orderkey % 13 = 0 THEN 9999999999.0 ELSE total::DOUBLE END AS top FROM fxo),
    m AS (SELECT MAX(many) AS many, MAX(one) AS one, MAX(CASE WHEN top < 9999999999.0 THEN top END) + 1 AS top FROM x WHERE split = 'train')
    SELECT o_orderkey, x.many / m.many AS many_pms, CASE WHEN x.one < 0 THEN -1 ELSE x.one / m.one END AS one_pms, CASE WHEN x.top >= 9999999999.0 THEN 1 ELSE x.top / m.top END AS top_pms FROM x CROSS JOIN m""",
)
def q_positive_max_scale(s, d):
    key, total = F.col("o_orderkey"), F.col("total").cast("double")
    rows = fx_orders(s, d).select(
        "o_orderkey", "split", F.col("acctbal").cast("double").alias("many"), F.when(key % 11 == 0, -5.0).otherwise(total).alias("one"),
        F.when(key % 13 == 0, 9999999999.0).otherwise(total).alias("top"),
    )
    return impute.positive_max_scale(rows, ["many", "one", "top"]).select("o_orderkey", "many_pms", "one_pms", "top_pms")


@query("q_target_log", f"WITH {FXO} SELECT o_orderkey, round(ln(1 + total::DOUBLE), 6) AS total_log, round(sqrt(total::DOUBLE), 6) AS total_sqrt, total::DOUBLE AS back_log, total::DOUBLE AS back_sqrt FROM fxo")
def q_target_log(s, d):
    rows = fx_orders(s, d).select("o_orderkey", "total")
    out = impute.transform_target(impute.transform_target(rows, "total", "log1p", "total_log"), "total", "sqrt", "total_sqrt")
    out = impute.inverse_target(impute.inverse_target(out, "total_log", "log1p", "back_log"), "total_sqrt", "sqrt", "back_sqrt")
    return out.select("o_orderkey", *[F.round(c, n).alias(c) for c, n in (("total_log", 6), ("total_sqrt", 6), ("back_log", 2), ("back_sqrt", 2))])


@query("q_unit_column_norm", f"WITH {FXL}, m AS (SELECT sqrt(SUM(price * price)::DOUBLE) AS p, sqrt(SUM(qty * qty)::DOUBLE) AS q FROM fxl) SELECT l_orderkey, l_linenumber, price::DOUBLE / p AS price_unit, qty::DOUBLE / q AS qty_unit FROM fxl CROSS JOIN m")
def q_unit_column_norm(s, d):
    rows = fx_lines(s, d).select("l_orderkey", "l_linenumber", "price", "qty")
    return impute.unit_norm(rows, ["price", "qty"]).drop("price", "qty")


@query("q_shift_nonnegative", f"WITH {FXO}, m AS (SELECT MIN(bal_n) AS m, MIN(total_s) AS t FROM fxo) SELECT o_orderkey, (bal_n - m)::DOUBLE AS bal_n, (total_s - t)::DOUBLE AS total_s FROM fxo CROSS JOIN m")
def q_shift_nonnegative(s, d):
    return plain(impute.shift_nonnegative(fx_orders(s, d).select("o_orderkey", "bal_n", "total_s", "split"), ["bal_n", "total_s"]).drop("split"))


@query(
    "impute_iterative",
    f"""WITH {FXO} SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN total::DOUBLE END AS a_known, CASE WHEN o_orderkey % 5 <> 1 THEN acctbal::DOUBLE END AS b_known,
      1 AS filled, 1 AS independent FROM fxo""",
)
def impute_iterative(s, d):
    """Known cells stay, holes are filled, and training rows do not move when the test rows change (scope "split")."""
    key = F.col("o_orderkey")
    rows = fx_orders(s, d).select(
        "o_orderkey", "split", F.when(key % 7 != 0, F.col("total").cast("double")).alias("a"), F.when(key % 5 != 1, F.col("acctbal").cast("double")).alias("b"),
        F.col("nationkey").cast("double").alias("c"),
    )
    moved = rows.withColumn("a", F.when(F.col("split") == "test", F.col("a") * 10).otherwise(F.col("a")))
    out, other = (impute.impute_iterative(r, ["a", "b", "c"], 2, "split") for r in (rows, moved))
    both = out.join(other.select("o_orderkey", F.col("a").alias("a2"), F.col("b").alias("b2")), "o_orderkey").withColumn("size", F.abs("a") + F.abs("b") + 1)
    same = (F.col("split") == "test") | (F.abs(F.col("a") - F.col("a2")) + F.abs(F.col("b") - F.col("b2")) < 1e-6 * F.col("size"))
    return both.select(
        "o_orderkey", F.when(key % 7 != 0, F.col("a")).alias("a_known"), F.when(key % 5 != 1, F.col("b")).alias("b_known"),
        (F.col("a").isNotNull() & F.col("b").isNotNull()).cast("int").alias("filled"), same.cast("int").alias("independent"),
    )


@query(
    "quantile_normal",
    f"""WITH {FXO}, x AS (SELECT CAST(floor(total / 20000) AS BIGINT) AS bucket, COUNT(*) AS n FROM fxo GROUP BY 1) SELECT bucket, n, 1 AS in_order, 1 AS in_bounds FROM x""",
)
def quantile_normal(s, d):
    """Scores per price bucket: none below those of the bucket before, all inside the edges of the grid."""
    out = impute.quantile_normal(fx_orders(s, d).select("o_orderkey", "total", "acctbal", "split"), ["total", "acctbal"], n=200)
    ends = out.groupBy(F.floor(F.col("total") / 20000).cast("bigint").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.min("total_qn").alias("low"), F.max("total_qn").alias("high"), F.max(F.abs("acctbal_qn")).alias("other")
    )
    before = F.lag("high").over(Window.orderBy("bucket"))  # one row per bucket
    return ends.select(
        "bucket", "n", (F.col("low") >= F.coalesce(before, F.col("low"))).cast("int").alias("in_order"),
        (F.greatest(F.abs("low"), F.abs("high"), "other") < 5.2).cast("int").alias("in_bounds"),
    )


VECTOR = 64


def _vectors(s, d):
    return impute.expand_vector(table(s, d, "embeddings"), "embedding", VECTOR, "e")


@query("pca_features", "SELECT COUNT(*) AS n, 1 AS centred, 1 AS uncorrelated, 1 AS falling FROM embeddings")
def pca_features(s, d):
    """Two components over all vectors: mean zero, uncorrelated, the first one with the larger spread."""
    out = impute.pca(_vectors(s, d), [f"e{i}" for i in range(VECTOR)], 2).select("vec_id", "pca_0", "pca_1")
    return out.agg(
        F.count(F.lit(1)).alias("n"), (F.abs(F.avg("pca_0")) + F.abs(F.avg("pca_1")) < 1e-6).cast("int").alias("centred"),
        (F.abs(F.corr("pca_0", "pca_1")) < 1e-6).cast("int").alias("uncorrelated"), (F.stddev_pop("pca_0") >= F.stddev_pop("pca_1")).cast("int").alias("falling"),
    )


@query("kmeans_features", "SELECT vec_id, 9 AS n_valid FROM embeddings")
def kmeans_features(s, d):
    """How many of the nine cluster numbers of a vector lie below their number of clusters."""
    ks = list(range(2, 11))
    out = impute.kmeans_ids(_vectors(s, d), [f"e{i}" for i in range(VECTOR)], ks)
    return out.select("vec_id", sum((F.col(f"kmeans_{k}").between(0, k - 1).cast("int") for k in ks), F.lit(0)).alias("n_valid"))


@query("svd_features", "SELECT CAST(j AS INTEGER) AS j, (SELECT COUNT(*) FROM embeddings) AS n, 1 AS standard, 1 AS orthogonal, 1 AS falling FROM range(0, 30) r(j)")
def svd_features(s, d):
    """Thirty coordinates over all vectors: standardised, and before that at right angles over the rows and of falling length."""
    vectors = _vectors(s, d)
    cols, k = [f"e{i}" for i in range(VECTOR)], 30
    raw = impute.svd(vectors, cols, k, "raw", standardised=False).select(*[f"raw_{j}" for j in range(k)])
    out = impute.svd(vectors, cols, k)
    length = [F.sqrt(F.sum(F.col(f"raw_{j}") * F.col(f"raw_{j}"))) for j in range(k)]
    angles = raw.agg(F.array(*[
        F.struct(
            F.lit(j).alias("j"),
            F.greatest(F.lit(0.0), *[F.abs(F.sum(F.col(f"raw_{i}") * F.col(f"raw_{j}"))) / (length[i] * length[j]) for i in range(k) if i != j]).alias("skew"),
            (length[j] / length[max(j - 1, 0)]).alias("step"),
        ) for j in range(k)
    ]).alias("t")).select(F.inline("t"))
    tests = [
        F.struct(F.lit(j).alias("j"), F.count(F.lit(1)).alias("n"), ((F.abs(F.avg(f"svd_{j}")) < 1e-6) & (F.abs(F.stddev_pop(f"svd_{j}") - 1) < 1e-6)).cast("int").alias("standard"))
        for j in range(k)
    ]
    standard = out.agg(F.array(*tests).alias("t")).select(F.inline("t"))
    return standard.join(angles, "j").select("j", "n", "standard", (F.col("skew") < 1e-6).cast("int").alias("orthogonal"), (F.col("step") <= 1 + 1e-9).cast("int").alias("falling"))


# --- L: candidates ------------------------------------------------------------------------------------------------

FNS = ["freq", "abs", "log", "sqrt", "square", "sigmoid", "round", "residual"]


@query(
    "q_candidate_unary",
    f"""WITH {FXO}, x AS (SELECT o_orderkey, acctbal, acctbal::DOUBLE AS b FROM fxo), f AS (SELECT acctbal, COUNT(*)::DOUBLE / (SELECT COUNT(*) FROM fxo) AS share FROM fxo GROUP BY 1)
    SELECT o_orderkey, share AS "freq(acctbal)", abs(b) AS "abs(acctbal)", round(ln(abs(b)), 6) AS "log(acctbal)", round(sqrt(abs(b)), 6) AS "sqrt(acctbal)", round(b * b, 4) AS "square(acctbal)",
    round(1 / (1 + exp(-b)), 6) AS "sigmoid(acctbal)", round_even(b, 0) AS "round(acctbal)", round(b - floor(b), 6) AS "residual(acctbal)" FROM x JOIN f USING (acctbal)""",
)
def q_candidate_unary(s, d):
    out = search.candidates_unary(fx_orders(s, d).select("o_orderkey", "acctbal", "split"), ["acctbal"], FNS).drop("acctbal", "split")
    digits = {"log": 6, "sqrt": 6, "square": 4, "sigmoid": 6, "residual": 6}
    return out.withColumns({f"{f}(acctbal)": F.round(F.col(f"`{f}(acctbal)`"), n) for f, n in digits.items()})


CATS = ["status", "segment", "priority"]


@query(
    "q_candidate_combine",
    f"WITH {FXO} SELECT o_orderkey, " + ", ".join(f"dense_rank() OVER (ORDER BY {a} || '_' || {b}) - 1 AS \"combine({a},{b})\"" for a, b in combinations(CATS, 2)) + " FROM fxo",
)
def q_candidate_combine(s, d):
    return search.candidates_combine(fx_orders(s, d).select("o_orderkey", *CATS, "split"), CATS).drop(*CATS, "split")


def _usefulness(c: str) -> str:
    return f"""SELECT '{c}' AS candidate, round((SUM(t * t / n) - SUM(t) * SUM(t) / SUM(n)) / (SUM(tt) - SUM(t) * SUM(t) / SUM(n)), 6) AS score FROM (
      SELECT SUM(total)::DOUBLE AS t, SUM(total * total)::DOUBLE AS tt, COUNT(total) AS n FROM (
        SELECT total, COALESCE(least(floor(({c}::DOUBLE - lo) / NULLIF(hi - lo, 0) * 16), 15), -1) AS b FROM fxo, (SELECT MIN({c}::DOUBLE) AS lo, MAX({c}::DOUBLE) AS hi FROM fxo)) GROUP BY b)"""


SCORED = ["acctbal", "bal_n", "nationkey", "y", "o_custkey", "hfold"]


@query("q_score_candidates", f"WITH {FXO}, s AS ({' UNION ALL '.join(_usefulness(c) for c in SCORED)}) SELECT * FROM s")
def q_score_candidates(s, d):
    return plain(search.score_candidates(fx_orders(s, d), "total", SCORED), 6)


@query("q_best_candidates", f"WITH {FXO}, s AS ({' UNION ALL '.join(_usefulness(c) for c in SCORED)}) SELECT * FROM s ORDER BY score DESC, candidate LIMIT 3")
def q_best_candidates(s, d):
    scores = search.score_candidates(fx_orders(s, d), "total", SCORED)
    return plain(search.best_candidates(scores, 3), 6)


@query(
    "feature_transform",
    f"""WITH {FXO} SELECT o_orderkey, round(sqrt(abs(acctbal::DOUBLE)), 6) AS "sqrt(acctbal)", round(total::DOUBLE - floor(total::DOUBLE), 6) AS "residual(total)",
    dense_rank() OVER (ORDER BY status || '_' || segment) - 1 AS "combine(status,segment)" FROM fxo""",
)
def feature_transform(s, d):
    rows = fx_orders(s, d).select("o_orderkey", "acctbal", "total", "status", "segment", "split")
    out = search.apply_candidates(rows, ["sqrt(acctbal)", "residual(total)", "combine(status,segment)"])
    return plain(out.drop("acctbal", "total", "status", "segment", "split"), 6)


# --- M: folds --------------------------------------------------------------------------------------------------------


def _hash(key: str, seed: int) -> str:
    return f"('0x' || substr(md5({key}::VARCHAR || ':{seed}'), 1, 8))::BIGINT"


@query("q_kfold", f"SELECT o_orderkey, CAST({_hash('o_orderkey', 42)} % 10 AS INTEGER) AS fold FROM orders")
def q_kfold(s, d):
    return folds.kfold(table(s, d, "orders").select("o_orderkey"), ["o_orderkey"], 10, 42)


@query(
    "q_stratified_kfold",
    f"WITH {FXO} SELECT o_orderkey, y, CAST((row_number() OVER (PARTITION BY y ORDER BY {_hash('o_orderkey', 42)}, o_orderkey) - 1) % 10 AS INTEGER) AS fold FROM fxo",
)
def q_stratified_kfold(s, d):
    return folds.stratified(fx_orders(s, d).select("o_orderkey", "y"), ["o_orderkey"], "y", 10, 42)


@query(
    "q_group_kfold",
    f"""WITH {FXO}, n AS (SELECT month(odate)::INTEGER AS mon, COUNT(*) AS n FROM fxo GROUP BY 1), g AS (SELECT mon, row_number() OVER (ORDER BY n DESC, mon) - 1 AS i FROM n)
    SELECT o_orderkey, CAST(CASE WHEN (i // 6) % 2 = 0 THEN i % 6 ELSE 5 - i % 6 END AS INTEGER) AS fold FROM fxo JOIN g ON g.mon = month(odate)""",
)
def q_group_kfold(s, d):
    rows = fx_orders(s, d).select("o_orderkey", F.month("odate").alias("mon"))
    return folds.group_kfold(rows, "mon", 6).drop("mon")


RANGES = [(200, 210), (280, 300), (300, 320), (320, 340), (340, 358)]


@query(
    "q_time_folds",
    f"WITH {FXG}, f AS (SELECT * FROM (VALUES {', '.join(f'({i}, {a}, {b})' for i, (a, b) in enumerate(RANGES))}) t(fold, a, b)) "
    "SELECT sid, w, fold, CASE WHEN w BETWEEN 100 AND a THEN 'train' ELSE 'val' END AS role FROM fxg JOIN f ON w BETWEEN 100 AND a OR (w > a AND w <= b)",
)
def q_time_folds(s, d):
    return folds.time_folds(fx_grid(s, d).select("sid", "w"), "w", RANGES, 100)


@query("q_segment_folds", f"WITH {FXO}, x AS (SELECT *, CAST({_hash('o_orderkey', 7)} % 5 AS INTEGER) AS fold FROM fxo) SELECT o_orderkey, fold, CASE WHEN segment = 'BUILDING' THEN fold + 5 END AS segment_fold FROM x")
def q_segment_folds(s, d):
    rows = fx_orders(s, d).select("o_orderkey", "segment")
    return folds.segment_folds(rows, ["o_orderkey"], F.col("segment") == "BUILDING", 5, 7).drop("segment")


@query(
    "q_head_tail_split",
    f"WITH {FXO} SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY odate, o_orderkey) <= floor((SELECT COUNT(*) FROM fxo) * 0.75) THEN 'train' ELSE 'val' END AS part FROM fxo",
)
def q_head_tail_split(s, d):
    return folds.head_tail(fx_orders(s, d).select("o_orderkey", "odate"), ["odate", "o_orderkey"], 0.75).drop("odate")
