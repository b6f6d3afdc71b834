"""Registered queries for joins, reshaping and group features (inventories D, E, F)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tallyloom.catalog.fixtures import (
    FXG0, FXL, FXO, FXS, FXW, MODELS, WIDE, fx_lines, fx_orders, fx_scores, fx_weekly, fx_wide, table,
)
from tallyloom.catalog.registry import plain, query
from tallyloom.core import with_scalars
from tallyloom.operators import group, relate, reshape

# --- D: joins ------------------------------------------------------------------------------------


@query("q_left_join_key", "SELECT o_orderkey, o_custkey, c_mktsegment, c_acctbal FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def q_left_join_key(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal")
    return relate.left_join(table(s, d, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"])


PRICES = f"""{FXL}, pr AS (SELECT l_partkey, l_suppkey, year(shipdate) AS yr, SUM(price)::DOUBLE / SUM(qty)::DOUBLE AS unit FROM fxl GROUP BY ALL)"""


def _prices(s, d):
    rows = fx_lines(s, d).withColumn("yr", F.year("shipdate"))
    return rows.groupBy("l_partkey", "l_suppkey", "yr").agg((F.sum("price").cast("double") / F.sum("qty").cast("double")).alias("unit"))


@query(
    "q_left_join_multi",
    f"""WITH {PRICES} SELECT l_orderkey, l_linenumber, fxl.l_partkey, unit FROM fxl
    LEFT JOIN pr ON pr.l_partkey = fxl.l_partkey AND pr.l_suppkey = fxl.l_suppkey AND pr.yr = year(shipdate)""",
)
def q_left_join_multi(s, d):
    rows = fx_lines(s, d).withColumn("yr", F.year("shipdate")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "yr")
    return relate.left_join(rows, _prices(s, d), ["l_partkey", "l_suppkey", "yr"]).drop("l_suppkey", "yr")


@query("q_left_join_keep", "SELECT l_orderkey, l_linenumber, l_partkey, p_brand, p_size FROM lineitem LEFT JOIN part ON p_partkey = l_partkey")
def q_left_join_keep(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    return relate.left_join_keep(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), p, ["l_partkey"])


@query("q_lookup_map", "SELECT l_orderkey, l_linenumber, l_suppkey, COALESCE(s_acctbal, -1.0) AS bal FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON s_suppkey = l_suppkey")
def q_lookup_map(s, d):
    right = table(s, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal")
    return relate.lookup(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), right, "l_suppkey", "s_acctbal", -1.0, "bal")


@query("q_inner_join", "SELECT l_orderkey AS o_orderkey, l_linenumber, l_quantity, o_orderstatus FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def q_inner_join(s, d):
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    return relate.inner_join(lines, table(s, d, "orders").select("o_orderkey", "o_orderstatus"))


@query("q_semi_join", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def q_semi_join(s, d):
    returned = table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return relate.semi(table(s, d, "orders").select("o_orderkey", "o_totalprice"), returned, ["o_orderkey"])


@query("q_anti_join", "SELECT o_orderkey, o_totalprice FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def q_anti_join(s, d):
    returned = table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return relate.anti(table(s, d, "orders").select("o_orderkey", "o_totalprice"), returned, ["o_orderkey"])


@query(
    "q_unique_key_join",
    """WITH a AS (SELECT *, COUNT(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS n FROM orders),
    b AS (SELECT o_custkey, o_orderstatus, o_totalprice, COUNT(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS n FROM orders)
    SELECT a.o_orderkey, a.o_custkey, b.o_totalprice AS partner FROM a LEFT JOIN b
      ON a.o_custkey = b.o_custkey AND a.o_orderstatus = b.o_orderstatus AND b.n = 1 AND a.n = 1""",
)
def q_unique_key_join(s, d):
    rows = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    right = table(s, d, "orders").select("o_custkey", "o_orderstatus", F.col("o_totalprice").alias("partner"))
    return relate.unique_key_join(rows, right, ["o_custkey", "o_orderstatus"]).drop("o_orderstatus")


@query(
    "q_join_then_range_filter",
    f"WITH {FXG0}, r AS (SELECT sid, MIN(w) + 2 AS release FROM fxs GROUP BY sid) SELECT sid, w, sold::DOUBLE AS sold FROM fxs JOIN r USING (sid) WHERE w >= release",
)
def q_join_then_range_filter(s, d):
    weekly = fx_weekly(s, d)
    release = weekly.groupBy("sid").agg((F.min("w") + 2).alias("release"))
    return plain(relate.join_where(weekly, release, ["sid"], F.col("w") >= F.col("release")).select("sid", "w", "sold"))


@query(
    "q_nearest_join",
    """WITH k AS (SELECT c_nationkey AS band, CAST(c_acctbal AS DECIMAL(12,2)) AS bal, MIN(c_custkey) AS c_custkey FROM customer GROUP BY ALL),
    a AS (SELECT s_suppkey, s_nationkey AS band, CAST(s_acctbal AS DECIMAL(12,2)) AS bal FROM supplier),
    r AS (SELECT a.s_suppkey, a.bal, k.bal AS near, k.c_custkey, row_number() OVER (PARTITION BY a.s_suppkey ORDER BY abs(k.bal - a.bal), k.bal) AS rn FROM a LEFT JOIN k ON k.band = a.band)
    SELECT s_suppkey, bal::DOUBLE AS bal, near::DOUBLE AS nearest_bal, c_custkey FROM r WHERE rn = 1""",
)
def q_nearest_join(s, d):
    known = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("band"), F.col("c_acctbal").cast("decimal(12,2)").alias("bal")).agg(F.min("c_custkey").alias("c_custkey"))
    asked = table(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("band"), F.col("s_acctbal").cast("decimal(12,2)").alias("bal"))
    return plain(relate.nearest_join(asked, known, "bal", "c_custkey", ["band"]).drop("band"))


@query(
    "q_band_join",
    """WITH g AS (SELECT p_size, COUNT(*) AS n, SUM(CAST(p_retailprice AS DECIMAL(12,2))) AS t FROM part GROUP BY p_size)
    SELECT p.p_partkey, SUM(g.n)::BIGINT AS n_near, SUM(g.t)::DOUBLE AS t_near FROM part p JOIN g ON abs(g.p_size - p.p_size) <= 2 GROUP BY p.p_partkey""",
)
def q_band_join(s, d):
    part = table(s, d, "part").select("p_partkey", "p_size", F.col("p_retailprice").cast("decimal(12,2)").alias("price"))
    sizes = part.groupBy("p_size").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("t"))
    joined = relate.band_join(part.select("p_partkey", "p_size"), sizes, "p_size", 2)
    return plain(joined.groupBy("p_partkey").agg(F.sum("n").alias("n_near"), F.sum("t").alias("t_near")))


@query(
    "q_cross_join_grid",
    f"""WITH {FXG0}, b AS (SELECT MAX(w) AS hi FROM fxs) SELECT sid, CAST(hi + k AS BIGINT) AS w FROM (SELECT DISTINCT sid FROM fxs), b, (SELECT UNNEST(range(1, 5)) AS k)""",
)
def q_cross_join_grid(s, d):
    weekly = fx_weekly(s, d)
    entities = with_scalars(weekly.select("sid").distinct(), weekly, {"hi": F.max("w")})
    return relate.complete_grid(entities, "w", F.col("_s.hi") + 1, F.col("_s.hi") + 4).drop("_s")


@query("q_cross_join_design", "SELECT p.p_brand, t.p_type FROM (SELECT DISTINCT p_brand FROM part) p, (SELECT DISTINCT p_type FROM part) t")
def q_cross_join_design(s, d):
    part = table(s, d, "part")
    return relate.cross(part.select("p_brand").distinct(), part, "p_type")


@query("q_glue_blocks", f"WITH {FXO} SELECT o_orderkey, total::DOUBLE AS total, segment, nation FROM fxo")
def q_glue_blocks(s, d):
    rows = fx_orders(s, d)
    return plain(relate.glue([rows.select("o_orderkey", "total"), rows.select("o_orderkey", "segment"), rows.select("o_orderkey", "nation")], ["o_orderkey"]))


# --- E: set operations and reshaping ------------------------------------------------------------------


@query("q_union_split", "SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM orders")
def q_union_split(s, d):
    rows = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    train, test = rows.where("o_orderkey % 5 <> 0"), rows.where("o_orderkey % 5 = 0")
    return reshape.union_split(train, test)


@query("q_union_missing", "SELECT o_orderkey, o_totalprice, CAST(NULL AS VARCHAR) AS o_orderstatus FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, NULL, o_orderstatus FROM orders WHERE o_orderkey % 5 = 0")
def q_union_missing(s, d):
    rows = table(s, d, "orders")
    return reshape.union_missing(
        rows.where("o_orderkey % 5 <> 0").select("o_orderkey", "o_totalprice"), rows.where("o_orderkey % 5 = 0").select("o_orderkey", "o_orderstatus")
    )


@query("q_distinct", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def q_distinct(s, d):
    return reshape.distinct(table(s, d, "lineitem"), ["l_partkey", "l_suppkey"])


@query(
    "q_dedupe_first",
    "SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1",
)
def q_dedupe_first(s, d):
    rows = table(s, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return reshape.dedupe_first(rows, ["l_partkey"], ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]).drop("l_extendedprice")


@query("q_only_unique", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY COUNT(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1")
def q_only_unique(s, d):
    return reshape.only_unique(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey", "l_linenumber"])


@query("q_unpivot", f"WITH {FXW} " + " UNION ALL ".join(f"SELECT l_orderkey, '{c}' AS line, {c} AS qty FROM fxw" for c in WIDE))
def q_unpivot(s, d):
    return reshape.unpivot(fx_wide(s, d), ["l_orderkey"], WIDE, "line", "qty")


@query(
    "q_pivot",
    f"WITH {FXS} SELECT dataset, " + ", ".join(f"MAX(CASE WHEN model = '{m}' THEN value END) AS \"{m}\"" for m in MODELS) + " FROM fxc WHERE prep = 'none' AND hpo = 'default' GROUP BY dataset",
)
def q_pivot(s, d):
    rows = fx_scores(s, d).where("prep = 'none' and hpo = 'default'")
    return reshape.pivot(rows, ["dataset"], "model", MODELS, F.first("value"))


@query(
    "q_crosstab_dense",
    """WITH n AS (SELECT p_name, p_type, COUNT(*) AS n FROM part GROUP BY ALL)
    SELECT a.p_name, b.p_type, COALESCE(n.n, 0) AS n FROM (SELECT DISTINCT p_name FROM part) a CROSS JOIN (SELECT DISTINCT p_type FROM part) b LEFT JOIN n ON n.p_name = a.p_name AND n.p_type = b.p_type""",
)
def q_crosstab_dense(s, d):
    return reshape.crosstab_dense(table(s, d, "part"), "p_name", "p_type")


@query(
    "q_transpose",
    f"WITH {FXO}, m AS (SELECT nationkey, SUM(total)::DOUBLE AS total, SUM(acctbal)::DOUBLE AS acctbal, SUM(y)::DOUBLE AS y FROM fxo GROUP BY 1) "
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", " + ", ".join(f"MAX(CASE WHEN nationkey = {i} THEN {c} END) AS \"{i}\"" for i in range(25)) + " FROM m" for c in ("total", "acctbal", "y")),
)
def q_transpose(s, d):
    m = fx_orders(s, d).groupBy("nationkey").agg(*[F.sum(c).cast("double").alias(c) for c in ("total", "acctbal", "y")])
    return reshape.transpose(m, "nationkey", ["total", "acctbal", "y"])


@query("q_append_known_rows", f"WITH {FXO} SELECT o_orderkey, total::DOUBLE AS total, y FROM fxo WHERE split = 'train' OR status = 'P'")
def q_append_known_rows(s, d):
    rows = fx_orders(s, d)
    train = rows.where("split = 'train'").select("o_orderkey", "total", "y")
    test = rows.where("split = 'test'").select("o_orderkey", "total", F.lit(None).cast("int").alias("y"))
    known = rows.where("split = 'test' and status = 'P'").select("o_orderkey", "y")
    return plain(reshape.append_known(train, test, known, "o_orderkey", "y"))


# --- F: group features ----------------------------------------------------------------------------------

def mean(c: str, over: str = "") -> str:
    return f"SUM({c}){over}::DOUBLE / NULLIF(COUNT({c}){over}, 0)"


def std(c: str, over: str = "", ddof: int = 1) -> str:
    """Same order of operations as the exact-sum statistics of the library."""
    n, t, q = f"COUNT({c}){over}", f"SUM({c}){over}::DOUBLE", f"SUM({c} * {c}){over}::DOUBLE"
    return f"CASE WHEN {n} > {ddof} THEN sqrt(greatest({q} - {t} * {t} / {n}, 0.0) / ({n} - {ddof})) END"


@query(
    "q_group_transform",
    f"""WITH {FXL}, g AS (SELECT l_suppkey, {mean('price')} AS price_l_suppkey_mean, {std('price')} AS price_l_suppkey_std,
      MIN(price)::DOUBLE AS price_l_suppkey_min, MAX(price)::DOUBLE AS price_l_suppkey_max FROM fxl GROUP BY l_suppkey)
    SELECT l_orderkey, l_linenumber, g.* FROM fxl JOIN g USING (l_suppkey)""",
)
def q_group_transform(s, d):
    rows = fx_lines(s, d).select("l_orderkey", "l_linenumber", "l_suppkey", "price")
    return plain(group.group_transform(rows, ["l_suppkey"], "price", ["mean", "std", "min", "max"]).drop("price"))


@query(
    "q_group_agg_encode",
    f"""WITH {FXO}, t AS (SELECT *, CASE WHEN total_s <> -1 THEN total_s END AS v FROM fxo), tr AS (SELECT * FROM t WHERE split = 'train'),
    a AS (SELECT o_custkey, {mean('v')} AS m, {std('v')} AS sd FROM tr GROUP BY o_custkey),
    b AS (SELECT nation, priority, {mean('v')} AS m, {std('v')} AS sd, {mean('acctbal')} AS am FROM tr GROUP BY ALL)
    SELECT o_orderkey, COALESCE(a.m, -1) AS total_s_o_custkey_mean, COALESCE(a.sd, -1) AS total_s_o_custkey_std,
      COALESCE(b.m, -1) AS total_s_nation_priority_mean, COALESCE(b.sd, -1) AS total_s_nation_priority_std, COALESCE(b.am, -1) AS acctbal_nation_priority_mean
    FROM t LEFT JOIN a ON a.o_custkey = t.o_custkey LEFT JOIN b ON b.nation = t.nation AND b.priority = t.priority""",
)
def q_group_agg_encode(s, d):
    rows = fx_orders(s, d).select("o_orderkey", "o_custkey", "nation", "priority", "total_s", "acctbal", "split")
    triples = [
        ("total_s", ["o_custkey"], ["mean", "std"]),
        ("total_s", ["nation", "priority"], ["mean", "std"]),
        ("acctbal", ["nation", "priority"], ["mean"]),
    ]
    out = group.group_encode(rows, triples, "train", null_value=-1, fill=-1.0)
    return out.drop("o_custkey", "nation", "priority", "total_s", "acctbal", "split")


@query(
    "q_group_nunique",
    f"""WITH {FXL}, g AS (SELECT l_suppkey, COUNT(DISTINCT l_partkey) AS l_suppkey_l_partkey_nunique, COUNT(DISTINCT flag) AS l_suppkey_flag_nunique FROM fxl GROUP BY 1)
    SELECT l_orderkey, l_linenumber, g.l_suppkey_l_partkey_nunique AS parts, g.l_suppkey_flag_nunique AS flags FROM fxl JOIN g USING (l_suppkey)""",
)
def q_group_nunique(s, d):
    rows = fx_lines(s, d).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "flag")
    out = group.group_nunique(rows, ["l_suppkey"], ["l_partkey", "flag"])
    return out.select("l_orderkey", "l_linenumber", F.col("l_partkey_l_suppkey_nunique").alias("parts"), F.col("flag_l_suppkey_nunique").alias("flags"))


@query(
    "q_group_count",
    f"""WITH {FXO}, m AS (SELECT *, year(odate) * 12 + month(odate) AS mi FROM fxo), c AS (SELECT mi, COUNT(*) AS n FROM m GROUP BY 1)
    SELECT o_orderkey, c.n AS month_count, COALESCE(p.n, 0) AS prev_month_count FROM m JOIN c ON c.mi = m.mi LEFT JOIN c p ON p.mi = m.mi - 1""",
)
def q_group_count(s, d):
    rows = fx_orders(s, d).select("o_orderkey", (F.year("odate") * 12 + F.month("odate")).alias("mi"))
    counted = group.group_count(rows, ["mi"], name="month_count")
    lagged = rows.groupBy((F.col("mi") + 1).alias("mi")).agg(F.count(F.lit(1)).alias("n"))
    return relate.lookup(counted, lagged, "mi", "n", 0, "prev_month_count").drop("mi")


def _pack(t: str, g: str, null_std: str) -> str:
    return (
        f"COUNT(*) AS {t}_by_{g}_size, {mean(t)} AS {t}_by_{g}_mean, {null_std.format(std(t))} AS {t}_by_{g}_std, "
        f"round(median({t}::DOUBLE), 4) AS {t}_by_{g}_median, MAX({t})::DOUBLE AS {t}_by_{g}_max, MIN({t})::DOUBLE AS {t}_by_{g}_min"
    )


def _rounded_medians(df):
    return plain(df).withColumns({c: F.round(c, 4) for c in df.columns if c.endswith("_median")})


PACK_T, PACK_G = ["price", "qty", "disc"], ["l_suppkey", "flag", "qty"]


@query(
    "q_stats_pack",
    f"WITH {FXL}, " + ", ".join(f"g_{g} AS (SELECT {g}, " + ", ".join(_pack(t, g, "COALESCE({}, 0.0)") for t in PACK_T if t != g) + f" FROM fxl GROUP BY {g})" for g in PACK_G)
    + " SELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(f"g_{g}.* EXCLUDE ({g})" for g in PACK_G)
    + " FROM fxl " + " ".join(f"JOIN g_{g} ON g_{g}.{g} = fxl.{g}" for g in PACK_G),
)
def q_stats_pack(s, d):
    rows = fx_lines(s, d).select("l_orderkey", "l_linenumber", "l_partkey", *PACK_T, "l_suppkey", "flag")
    return _rounded_medians(group.stats_pack(rows, PACK_T, PACK_G).drop(*PACK_T, "l_suppkey", "flag"))


@query(
    "q_stats_by_area",
    f"WITH {FXO}, g AS (SELECT o_custkey, {_pack('total', 'o_custkey', '{}')} FROM fxo GROUP BY 1) SELECT o_orderkey, g.* FROM fxo JOIN g USING (o_custkey)",
)
def q_stats_by_area(s, d):
    return _rounded_medians(group.stats_by(fx_orders(s, d).select("o_orderkey", "o_custkey", "total", "split"), "o_custkey", "total").drop("total", "split"))


@query(
    "q_freq_encode",
    f"""WITH {FXO}, tr AS (SELECT * FROM fxo WHERE split = 'train'), t AS (SELECT COUNT(o_custkey) AS a, COUNT(seg_n) AS b FROM tr),
    a AS (SELECT o_custkey, COUNT(*) AS n FROM tr GROUP BY 1), b AS (SELECT seg_n, COUNT(*) AS n FROM tr WHERE seg_n IS NOT NULL GROUP BY 1)
    SELECT o_orderkey, a.n::DOUBLE / t.a AS o_custkey_freq, b.n::DOUBLE / t.b AS seg_n_freq FROM fxo CROSS JOIN t LEFT JOIN a USING (o_custkey) LEFT JOIN b USING (seg_n)""",
)
def q_freq_encode(s, d):
    rows = fx_orders(s, d).select("o_orderkey", "o_custkey", "seg_n", "split")
    return group.freq_encode(rows, ["o_custkey", "seg_n"], "train").drop("o_custkey", "seg_n", "split")


@query(
    "q_log_count",
    f"WITH {FXL} SELECT l_orderkey, l_linenumber, l_partkey, round(ln(1 + COUNT(*) OVER (PARTITION BY l_partkey)), 6) AS l_partkey_log_count, round(ln(1 + COUNT(*) OVER (PARTITION BY l_suppkey)), 6) AS l_suppkey_log_count FROM fxl",
)
def q_log_count(s, d):
    rows = fx_lines(s, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "split")
    return plain(group.log_count(rows, ["l_partkey", "l_suppkey"]).drop("l_suppkey", "split"), 6)


@query(
    "q_usage_share",
    f"""WITH {FXL} SELECT l_orderkey, l_linenumber, l_partkey,
      COUNT(*) OVER (PARTITION BY l_suppkey, flag)::DOUBLE / COUNT(*) OVER (PARTITION BY l_suppkey) AS l_suppkey_flag_share,
      COUNT(*) OVER (PARTITION BY ls, flag)::DOUBLE / COUNT(*) OVER (PARTITION BY ls) AS ls_flag_share FROM fxl""",
)
def q_usage_share(s, d):
    rows = fx_lines(s, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ls", "flag", "split")
    return group.usage_share(rows, ["l_suppkey", "ls"], "flag").drop("l_suppkey", "ls", "flag", "split")


@query("q_first_seen", f"WITH {FXG0} SELECT sid, MIN(w) AS first_seen, MIN(w) - (SELECT MIN(w) FROM fxs) AS first_offset FROM fxs GROUP BY sid")
def q_first_seen(s, d):
    return group.first_seen(fx_weekly(s, d), ["sid"], "w")


@query(
    "q_norm_by_group",
    f"""WITH {FXL}, x AS (SELECT l_orderkey, l_linenumber, l_partkey, price, l_suppkey, CAST(month(shipdate) AS INTEGER) AS mon FROM fxl)
    SELECT l_orderkey, l_linenumber, l_partkey, price::DOUBLE / MAX(price) OVER (PARTITION BY l_suppkey)::DOUBLE AS price_over_l_suppkey_max,
      price::DOUBLE / ({mean('price', ' OVER (PARTITION BY l_suppkey, mon)')}) AS price_over_l_suppkey_mon_mean FROM x""",
)
def q_norm_by_group(s, d):
    rows = fx_lines(s, d).select("l_orderkey", "l_linenumber", "l_partkey", "price", "l_suppkey", F.month("shipdate").alias("mon"))
    out = group.norm_by(group.norm_by(rows, ["l_suppkey"], "price", "max"), ["l_suppkey", "mon"], "price", "mean")
    return out.drop("price", "l_suppkey", "mon")


@query(
    "q_filtered_group_count_ratio",
    f"WITH {FXO}, g AS (SELECT nation, COUNT(*) FILTER (WHERE total > 300000) AS hits FROM fxo GROUP BY 1) SELECT o_orderkey, g.hits::DOUBLE / NULLIF(total::DOUBLE, 0) AS big_share FROM fxo JOIN g USING (nation)",
)
def q_filtered_group_count_ratio(s, d):
    rows = fx_orders(s, d).select("o_orderkey", "nation", "total")
    return group.filtered_count_ratio(rows, "nation", F.col("total") > 300000, "total", "big_share").drop("nation", "total")


CROSS = ["status", "priority", "segment", "nation"]


@query(
    "q_crosstab_encode",
    f"WITH {FXO}, " + ", ".join(f"p_{a}_{b} AS (SELECT {a}, {b}, COUNT(*) AS n FROM fxo WHERE split = 'train' GROUP BY ALL)" for a, b in combinations(CROSS, 2))
    + " SELECT o_orderkey, " + ", ".join(f"COALESCE(p_{a}_{b}.n, 0) AS {a}_{b}_n, round(ln(1 + COALESCE(p_{a}_{b}.n, 0)), 6) AS {a}_{b}_log" for a, b in combinations(CROSS, 2))
    + " FROM fxo " + " ".join(f"LEFT JOIN p_{a}_{b} ON p_{a}_{b}.{a} = fxo.{a} AND p_{a}_{b}.{b} = fxo.{b}" for a, b in combinations(CROSS, 2)),
)
def q_crosstab_encode(s, d):
    rows = fx_orders(s, d).select("o_orderkey", *CROSS, "split")
    return plain(group.crosstab_encode(rows, CROSS, "train").drop(*CROSS, "split"), 6)


@query(
    "q_entity_smoothing",
    f"""WITH {FXO}, b AS (SELECT o_orderkey, o_custkey, nation, CASE WHEN split = 'train' THEN y::DOUBLE ELSE (o_orderkey * 7919 % 1000) / 1000.0::DOUBLE END AS y, split = 'test' AS p FROM fxo),
    b1 AS (SELECT * REPLACE (AVG(y) OVER (PARTITION BY o_custkey) AS y) FROM b), b2 AS (SELECT * REPLACE (AVG(y) OVER (PARTITION BY nation) AS y) FROM b1)
    SELECT o_orderkey, round(y, 6) AS y FROM b2 WHERE p""",
)
def q_entity_smoothing(s, d):
    rows = fx_orders(s, d)
    labels = rows.where("split = 'train'").select("o_orderkey", "o_custkey", "nation", F.col("y").cast("double").alias("y"))
    preds = rows.where("split = 'test'").select("o_orderkey", "o_custkey", "nation", ((F.col("o_orderkey") * 7919 % 1000) / 1000.0).alias("y"))
    return plain(group.entity_smooth(labels, preds, ["o_custkey", "nation"]).select("o_orderkey", "y"), 6)


@query(
    "q_group_mean_preds",
    f"WITH {FXL} SELECT l_orderkey, {mean('disc')} AS disc, {mean('tax')} AS tax FROM fxl GROUP BY l_orderkey",
)
def q_group_mean_preds(s, d):
    return group.group_mean_preds(fx_lines(s, d), ["l_orderkey"], ["disc", "tax"])


@query(
    "q_fold_summary",
    f"WITH {FXS} SELECT dataset, model, prep, hpo, round(AVG(value), 6) AS score_mean, round(stddev_pop(value), 6) AS score_std FROM fxf GROUP BY ALL",
)
def q_fold_summary(s, d):
    return plain(group.fold_summary(fx_scores(s, d, folds=True), ["dataset", "model", "prep", "hpo"], "value"), 6)


@query(
    "q_group_median_fill_src",
    f"WITH {FXL}, m AS (SELECT l_suppkey, median(price::DOUBLE) AS m FROM fxl GROUP BY 1) SELECT l_orderkey, l_linenumber, l_partkey, round(m, 4) AS mid FROM fxl JOIN m USING (l_suppkey)",
)
def q_group_median_fill_src(s, d):
    rows = fx_lines(s, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price")
    return plain(group.group_median(rows, ["l_suppkey"], "price", "mid").drop("l_suppkey", "price"), 4)


@query(
    "q_global_stats",
    f"WITH {FXO}, g AS (SELECT {mean('total')} AS total_mean, MAX(total)::DOUBLE AS total_max, MIN(total)::DOUBLE AS total_min FROM fxo WHERE split = 'train') SELECT o_orderkey, g.* FROM fxo CROSS JOIN g",
)
def q_global_stats(s, d):
    rows = fx_orders(s, d).select("o_orderkey", "total", "split")
    return plain(group.global_stats(rows, ["total"], ["mean", "max", "min"], "train").drop("total", "split"))


@query("q_class_counts", f"WITH {FXO} SELECT CASE WHEN split = 'train' THEN y END AS y, COUNT(*) AS n FROM fxo GROUP BY 1")
def q_class_counts(s, d):
    return group.class_counts(fx_orders(s, d).withColumn("y", F.when(F.col("split") == "train", F.col("y"))), "y")


@query(
    "q_combo_concat_count",
    f"""WITH {FXO}, x AS (SELECT o_orderkey, concat_ws('_', status, priority, COALESCE(seg_n, 'null')) AS combo FROM fxo)
    SELECT o_orderkey, combo, COUNT(*) OVER (PARTITION BY combo) AS combo_count FROM x""",
)
def q_combo_concat_count(s, d):
    rows = fx_orders(s, d).select("o_orderkey", F.col("status").alias("ind_status"), F.col("priority").alias("ind_priority"), F.col("seg_n").alias("ind_seg"), "split")
    return group.concat_count(rows, "ind_").select("o_orderkey", "combo", "combo_count")
