"""Views over the test tables that stand in for the inputs the operators expect, in Spark and in SQL.

Money and quantities are decimals, so sums are exact.  Nulls and sentinels are injected by fixed rules
on the key; every view keeps all rows of its table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(12,2)"
EPOCH = "1995-01-01"  # first day of the test orders; weeks are counted from here
MODELS = ("Base", "Boost", "Forest", "Linear", "Net", "Auto")
BASE, AUTO = "Base", "Auto"
PREPS = ("none", "fe", "tta")
HPOS = ("default", "light", "extensive")
TRIALS = 12


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _split(key: str) -> Column:
    return F.when(F.col(key) % 5 == 0, "test").otherwise("train").alias("split")


# --- orders with customer and nation ---------------------------------------------------------------

FXO = """fxo AS (
  SELECT o_orderkey, o_custkey, o_orderstatus AS status, o_orderpriority AS priority,
    CAST(o_totalprice AS DECIMAL(12,2)) AS total, CAST(o_orderdate AS DATE) AS odate,
    c_mktsegment AS segment, n_name AS nation, c_nationkey AS nationkey,
    CAST(c_acctbal AS DECIMAL(12,2)) AS acctbal,
    CASE WHEN o_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split,
    CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
    CASE WHEN o_orderkey % 7 <> 0 THEN CAST(c_acctbal AS DECIMAL(12,2)) END AS bal_n,
    CASE WHEN o_orderkey % 9 <> 0 THEN c_mktsegment END AS seg_n,
    CAST(CASE WHEN o_orderkey % 11 = 0 THEN -1 WHEN o_orderkey % 13 = 0 THEN -999999 ELSE o_totalprice END AS DECIMAL(12,2)) AS total_s,
    CAST(('0x' || substr(md5(o_orderkey::VARCHAR || ':1'), 1, 8))::BIGINT % 5 AS INTEGER) AS hfold
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey)"""


def fx_orders(spark: SparkSession, d: str) -> DataFrame:
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    key, bal = F.col("o_orderkey"), F.col("c_acctbal").cast(MONEY)
    joined = o.join(c, F.col("c_custkey") == F.col("o_custkey"), "left").join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return joined.select(
        "o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").cast(MONEY).alias("total"), F.to_date("o_orderdate").alias("odate"),
        F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"), F.col("c_nationkey").alias("nationkey"),
        bal.alias("acctbal"), _split("o_orderkey"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"),
        F.when(key % 7 != 0, bal).alias("bal_n"), F.when(key % 9 != 0, F.col("c_mktsegment")).alias("seg_n"),
        F.when(key % 11 == 0, -1).when(key % 13 == 0, -999999).otherwise(F.col("o_totalprice")).cast(MONEY).alias("total_s"),
        (F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(":1"))), 1, 8), 16, 10).cast("bigint") % 5).cast("int").alias("hfold"),
    )


# --- line items ------------------------------------------------------------------------------------

FXL = """fxl AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS DECIMAL(12,2)) AS qty,
    CAST(l_extendedprice AS DECIMAL(12,2)) AS price, CAST(l_discount AS DECIMAL(12,2)) AS disc,
    CAST(l_tax AS DECIMAL(12,2)) AS tax, l_returnflag AS flag, l_linestatus AS ls, CAST(l_shipdate AS DATE) AS shipdate,
    CASE WHEN l_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split
  FROM lineitem)"""


def fx_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast(MONEY).alias("qty"),
        F.col("l_extendedprice").cast(MONEY).alias("price"), F.col("l_discount").cast(MONEY).alias("disc"),
        F.col("l_tax").cast(MONEY).alias("tax"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("ls"),
        F.to_date("l_shipdate").alias("shipdate"), _split("l_orderkey"),
    )


# --- wide sparse rows: quantity per order and line number -------------------------------------------

WIDE = [f"w{i}" for i in range(1, 8)]
FXW = f"""fxw AS (
  SELECT l_orderkey, {", ".join(f"SUM(CASE WHEN l_linenumber = {i} THEN CAST(l_quantity AS INTEGER) ELSE 0 END)::BIGINT AS w{i}" for i in range(1, 8))},
    CASE WHEN l_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split
  FROM lineitem GROUP BY l_orderkey)"""


def fx_wide(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        *[F.sum(F.when(F.col("l_linenumber") == i, F.col("l_quantity").cast("int")).otherwise(0)).alias(f"w{i}") for i in range(1, 8)]
    )
    return wide.withColumn("split", _split("l_orderkey"))


# --- weekly sales grid per supplier ------------------------------------------------------------------

FXG0 = """fxs AS (
  SELECT l_suppkey AS sid, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) // 7 AS BIGINT) AS w,
    SUM(CAST(l_quantity AS DECIMAL(12,2))) AS sold, SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS revenue
  FROM lineitem GROUP BY 1, 2)"""
FXG = FXG0 + """, fxg AS (
  SELECT e.sid, p.w, CASE WHEN p.w <= b.hi THEN CAST(COALESCE(s.sold, 0) AS DECIMAL(18,2)) END AS sales,
    n_name AS nation, n_regionkey AS regionkey
  FROM (SELECT DISTINCT sid FROM fxs) e CROSS JOIN (SELECT MIN(w) AS lo, MAX(w) AS hi FROM fxs) b
  CROSS JOIN (SELECT UNNEST(range(0, 2000)) AS w) p
  LEFT JOIN fxs s ON s.sid = e.sid AND s.w = p.w
  LEFT JOIN supplier ON s_suppkey = e.sid LEFT JOIN nation ON n_nationkey = s_nationkey
  WHERE p.w BETWEEN b.lo AND b.hi + 4)"""


def fx_weekly(spark: SparkSession, d: str) -> DataFrame:
    week = F.floor(F.datediff(F.to_date("l_shipdate"), F.lit(EPOCH).cast("date")) / 7).cast("bigint")
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("sid"), week.alias("w")).agg(
        F.sum(F.col("l_quantity").cast(MONEY)).alias("sold"), F.sum(F.col("l_extendedprice").cast(MONEY)).alias("revenue")
    )


def fx_grid(spark: SparkSession, d: str, weekly: DataFrame | None = None) -> DataFrame:
    """``weekly`` may be the weeks of :func:`fx_weekly` as stored, since the grid reads them three times."""
    from tallyloom.core import with_scalars
    from tallyloom.operators.relate import complete_grid

    weekly = fx_weekly(spark, d) if weekly is None else weekly
    entities = with_scalars(weekly.select("sid").distinct(), weekly, {"lo": F.min("w"), "hi": F.max("w")})
    grid = complete_grid(entities, "w", F.col("_s.lo"), F.col("_s.hi") + 4)
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    places = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("s_suppkey").alias("sid"), F.col("n_name").alias("nation"), F.col("n_regionkey").alias("regionkey")
    )
    # a compressed file says little about the rows in it, and a broadcast of all weeks would fill the driver
    filled = grid.join(weekly.select("sid", "w", "sold").hint("merge"), ["sid", "w"], "left").join(places, "sid", "left")
    sales = F.when(F.col("w") <= F.col("_s.hi"), F.coalesce("sold", F.lit(0)).cast("decimal(18,2)"))
    return filled.select("sid", "w", sales.alias("sales"), "nation", "regionkey")


# --- predictions of some trials -----------------------------------------------------------------------

FXP = FXO + f""", fxp AS (
  SELECT o_orderkey, o_custkey, hfold AS fold, split, t.trial, y, nation,
    CAST((((o_orderkey * 7919 + t.trial * 104729 + o_custkey * 31) % 1000) * (4 + t.trial % 5) + y * 1000 * (6 - t.trial % 5)) // 10 / 1000.0 AS DECIMAL(6,3)) AS pred
  FROM fxo CROSS JOIN (SELECT UNNEST(range(0, {TRIALS}))::INTEGER AS trial) t), fxt AS (
  SELECT fold, trial, SUM((y - pred) * (y - pred))::DOUBLE / COUNT(*) AS score FROM fxp GROUP BY fold, trial)"""


def fx_preds(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("trial")
    rows = fx_orders(spark, d).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(TRIALS - 1))))
    noise = (F.col("o_orderkey") * 7919 + t * 104729 + F.col("o_custkey") * 31) % 1000
    raw = F.floor((noise * (4 + t % 5) + F.col("y") * 1000 * (6 - t % 5)) / 10)
    return rows.select(
        "o_orderkey", "o_custkey", F.col("hfold").alias("fold"), "split", "trial", "y", "nation",
        (raw / 1000.0).cast("decimal(6,3)").alias("pred"),
    )


def fx_trials(spark: SparkSession, d: str) -> DataFrame:
    from tallyloom.functions.metrics import mse_rmse_mae

    return mse_rmse_mae(fx_preds(spark, d), "y", "pred", ["fold", "trial"]).select("fold", "trial", F.col("mse").alias("score"))


# --- study scores: dataset x model x preparation x search x fold --------------------------------------

FXS = FXO + f""", fxh AS (
  SELECT nation AS dataset, nationkey, m.model, r.prep, r.hpo, CAST(o_orderkey % 3 AS INTEGER) AS fold,
    CASE WHEN (o_orderkey * 7919 + m.i * 104729 + r.j * 1299709 + o_custkey * 31) % 1000 < 500 + 20 * m.i + 25 * r.j THEN 1 ELSE 0 END AS hit
  FROM fxo, (VALUES {", ".join(f"({i}, '{m}')" for i, m in enumerate(MODELS))}) m(i, model),
    (VALUES {", ".join(f"({i}, '{p}', '{h}')" for i, (p, h) in enumerate((p, h) for p in PREPS for h in HPOS))}) r(j, prep, hpo)
  WHERE r.prep <> 'tta' OR nationkey % 4 <> 0), fxf AS (
  SELECT dataset, model, prep, hpo, fold, SUM(hit)::DOUBLE / COUNT(*) AS value FROM fxh GROUP BY ALL), fxc AS (
  SELECT dataset, model, prep, hpo, SUM(hit)::DOUBLE / COUNT(*) AS value FROM fxh GROUP BY ALL)"""


def fx_fold_scores(spark: SparkSession, d: str) -> DataFrame:
    """One conditional sum per (model, regime) cell, so the orders are never multiplied."""
    base = (F.col("o_orderkey") * 7919 + F.col("o_custkey") * 31)
    regimes = [(p, h) for p in PREPS for h in HPOS]
    cells = [
        F.struct(
            F.lit(m).alias("model"), F.lit(p).alias("prep"), F.lit(h).alias("hpo"),
            F.count_if((base + i * 104729 + j * 1299709) % 1000 < 500 + 20 * i + 25 * j).alias("hits"),
        )
        for i, m in enumerate(MODELS) for j, (p, h) in enumerate(regimes)
    ]
    rows = fx_orders(spark, d).groupBy(
        F.col("nation").alias("dataset"), "nationkey", (F.col("o_orderkey") % 3).cast("int").alias("fold")
    ).agg(F.count(F.lit(1)).alias("n"), F.array(*cells).alias("cells"))
    return rows.select("dataset", "nationkey", "fold", "n", F.inline("cells")).where("prep <> 'tta' or nationkey % 4 <> 0")


def fx_scores(spark: SparkSession, d: str, folds: bool = False) -> DataFrame:
    keys = ["dataset", "model", "prep", "hpo", *(["fold"] if folds else [])]
    return fx_fold_scores(spark, d).groupBy(*keys).agg((F.sum("hits").cast("double") / F.sum("n")).alias("value"))


# --- leaderboard entries and scores --------------------------------------------------------------------

FXB = """fxboard AS (
  SELECT c_nationkey AS board, CAST(c_acctbal AS DECIMAL(12,2)) AS public, CAST(c_acctbal + c_custkey % 97 AS DECIMAL(12,2)) AS private FROM customer),
fxentry AS (
  SELECT s_suppkey, s_nationkey AS board, CAST(s_acctbal AS DECIMAL(12,2)) AS public_score, CAST(s_acctbal - s_suppkey % 89 AS DECIMAL(12,2)) AS private_score FROM supplier)"""


def fx_board(spark: SparkSession, d: str) -> DataFrame:
    bal = F.col("c_acctbal")
    return table(spark, d, "customer").select(
        F.col("c_nationkey").alias("board"), bal.cast(MONEY).alias("public"), (bal + F.col("c_custkey") % 97).cast(MONEY).alias("private")
    )


def fx_entries(spark: SparkSession, d: str) -> DataFrame:
    bal = F.col("s_acctbal")
    return table(spark, d, "supplier").select(
        "s_suppkey", F.col("s_nationkey").alias("board"), bal.cast(MONEY).alias("public_score"),
        (bal - F.col("s_suppkey") % 89).cast(MONEY).alias("private_score"),
    )
