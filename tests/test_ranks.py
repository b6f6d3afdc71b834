"""Quantiles selected by digits against numpy: hot groups, ties, nulls, all number types, keys of every size."""

import math
import struct
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.ranks import order_key, quantile_tables, quantiles

QS = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}


@pytest.fixture(scope="module")
def table():
    """A third of the rows in one group, a third of the values equal, a null group, a group without values."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(900):
        g = "hot" if rng.random() < 0.34 else (None if i % 11 == 0 else f"g{i % 5}")
        x = None if i % 13 == 0 else 7 if rng.random() < 0.34 else int(rng.integers(-(10**6), 10**6))
        rows.append((i, g, i % 3, x, None if x is None else float(rng.normal() * 10.0 ** rng.integers(-5, 5)), None if x is None else Decimal(x) / 100, i * (1 << 53) - (1 << 62)))
    rows += [(1000 + i, "void", 0, None, None, None, None) for i in range(60)]
    return rows


SCHEMA = "id int, g string, h int, x int, y double, z decimal(15,2), w long"
NAMES = ["id", "g", "h", "x", "y", "z", "w"]


@pytest.mark.parametrize(("big", "fits"), [(0, 0), (50, 100), (50, 10**6), (10**6, 0)])
def test_quantiles_match_numpy(spark, table, big, fits):
    df = spark.createDataFrame(table, SCHEMA)
    sets = [(["g"], ["x", "y", "z", "w"]), (["h", "g"], ["y"]), ([], ["x", "w"])]
    for (keys, cols), got in zip(sets, quantile_tables(df, sets, QS, [[F.count(F.lit(1)).alias("n")]] * 3, big, fits)):
        groups = {}
        for r in table:
            groups.setdefault(tuple(r[NAMES.index(k)] for k in keys), []).append(r)
        found = got.collect()
        assert len(found) == len(groups)
        for r in found:
            mine = groups[tuple(r[k] for k in keys)]
            assert r["n"] == len(mine)
            for c in cols:
                values = [float(m[NAMES.index(c)]) for m in mine if m[NAMES.index(c)] is not None]
                for n, q in QS.items():
                    assert r[f"{c}|{n}"] is None if not values else r[f"{c}|{n}"] == pytest.approx(np.quantile(values, q), rel=1e-14, abs=1e-14)


def bits(x):
    n = struct.unpack("<q", struct.pack("<d", x + 0.0))[0]
    return n if n >= 0 else -(n & ((1 << 63) - 1))


def test_keys_order_doubles_as_their_bits_do(spark):
    rng = np.random.default_rng(8)
    some = [float(s * m * 2.0 ** int(e)) for s in (1, -1) for m, e in zip(rng.random(1500) + 1, rng.integers(-1080, 1023, 1500))]
    some += [2.0**e for e in range(-1074, 1024)] + [math.nextafter(2.0**e, 0) for e in range(-1073, 1024)] + [math.nextafter(2.0**e, math.inf) for e in range(-1074, 1023)]
    some += [0.0, -0.0, math.inf, -math.inf, 5e-324, -5e-324, 1.7976931348623157e308, 1e22, 0.1]
    df = spark.createDataFrame([(x,) for x in some], "x double")
    got = df.select("x", order_key(df, "x").alias("k")).collect()
    assert all((r.k ^ -(1 << 63)) == bits(r.x) for r in got)
    last = df.limit(1).select(F.lit(float("nan")).alias("x"))
    assert last.select(order_key(last, "x").alias("k")).first().k == -1  # above all others as unsigned


def test_keys_of_exact_types(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    df = spark.createDataFrame([(low, Decimal("-9999999999999999.99")), (-1, Decimal("-0.01")), (0, Decimal("0.00")), (high, Decimal("9999999999999999.99"))], "a long, b decimal(18,2)")
    for c in ("a", "b"):
        keys = [k % (1 << 64) for (k,) in df.orderBy(c).select(order_key(df, c)).collect()]
        assert keys == sorted(set(keys)) and len(keys) == 4


def test_extremes_nans_and_empty_tables(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    df = spark.createDataFrame([(low, math.nan), (low, -math.inf), (0, 0.0), (high, math.inf), (high, 1.5)], "a long, b double")
    assert quantiles(df, [], "a", {"lo": 0.0, "mid": 0.5, "hi": 1.0}, big=0, fits=0).first().asDict() == {"lo": float(low), "mid": 0.0, "hi": float(high)}
    got = quantiles(df, [], "b", {"lo": 0.0, "mid": 0.5, "hi": 1.0}, big=0, fits=0).first()
    assert got.lo == -math.inf and got.mid == 1.5 and math.isnan(got.hi)
    assert quantiles(df.limit(0), [], "a", {"m": 0.5}, big=0, fits=0).first().m is None
    assert quantiles(df.limit(0), ["b"], "a", {"m": 0.5}, big=0, fits=0).count() == 0
    zeros = spark.createDataFrame([(0.0, 1), (-0.0, 3), (None, 5)], "g double, x int")
    assert sorted((r.g is None, r.m) for r in quantiles(zeros, ["g"], "x", {"m": 0.5}, big=0, fits=0).collect()) == [(False, 2.0), (True, 5.0)]


def test_a_group_of_equal_values_needs_no_pass(spark, monkeypatch):
    import tallyloom.ranks as ranks

    labels = []
    kept = ranks.stored
    monkeypatch.setattr(ranks, "stored", lambda df, label: labels.append(label) or kept(df, label))
    assert quantiles(spark.range(500).select(F.lit(3.5).alias("x")), [], "x", {"m": 0.5}, big=0, fits=0).first().m == 3.5
    assert labels == ["big-groups", "ranks"]
    labels.clear()
    assert quantiles(spark.range(5000).select((F.col("id") - 2500).alias("x")), [], "x", {"m": 0.5}, big=0, fits=0).first().m == -0.5
    assert 2 <= labels.count("ranks") <= 1 - (-64 // ranks.DIGIT)


def test_passes_do_not_make_the_rows_again(spark, table, monkeypatch):
    from tallyloom import ranks

    plans = []
    monkeypatch.setattr(ranks, "stored", lambda df, label, write=ranks.stored: plans.append((label, df._jdf.queryExecution().optimizedPlan().toString())) or write(df, label))
    df = spark.createDataFrame(table, SCHEMA).withColumn("g", F.reverse(F.reverse("g")))
    got = quantile_tables(df, [(["g"], ["x"])], QS, [[F.count(F.lit(1)).alias("n")]], 50, 100)[0].collect()
    hot = next(r for r in got if r["g"] == "hot")
    assert hot["x|c"] == np.quantile([r[3] for r in table if r[1] == "hot" and r[3] is not None], 0.5)
    assert [label for label, plan in plans if "reverse(" in plan] == ["big-groups", "ranks", "big-keys"]  # no pass after them
    assert [label for label, _ in plans].count("ranks") > 1


def test_jobs_make_their_rows_once(spark):
    from tallyloom.plans import jobs

    rows = [(i, i % 3 and "train" or "test", "ab"[i % 2], "xyz"[i % 3], float(i), float(i % 4), i % 5, 2 + i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, split string, brand string, kind string, price double, size double, floor int, top int").withColumn("brand", F.reverse(F.reverse("brand")))
    named = df.withColumnsRenamed({"brand": "brand_ind", "kind": "kind_ind"})
    for out in (jobs.property_clean(df), jobs.group_stats(named, ["price", "size"], ["brand_ind", "kind_ind"], "_ind")):
        assert "reverse(" not in out._jdf.queryExecution().optimizedPlan().toString()
        assert out.count() == 60


def test_grid_and_chain_jobs_make_their_rows_once(spark):
    from tallyloom.plans import jobs

    weeks = spark.createDataFrame([(i, w, float(1 + (i * w) % 5), float(i + w)) for i in range(1, 4) for w in range(12)], "sid long, w long, sold double, revenue double")
    made = weeks.withColumn("sold", F.abs(F.abs("sold")))
    grid = made.select("sid", "w", F.col("sold").alias("sales"), F.lit("n").alias("nation"))
    out = jobs.demand_grid(grid, made, [["sid"], ["nation"]], F.col("w") > 8, [(6, 8)], 0)
    assert "abs(" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count() == 3 * 7  # released after two weeks
    rows = spark.createDataFrame([(i, i + 3.0, i + 2.0, i + 1.0, i + 0.0) for i in range(1, 9)], "id long, a double, b double, c double, d double")
    chained = jobs.chain_lookup(rows.withColumn("a", F.reverse(F.reverse(F.col("a").cast("string"))).cast("double")), ["a", "b", "c", "d"], "id", [2])
    assert "reverse(" not in chained._jdf.queryExecution().optimizedPlan().toString() and chained.count() == 8
