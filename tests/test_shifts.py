"""Shift matching of rows and of columns against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyloom import core
from tallyloom.operators import shifts


def naive_lookup(rows, groups, offsets):
    """rows: {key: {column: value}}; the value of the first offset with a hit, else 0."""
    found = dict.fromkeys(rows, 0)
    for o in reversed(offsets):
        head = {k: tuple(tuple(r[c] for c in g[: max(len(g) - o, 0)]) for g in groups) for k, r in rows.items()}
        tail = {k: tuple(tuple(r[c] for c in g[o:]) for g in groups) for k, r in rows.items() if r[groups[0][o - 2]]}
        once_head, once_tail = Counter(head.values()), Counter(tail.values())
        donor = {t: k for k, t in tail.items() if once_tail[t] == 1}
        for k, h in head.items():
            if once_head[h] == 1 and h in donor:
                found[k] = rows[donor[h]][groups[0][o - 2]]
    return found


def _table(spark, rows, cols):
    return spark.createDataFrame([(k, *[r[c] for c in cols]) for k, r in rows.items()], "id long, " + ", ".join(f"`{c}` long" for c in cols))


@pytest.mark.parametrize("seed", range(4))
def test_offset_lookup_against_brute_force(spark, seed):
    rng = random.Random(seed)
    line = [rng.choice([0, 0, None, 1, 2, 3]) for _ in range(60)]
    groups = [[f"a{i}" for i in range(9)], [f"b.{i}" for i in range(4)]]
    rows = {}
    for k in range(40):
        at = rng.randrange(45)
        rows[k] = {c: line[at + i] for i, c in enumerate(groups[0])} | {c: line[at + i + 3] for i, c in enumerate(groups[1])}
    rows |= {100 + k: dict.fromkeys(groups[0] + groups[1], 0) for k in range(20)} | {200: dict.fromkeys(groups[0] + groups[1])}
    cols = groups[0] + groups[1]
    df = _table(spark, rows, cols).withColumnsRenamed({c: c.replace(".", "_") for c in cols})
    groups = [[c.replace(".", "_") for c in g] for g in groups]
    rows = {k: {c.replace(".", "_"): v for c, v in r.items()} for k, r in rows.items()}
    for offsets in ([2, 3, 4, 5, 6, 7, 8], [4, 2]):
        got = {r.id: r.looked_up for r in shifts.offset_lookup(df, groups, "id", offsets).collect()}
        want = naive_lookup(rows, groups, offsets)
        assert got == want and any(want.values())


def test_lookup_of_odd_tables(spark):
    cols = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(1, 1, 2, 3, 4), (2, 7, 6, 1, 2), (None, 7, 6, 1, 2)], "id long, a long, b long, c long, d long")
    assert {(r.id, r.looked_up) for r in shifts.offset_lookup(df, [cols], "id", [2]).collect()} == {(1, 7), (2, 0), (None, 0)}
    assert shifts.offset_lookup(df.where("false"), [cols], "id", [2, 3]).count() == 0
    for wrong in ([1], [5], [4], []):
        with pytest.raises(ValueError, match="offset"):
            shifts.offset_lookup(df, [cols], "id", wrong)


def test_cells_are_compared_behind_the_hash(spark, monkeypatch):
    """With a hash that is the same for all cells the runs of two rows meet, and none may come through."""
    monkeypatch.setattr(shifts, "_codes", lambda text: [F.lit(0).cast("bigint")] * 4)
    rows = spark.createDataFrame([(1, 1, 2, 3, 4), (2, 0, 6, 1, 5)], "id long, a long, b long, c long, d long")
    one_donor = rows.withColumn("a", F.when(F.col("id") == 1, 0).otherwise(9)).where("id = 2")
    assert shifts.shifted_rows(one_donor, [["a", "b", "c", "d"]], "id", [2]).count() == 1
    assert [r.looked_up for r in shifts.offset_lookup(one_donor, [["a", "b", "c", "d"]], "id", [2]).collect()] == [0]
    assert shifts.column_edges(rows, "id", ["a"]).count() == 0
    monkeypatch.undo()
    assert shifts.column_edges(rows, "id", ["a", "b"]).count() == 0


def test_one_shuffle_finds_all_offsets(spark):
    df = spark.range(50).select("id", *[(F.col("id") + i).alias(f"c{i}") for i in range(40)])
    plan = shifts.shifted_rows(df, [[f"c{i}" for i in range(40)]], "id", list(range(2, 39)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_column_chains_of_more_rows_than_the_driver_would_take(spark):
    rng, n = random.Random(5), 3000
    line = [rng.randrange(1000) for _ in range(n + 50)]
    cols = [f"x{i}" for i in range(44)]
    rows = [(r, *[line[r + i] for i in range(44)], 0, 0, None) for r in range(n)]
    df = spark.createDataFrame(rows, "row long, " + ", ".join(f"{c} long" for c in [*cols, "zero", "none"]) + ", empty long").repartition(5)
    got = sorted(tuple(r) for r in shifts.column_chains(df, "row", [*cols, "zero", "none", "empty"]).collect())
    # column i is column i + 1 one row later: a chain from the last column to the first
    assert got == sorted((cols[-1], c, 43 - i) for i, c in enumerate(cols))
    broken = df.withColumn("x20", F.when(F.col("row") == 1500, -1).otherwise(F.col("x20")))
    assert shifts.column_chains(broken, "row", cols, 10).groupBy("chain").count().orderBy("count").collect() == [("x19", 20), ("x43", 23)]
    assert shifts.column_chains(df.where("false"), "row", cols).count() == 0


def test_keys_meet_in_a_hash_table(spark):
    df = spark.createDataFrame([(1, 5, 6, 7, 8), (2, 1, 2, 5, 6)], "id long, a long, b long, c long, d long")
    met = shifts.shifted_rows(df, [["a", "b", "c", "d"]], "id", [2])
    assert [tuple(r) for r in met.collect()] == [(2, 1, 2, 1)]
    assert "SortAggregate" not in met._jdf.queryExecution().executedPlan().toString()


def test_only_open_rows_reach_later_offsets(spark, monkeypatch):
    """Rows with a hit and rows that are not the only ones of their kind are settled by the first offset; a table of copies needs no second batch."""
    batches, sides = [], shifts._sides
    monkeypatch.setattr(shifts, "_sides", lambda df, groups, key, offsets, reach: batches.append(list(offsets)) or sides(df, groups, key, offsets, reach))
    cols = [f"c{i}" for i in range(12)]
    one = spark.range(6).select("id", *[(F.col("id") * 0 + i * i + 1).alias(c) for i, c in enumerate(cols)])
    assert {r.looked_up for r in shifts.offset_lookup(one, [cols], "id", list(range(2, 11))).collect()} == {0}
    assert batches == [[2]]
    line = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9, 7, 9, 3, 2, 3, 8, 4]
    rows = {k: dict(zip(cols, line[at : at + 12])) for k, at in enumerate((0, 5, 6))}  # five and six steps apart
    got = {r.id: r.looked_up for r in shifts.offset_lookup(_table(spark, rows, cols), [cols], "id", list(range(2, 11))).collect()}
    assert got == naive_lookup(rows, [cols], list(range(2, 11))) and sum(v != 0 for v in got.values()) == 2


def test_repeated_keys_are_looked_up_row_by_row(spark):
    cols = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(1, 1, 2, 3, 4), (1, 8, 9, 3, 4), (2, 7, 6, 1, 2), (2, 5, 6, 8, 9)], "id long, a long, b long, c long, d long")
    assert sorted((r.a, r.looked_up) for r in shifts.offset_lookup(df, [cols], "id", [2, 3]).collect()) == [(1, 7), (5, 0), (7, 0), (8, 5)]


def test_few_cells_are_hashed_without_python(spark, monkeypatch):
    """Both ways of hashing runs give the same rows, over cells of one type and of several, with nulls; the short one runs no Python."""
    rng = random.Random(11)
    line = [rng.choice([0, None, 1, 2, 3, 4]) for _ in range(60)]
    cols = [f"a{i}" for i in range(7)]
    df = _table(spark, {k: {c: line[at + i] for i, c in enumerate(cols)} for k, at in enumerate(rng.randrange(50) for _ in range(40))}, cols)
    mixed = df.withColumn("a3", F.col("a3").cast("int")).withColumn("a5", F.col("a5").cast("string").cast("int"))
    assert "MapInArrow" not in shifts.shifted_rows(df, [cols], "id", [2, 3, 4])._jdf.queryExecution().executedPlan().toString()
    for table in (df, mixed):
        few = sorted((tuple(r) for r in shifts.offset_lookup(table, [cols], "id", [2, 3, 4]).collect()), key=repr)
        with monkeypatch.context() as m:
            m.setattr(shifts, "FEW", 0)
            many = sorted((tuple(r) for r in shifts.offset_lookup(table, [cols], "id", [2, 3, 4]).collect()), key=repr)
        assert repr(few) == repr(many) and any(r[-1] for r in few)


def _plans(monkeypatch, module) -> list[str]:
    """The plans of whatever the module stores from now on."""
    seen, stored = [], module.stored
    monkeypatch.setattr(module, "stored", lambda df, label: seen.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df, label))
    return seen


def test_rows_in_small_files_are_not_broadcast(spark, monkeypatch):
    """Thousands of rows that repeat one pattern make a file of a few kilobytes, which would pass the limit; as counted they do not."""
    cols = [f"c{i}" for i in range(6)]
    df = spark.range(4000).select("id", *[(F.floor((F.col("id") + i) / 2) % 1999).alias(c) for i, c in enumerate(cols)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "60k")
    try:
        plans = _plans(monkeypatch, shifts)
        got = shifts.offset_lookup(df, [cols], "id", [2])
        plans.append(got._jdf.queryExecution().executedPlan().toString())
        found = {r.id: r.looked_up for r in got.collect()}
        sent = [core.by_size(core.stored(spark.range(n), "ids"))._jdf.queryExecution().analyzed().toString() for n in (900, 1000)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == naive_lookup({r.id: r.asDict() for r in df.collect()}, [cols], [2]) and any(found.values())
    assert sum("SortMergeJoin" in p for p in plans) == 2 and not any("BroadcastHashJoin" in p for p in plans)
    assert ["broadcast" in p for p in sent] == [True, False] and "merge" in sent[1]


def test_weeks_of_the_grid_are_not_broadcast(spark, monkeypatch):
    from tallyloom.catalog import models_and_studies as m
    from tests.conftest import SF

    plans = _plans(monkeypatch, m)
    m._matrix(spark, SF, 4)
    assert [p.count("SortMergeJoin [sid") for p in plans] == [0, 1]


def test_the_lookup_query_takes_all_offsets_of_forty_weeks(spark, monkeypatch):
    from tallyloom.catalog import ORACLES, QUERIES
    from tallyloom.catalog import models_and_studies as m

    asked = []
    monkeypatch.setattr(m, "_matrix", lambda s, d, width=6: s.range(3).select("id", *[F.lit(i).alias(f"s{i}") for i in range(width)]))
    monkeypatch.setattr(shifts, "offset_lookup", lambda df, groups, key, offsets: asked.append((groups, offsets)) or df.withColumn("looked_up", F.lit(0)))
    assert QUERIES["q_offset_lookup"](spark, "nowhere").count() == 3
    assert asked == [([[f"s{i}" for i in range(40)]], list(range(2, 39)))]
    assert ORACLES["q_offset_lookup"] == ORACLES["q_offset_lookup_far"]
