"""Links between rows and chains that never meet; the plans of the job that uses them."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.catalog.models_and_studies import _matrix
from tallyloom.operators import chains, reshape, rowwise
from tests.conftest import SF
from tests.test_learned_and_counted import naive_chains


@pytest.mark.parametrize("seed", range(3))
def test_chains_that_never_meet_walk_back(spark, monkeypatch, seed):
    """Edges of which no two leave or reach the same node: one written join per doubling of the longest chain, cycles included."""
    rng, written = random.Random(seed), []
    monkeypatch.setattr(chains, "stored", lambda df, label, write=chains.stored: written.append(label) or write(df, label))
    names = rng.sample(range(10_000), 300)
    edges, at = [], 0
    for n in (1, 2, 3, 30, 64, 65):
        part, at = names[at : at + n + 1], at + n + 1
        edges += list(zip(part, part[1:]))
    for n in (1, 2, 7, 16) if seed else ():
        part, at = names[at : at + n], at + n
        edges += list(zip(part, [*part[1:], part[0]]))
    rng.shuffle(edges)
    got = chains.chain_paths(spark.createDataFrame(edges, "src long, dst long"))
    assert sorted(tuple(r) for r in got.collect()) == naive_chains(edges)
    assert "chains" not in written and written.count("walked") <= (7 if seed == 0 else 14)
    assert written.count("jumps") == 0 or seed


def test_repeated_edges_count_once(spark):
    edges = [(1, 2), (2, 3), (1, 2)]
    assert sorted(tuple(r) for r in chains.chain_paths(spark.createDataFrame(edges, "src long, dst long")).collect()) == naive_chains([(1, 2), (2, 3)])


def test_links_tell_nulls_and_types_apart(spark):
    rows = {1: (7, None, 5, 6), 2: (None, 5, 6, 8), 3: (5, None, 6, 9), 4: (1, 2, 3, None), 5: (2, 3, None, 4), 6: (0, 0, 0, 0), 7: (0, 0, 0, 0), 8: (None, 1, 2, 3)}
    df = spark.createDataFrame([(k, *v) for k, v in rows.items()], "id long, a long, b long, c long, d long")
    heads, tails = [v[:-1] for v in rows.values()], [v[1:] for v in rows.values()]
    want = sorted((a, b) for a, v in rows.items() for b, w in rows.items() if a != b and v[:-1] == w[1:] and heads.count(v[:-1]) == 1 and tails.count(w[1:]) == 1)
    assert want
    for table in (df, df.withColumn("b", F.col("b").cast("int")), df.select("id", *[F.col(c).cast("string") for c in "abcd"])):
        assert sorted(tuple(r) for r in chains.link_edges(table, [["a", "b", "c", "d"]], "id").collect()) == want


def test_unique_rows_are_found_in_a_hash_table(spark):
    df = spark.createDataFrame([(1, 5, None), (1, 6, 2.0), (2, 7, 3.0), (3, None, None)], "k long, v long, x double")
    once = reshape.only_unique(df, ["k"])
    assert sorted(tuple(r) for r in once.collect()) == [(2, 7, 3.0), (3, None, None)]
    assert "SortAggregate" not in once._jdf.queryExecution().executedPlan().toString()


def test_mean_of_a_row_is_not_taken_again_for_every_value(spark):
    df = spark.createDataFrame([(1.0, 0.0, 4.0), (None, 2.0, 2.0)], "a double, b double, c double")
    for out, most in ((rowwise.nonzero_stats(df, {"g": ["a", "b", "c"]}), 4), (rowwise.row_stats(df, ["a", "b", "c"]), 2)):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") <= most


def test_lags_read_the_stored_grid(spark):
    plan = _matrix(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_shipdate" not in plan
