"""Every registered query against its SQL twin (or for rows) on the smallest tables, and its plan."""

import pytest

from tallyloom.catalog import ORACLES, QUERIES
from tests.conftest import SF
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["q_group_agg_encode", "q_ecdf_in_band", "q_nearest_join", "q_m_norm_gini", "q_shift_rolling", "job_entity_features"])
def test_plan_stays_in_the_engine(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython"):
        assert node not in plan


def test_projection_and_filter_reach_the_scan(spark):
    plan = QUERIES["q_scan_pruned"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_every_sql_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
