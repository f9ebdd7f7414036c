"""A few registered queries against their SQL twins on the smallest tables."""

from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"
NAMES = ("income_by_region_year", "i1_random_split", "f1_income_decile", "e9_pairwise_errors", "e24_near_deterministic_pairs", "g5_sweep_report")

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are absent")


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_twin(spark, name):
    from tools.compare import canonical, connect

    got = queries()[name](spark, SF_DIR).toPandas()
    want = connect(SF_DIR).execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_registry_is_consistent(spark):
    assert set(oracle_sql()) <= set(queries())
    assert entry(spark).count() == 35


def test_filters_and_columns_reach_the_scan(spark):
    """Only the needed columns of the tables are read."""
    plan = queries()["e2_household_max_education"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "l_tax" not in plan and "l_extendedprice:double,l_discount" not in plan
