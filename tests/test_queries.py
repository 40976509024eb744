"""Every registered query of the core against its oracle, and the driver's entry."""

import pytest

import ledgerspark.plan_queries  # noqa: F401
import ledgerspark.source_queries  # noqa: F401
from ledgerspark.queries import ORACLE_SQL, QUERIES

from .oracle import compare


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_oracle(spark, sf_dir, name):
    compare(spark, sf_dir, QUERIES[name], ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["resource_id", "median_cost", "recent_avg", "drift_ratio"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_overlap_join_has_no_nested_loop(spark, sf_dir):
    plan = QUERIES["query_cost_attribution"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
