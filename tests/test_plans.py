"""Plan shape: native expressions, pushed-down scans, no single-task window at entity grain."""

import pytest

from om_paths import SF_SMALL
from ordermill.plans import registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_no_python_in_any_plan(spark, name):
    p = plan(registry.queries()[name](spark, SF_SMALL))
    for marker in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "MapInPandas", "FlatMapGroupsInPandas"):
        assert marker not in p, name


def test_scan_prunes_columns_and_pushes_filter(spark):
    from ordermill.plans.sql_suite import peak_times
    from ordermill.sources.fixture import fixture_tables
    t = fixture_tables(spark, SF_SMALL)
    p = plan(peak_times(t.orders))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_orderdate:timestamp_ntz>" in p
    assert "o_totalprice" not in p


def test_rfm_ntile_has_no_single_partition_window(spark):
    df = registry.queries()["sql_rfm_scores"](spark, SF_SMALL)
    p = plan(df)
    # the three global NTILEs are computed over range partitions, not one task
    assert "ntile(" not in p.lower()
