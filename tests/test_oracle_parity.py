"""Every query of the analytics registry equals its DuckDB oracle on the smallest test
tables (the training-data operators are compared in tests/llm)."""

import pytest

import __spark_entry__ as E
from om_paths import SF_SMALL
from ordermill.plans import registry
from ordermill.testing import oracle_sql as oracles
from ordermill.testing.compare import compare, duckdb_connection


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(oracles.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_parity(spark, con, name):
    r = compare(spark, registry.queries()[name], oracles.oracle_sql()[name], SF_SMALL, con)
    assert r["ok"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "avg_order_value" in df.columns
