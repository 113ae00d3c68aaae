"""Every query of the analytics registry returns the same rows under 1 and 8 shuffle partitions.

The second run uses another spelling of the same input folder, so the per-run cleaning
products (de-duplicated items, master, ...) are rebuilt under the other partitioning."""

import math

import pytest

from om_paths import SF_SMALL
from ordermill.plans import registry


def _rows(df):
    def norm(v):
        return round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(norm(v) for v in r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def one_partition_results(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        return {name: _rows(fn(spark, SF_SMALL + "/.")) for name, fn in registry.queries().items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_partition_count_does_not_change_results(spark, one_partition_results, name):
    assert _rows(registry.queries()[name](spark, SF_SMALL)) == one_partition_results[name]
