"""Properties of the results on the test tables (sf0.001)."""

import pytest
from pyspark.sql import functions as F

from om_paths import SF_SMALL
from ordermill.plans import analyses as A
from ordermill.plans import registry
from ordermill.plans import sql_suite as Q
from ordermill.sources.fixture import fixture_tables


@pytest.fixture(scope="module")
def tables(spark):
    return fixture_tables(spark, SF_SMALL)


@pytest.fixture(scope="module")
def master(spark):
    return registry.queries()["master"](spark, SF_SMALL)


def test_master_one_row_per_delivered_order(spark, tables, master):
    delivered = tables.orders.where("order_status = 'delivered'").select("order_id").distinct().count()
    assert master.count() == delivered == master.select("order_id").distinct().count()


def test_tiers_and_histogram_cover_all_sellers(master):
    sellers = A.seller_health(master)
    n = sellers.count()
    assert A.seller_tiers(master).agg(F.sum("sellers")).first()[0] == n
    scored = sellers.where(F.col("health_score").isNotNull()).count()
    h = A.seller_health_histogram(master)
    assert h.count() == 30 and h.agg(F.sum("count")).first()[0] == scored


def test_payment_shares_total_100(master):
    assert A.payment_share(master).agg(F.sum("pct")).first()[0] == pytest.approx(100.0)


def test_pareto_cumulative_monotone(tables):
    r = Q.pareto_sellers(tables.sellers, tables.items, tables.orders, top_n=1000).collect()
    pct = [x.pct_of_revenue for x in r]
    assert pct == sorted(pct) and pct[-1] == 100.0 and [x.rnk for x in r] == list(range(1, len(r) + 1))


def test_rfm_segments_cover_customers(master):
    seg = A.rfm_segments(master)
    assert seg.count() == master.select("customer_id").distinct().count()
    assert A.rfm_segment_summary(master).agg(F.sum("customers")).first()[0] == seg.count()


@pytest.mark.parametrize("name", ["sql_top_categories", "sql_rfm_scores", "sql_pareto_sellers", "order_category",
                                  "clean_items"])
def test_same_rows_under_1_and_8_shuffle_partitions(spark, name):
    fn = registry.queries()[name]
    registry.clear_products()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        one = sorted(tuple(r) for r in fn(spark, SF_SMALL).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    registry.clear_products()  # else the second run would read the first one's tables
    eight = sorted(tuple(r) for r in fn(spark, SF_SMALL).collect())
    assert one == eight


def test_rfm_segments_approx_option(master):
    approx = A.rfm_segments(master, approx=True, on_duplicate_edges="ignore")
    assert approx.count() == master.select("customer_id").distinct().count()
    assert approx.where(F.col("segment").isNull()).count() == 0
