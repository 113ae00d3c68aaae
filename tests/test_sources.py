"""CSV reader with explicit schemas, parquet and CSV sinks."""

import os

from pyspark.sql import functions as F
import tempfile

from ordermill.operators.clean import parse_timestamps
from ordermill.sources.readers import read_csv_table
from ordermill.sources.sinks import write_table


def test_csv_reader_parses_and_coerces(spark):
    d = tempfile.mkdtemp(prefix="om-csv-")
    path = os.path.join(d, "orders.csv")
    with open(path, "w") as f:
        f.write("order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,"
                "order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date\n")
        f.write("a1,c1,delivered,2017-10-02 10:56:33,,,2017-10-10 21:25:13,2017-10-18 00:00:00\n")
        f.write("a2,c2,delivered,not a date,,,,2017-10-18 00:00:00\n")
    o = parse_timestamps(read_csv_table(spark, path, "orders"))
    got = {r.order_id: (r.order_purchase_timestamp, r.order_delivered_customer_date) for r in o.collect()}
    assert got["a2"] == (None, None) and got["a1"][0].year == 2017
    assert dict(o.dtypes)["order_purchase_timestamp"] == "timestamp_ntz"


def test_sinks_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="om-sink-")
    df = spark.createDataFrame([(1, "2018-01"), (2, "2018-02")], "id long, month string")
    write_table(df, os.path.join(d, "p"), partition_by=("month",))
    write_table(df, os.path.join(d, "c"), fmt="csv")
    assert spark.read.parquet(os.path.join(d, "p")).count() == 2
    assert spark.read.option("header", True).csv(os.path.join(d, "c")).count() == 2


def test_cleaning_and_analysis_jobs_write_outputs(spark):
    from om_paths import SF_SMALL
    from ordermill.plans.jobs import ANALYSIS_OUTPUTS, run_analyses, run_cleaning
    from ordermill.sources.fixture import fixture_tables
    out = tempfile.mkdtemp(prefix="om-jobs-")
    master = run_cleaning(fixture_tables(spark, SF_SMALL), out)
    assert master.count() == 1007 and "month" in master.columns
    assert spark.read.parquet(os.path.join(out, "items_clean")).count() > 0
    written = run_analyses(master, out)
    assert set(written) == set(ANALYSIS_OUTPUTS)
    assert spark.read.parquet(os.path.join(out, "analyses", "rfm_segments")).count() > 0


def test_views_answer_sql(spark):
    from om_paths import SF_SMALL
    from ordermill.plans import registry
    from ordermill.sources.views import register_views
    t = registry.tables_for(spark, SF_SMALL)
    assert "order_items" in register_views(spark, t)
    per_state = spark.sql("""
        SELECT s.seller_state AS state, count(DISTINCT i.product_id) AS products, sum(i.price) AS worth
        FROM sellers s LEFT JOIN order_items i USING (seller_id) GROUP BY s.seller_state""")
    joined = t.sellers.join(t.items, "seller_id", "left").groupBy(F.col("seller_state").alias("state")).agg(
        F.countDistinct("product_id").alias("products"), F.sum("price").alias("worth"))
    assert sorted(map(tuple, per_state.collect())) == sorted(map(tuple, joined.collect()))


def test_approx_distinct_option(spark):
    from om_paths import SF_SMALL
    from ordermill.plans import analyses as A, registry
    m = registry.queries()["master"](spark, SF_SMALL)
    exact = A.executive_kpis(m).first()
    approx = A.executive_kpis(m, approx_distinct=True).first()
    assert abs(approx.active_sellers - exact.active_sellers) <= max(1, 0.05 * exact.active_sellers)
