"""Inputs the test tables lack: null dates and prices, doubles, text dates, shuffled CSV headers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ordermill.functions.exact import to_cents
from ordermill.operators.clean import parse_timestamps
from ordermill.operators.ranking import exact_quantiles, quantile_double
from ordermill.operators.stats import hash_sample
from ordermill.plans import analyses as A
from ordermill.plans import sql_suite as Q
from ordermill.sources.readers import read_csv_table, unparsable_values

MASTER = "order_id string, customer_id string, order_purchase_timestamp timestamp_ntz, total_price decimal(12,2)"


def master(spark):
    day = lambda m, d: dt.datetime(2017, m, d)
    rows = [("a", "x", day(1, 10), 10), ("b", "y", day(2, 20), 20), ("c", "z", day(3, 30), 30), ("d", "w", None, 1000)]
    from decimal import Decimal
    return spark.createDataFrame([(o, c, t, Decimal(p)) for o, c, t, p in rows], MASTER)


def test_undated_orders_belong_to_no_period(spark):
    m = master(spark)
    assert [r.month for r in A.monthly_trend(m).collect()] == ["2017-01", "2017-02", "2017-03"]
    h = A.monthly_highlights(m).first()
    assert (h.peak_month, h.start_month, h.end_month, h.growth_pct) == ("2017-03", "2017-01", "2017-01", 0.0)
    assert [r.ma4 for r in A.weekly_revenue(m).collect()] == [10.0, 15.0, 20.0]


def test_undated_customers_have_no_segment(spark):
    got = {r.customer_id: r for r in A.rfm_segments(master(spark), on_duplicate_edges="ignore").collect()}
    assert got["w"].r_score is None and got["w"].segment is None and got["x"].segment is not None


@pytest.mark.parametrize("how", [{"top_n": 2}, {"top_pct": 100}, {"top_n": None}])
def test_pareto_keeps_unknown_revenue(spark, how):
    df = spark.createDataFrame([("1", 5.0), ("2", None)], "seller_id string, revenue double") \
              .withColumn("revenue", F.col("revenue").cast("decimal(12,2)"))
    rows = [tuple(r) for r in Q.pareto(df, **how).collect()]
    assert rows == [(1, "1", 5.0, 50.0, 100.0), (2, "2", None, 100.0, 100.0)]


def test_double_money_is_rounded(spark):
    df = spark.createDataFrame([(19.99,), (1.15,), (0.29,), (None,)], "p double")
    assert [r[0] for r in df.select(to_cents(F.col("p"))).collect()] == [1999, 115, 29, None]


def test_probabilities_are_exact(spark):
    df = spark.range(11).select(F.col("id").cast("double").alias("v"))
    q = exact_quantiles(df, "v", [0.9999999, 1e-7]).select(quantile_double(F.col("q0")), quantile_double(F.col("q1"))).first()
    assert q[0] == pytest.approx(9.999999, abs=1e-12) and q[1] == pytest.approx(1e-6, abs=1e-15)
    with pytest.raises(ValueError):
        exact_quantiles(df, "v", [0.1 + 0.2])


def test_sample_of_text_ids_is_the_smallest_hashes(spark):
    df = spark.range(5000).select(F.concat(F.lit("id"), "id").alias("k"))
    mask = F.lit((1 << 63) - 1)
    want = df.orderBy(F.xxhash64("k", F.lit(42)).bitwiseAND(mask), "k").limit(40).collect()
    assert sorted(hash_sample(df, "k", 40).collect()) == sorted(want)


def test_text_dates_do_not_pass_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
        df = spark.createDataFrame([("2017-10-15 00:30:00",), ("rubbish",), (None,)], "t string")
        assert [r.t for r in parse_timestamps(df, ["t"]).collect()] == [dt.datetime(2017, 10, 15, 0, 30), None, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_csv_columns_by_name_and_splittable(spark, tmp_path):
    path = str(tmp_path / "items.csv")
    with open(path, "w") as f:
        f.write("price,order_id,order_item_id,category,product_id,seller_id\n")
        f.writelines(f"{i % 7}.50,o{i},1,toys,p,s\n" for i in range(200_000))
        f.write("cheap,last,1,toys,p,s\n")
    df = read_csv_table(spark, path, "items")
    row = df.where("order_id = 'o3'").first()
    assert str(row.price) == "3.50" and row.category == "toys"
    assert df.where("order_id = 'last'").first().price is None
    assert unparsable_values(spark, path, "items").first().price == 1
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
        assert read_csv_table(spark, path, "items").rdd.getNumPartitions() > 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
