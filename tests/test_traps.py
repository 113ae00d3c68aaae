"""Semantics traps on hand-made frames; expected values worked out by hand."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ordermill.functions.exact import money_avg, ratio_round
from ordermill.functions.time import floor_days, is_late, week_start, weekday_name
from ordermill.operators.clean import clip, parse_timestamps, quantile_bounds
from ordermill.operators.picks import dedup, order_category, order_payment, order_review, order_seller
from ordermill.plans.master import category_lookup, title_case
from ordermill.plans import analyses as A


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_t1_half_up_in_integers(spark):
    df = spark.createDataFrame([(1, 8), (-1, 8), (5, 2), (1005, 1000), (7, 0)], "n long, d long")
    got = df.select(ratio_round(F.col("n"), F.col("d"), 2).alias("r")).collect()
    assert [r.r for r in got] == [0.13, -0.13, 2.5, 1.01, None]
    m = spark.createDataFrame([(Decimal("0.03"), 2)], "s decimal(22,2), n long")
    assert m.select(money_avg(F.col("s"), F.col("n")).alias("a")).first().a == 0.02


def test_t2_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (0.5,), (5.0,), (20.0,)], "p double")
    got = [r.c for r in df.select(clip(F.col("p"), F.lit(1.0), F.lit(10.0)).alias("c")).collect()]
    assert got == [None, 1.0, 5.0, 10.0]


def test_t3_t4_t5_dates(spark):
    df = spark.createDataFrame(
        [("2018-01-02 00:00:00", "2018-01-01 23:00:00", "2018-01-01 00:00:00"),
         ("2018-01-02 00:00:00", None, "2018-01-01 00:00:00"),
         ("2018-01-02 00:00:00", "garbage", "2018-01-01 00:00:00")],
        "order_purchase_timestamp string, order_delivered_customer_date string, "
        "order_estimated_delivery_date string")
    p = parse_timestamps(df)
    got = p.select(floor_days("order_purchase_timestamp", "order_delivered_customer_date").alias("d"),
                   is_late("order_delivered_customer_date", "order_estimated_delivery_date").alias("l")).collect()
    assert [(r.d, r.l) for r in got] == [(-1, True), (None, False), (None, False)]


def test_t7_t8_weekday_and_week(spark):
    df = spark.createDataFrame([(dt.datetime(2018, 1, 7, 13),), (dt.datetime(2018, 1, 8, 1),)], "ts timestamp_ntz")
    got = df.select(weekday_name("ts").alias("w"), week_start("ts").alias("k")).collect()
    assert [(r.w, r.k) for r in got] == [("Sunday", dt.datetime(2018, 1, 1)), ("Monday", dt.datetime(2018, 1, 8))]


def test_quantile_bounds_interpolate_and_round(spark):
    df = spark.createDataFrame([(None,), (Decimal(1),), (Decimal(2),), (Decimal(3),), (Decimal(10),)],
                               "price decimal(12,2)")
    b = quantile_bounds(df, "price").first()
    assert (b.p_lo, b.p_hi) == (Decimal("1.03"), Decimal("9.79"))


def test_modal_category_ties_and_default(spark):
    items = spark.createDataFrame(
        [(1, 1, "b"), (1, 2, "a"), (1, 3, "b"), (1, 4, "a"), (1, 5, None), (2, 1, None)],
        "order_id long, order_item_id int, category string")
    got = dict(rows(order_category(items), "order_id", "main_category"))
    assert got == {1: "a", 2: "unknown"}


def test_first_seller_skips_null(spark):
    items = spark.createDataFrame([(1, 2, 7), (1, 1, None), (1, 3, 5)],
                                  "order_id long, order_item_id int, seller_id long")
    assert rows(order_seller(items), "seller_id") == [(7,)]


def test_primary_payment_tie_largest_type(spark):
    pay = spark.createDataFrame([(1, "boleto", 1, Decimal("5")), (1, "voucher", 2, Decimal("5")),
                                 (1, "credit_card", 3, Decimal("4"))],
                                "order_id long, payment_type string, payment_installments long, "
                                "payment_value decimal(22,2)")
    assert rows(order_payment(pay), "payment_type", "payment_installments") == [("voucher", 2)]


def test_latest_review(spark):
    rv = spark.createDataFrame([(1, 5, dt.datetime(2018, 1, 1)), (1, 2, dt.datetime(2018, 2, 1)),
                                (1, 4, dt.datetime(2017, 1, 1))],
                               "order_id long, review_score int, review_creation_date timestamp_ntz")
    assert rows(order_review(rv), "review_score") == [(2,)]


def test_dedup_is_order_free(spark):
    a = spark.createDataFrame([(1, 1, 9, 3), (1, 1, 2, 8), (2, 1, 4, 4)], "k long, j int, x long, y long")
    b = a.orderBy(F.desc("x")).repartition(3)
    assert sorted(rows(dedup(a, ["k", "j"]), "k", "x", "y")) == sorted(rows(dedup(b, ["k", "j"]), "k", "x", "y"))
    assert sorted(rows(dedup(a, ["k", "j"]), "k", "x")) == [(1, 2), (2, 4)]


def test_t11_title_case_and_t20_lookup(spark):
    df = spark.createDataFrame([("cama_mesa_banho",), ("unknown",)], "c string")
    assert [r.t for r in df.select(title_case(F.col("c")).alias("t")).collect()] == ["Cama Mesa Banho", "Unknown"]
    tr = spark.createDataFrame([("a", "X"), ("a", "Y")], "product_category_name string, product_category_name_english string")
    assert category_lookup(tr).count() == 1


def test_t12_range_cumulative_sum_shares_ties(spark):
    from ordermill.plans.sql_suite import pareto
    df = spark.createDataFrame([(1, Decimal(5)), (2, Decimal(5)), (3, Decimal(3))],
                               "seller_id long, revenue decimal(22,2)")
    got = rows(pareto(df, top_n=3), "rnk", "seller_id", "pct_of_revenue", "pct_of_sellers")
    assert got == [(1, 1, 76.9, 33.3), (2, 2, 76.9, 66.7), (3, 3, 100.0, 100.0)]
    # top 1 must still see the tie beyond the cut
    assert rows(pareto(df, top_n=1), "pct_of_revenue") == [(76.9,)]


def test_t16_qcut_vs_ntile(spark):
    from ordermill.operators.ranking import global_ntile
    df = spark.createDataFrame([(i, i) for i in range(6)], "id long, v long")
    q = A.qcut(df, "v", "q")
    assert [r.q for r in q.orderBy("v").collect()] == [1, 1, 2, 3, 4, 4]
    n = global_ntile(df, 4, [("v", True), ("id", True)], "t")
    assert [r.t for r in n.orderBy("v").collect()] == [1, 1, 2, 2, 3, 4]


def test_t17_qcut_duplicate_edges_raise(spark):
    df = spark.createDataFrame([(i, 1) for i in range(6)], "id long, v long")
    with pytest.raises(Exception):
        A.qcut(df, "v", "q").collect()
    assert A.qcut(df, "v", "q", on_duplicate_edges="ignore").count() == 6


def test_rfm_truth_table(spark):
    """SURVEY 2.14, derived by hand from the rule order."""
    expect = {"Champions": [(2, 8), (3, 7), (3, 8), (4, 6), (4, 7), (4, 8)],
              "Loyal": [(1, 7), (1, 8), (2, 6), (2, 7), (3, 5), (3, 6), (4, 4), (4, 5)],
              "Potential Loyalists": [(3, 4)], "New Customers": [(4, 2), (4, 3)], "At Risk": [(1, 6)],
              "Lost": [(1, 2), (1, 3), (1, 4), (1, 5), (2, 2), (2, 3), (2, 4), (2, 5), (3, 2), (3, 3)]}
    by_key = {k: seg for seg, keys in expect.items() for k in keys}
    grid = spark.createDataFrame([(r, f, m) for r in range(1, 5) for f in range(1, 5) for m in range(1, 5)],
                                 "r int, f int, m int")
    got = grid.select("r", "f", "m", A.rfm_segment_expr(F.col("r"), F.col("f"), F.col("m")).alias("s")).collect()
    assert len(got) == 64
    for row in got:
        assert row.s == by_key[(row.r, row.f + row.m)], row


def test_t18_review_fan_out_policies(spark):
    from ordermill.plans.sql_suite import top_categories
    items = spark.createDataFrame([(1, 1, 10, Decimal("10.00"))], "order_id long, order_item_id int, product_id long, price decimal(12,2)")
    products = spark.createDataFrame([(10, "x")], "product_id long, product_category_name string")
    tr = spark.createDataFrame([("x", "X")], "product_category_name string, product_category_name_english string")
    rv = spark.createDataFrame([(1, 5, dt.datetime(2018, 1, 1)), (1, 1, dt.datetime(2018, 2, 1))],
                               "order_id long, review_score int, review_creation_date timestamp_ntz")
    fan = top_categories(items, products, tr, rv).first()
    assert (fan.revenue, fan.avg_review_score, fan.orders) == (20.0, 3.0, 1)
    one = top_categories(items, products, tr, rv, review_policy="latest").first()
    assert (one.revenue, one.avg_review_score) == (10.0, 1.0)


def test_pareto_top_pct_matches_top_n(spark):
    from ordermill.plans.sql_suite import pareto
    data = [(i, Decimal(v)) for i, v in enumerate([9, 9, 7, 5, 5, 5, 3, 2, 2, 1])]
    df = spark.createDataFrame(data, "seller_id long, revenue decimal(22,2)")
    pct = [tuple(r) for r in pareto(df, top_pct=50).collect()]
    top = [tuple(r) for r in pareto(df, top_n=5).collect()]
    assert pct == top and len(pct) == 5 and pct[-1][-1] == round(100 * 40 / 48, 1)


def test_qcut_general_q_and_reverse(spark):
    df = spark.createDataFrame([(i, i) for i in range(10)], "id long, v long")
    got = [r.q for r in A.qcut(df, "v", "q", q=5, reverse=True).orderBy("v").collect()]
    assert got == [5, 5, 4, 4, 3, 3, 2, 2, 1, 1]


@pytest.mark.parametrize("k", [1, 50, 400, 1000])
def test_hash_sample_threshold_is_exact(spark, k):
    from ordermill.operators.stats import hash_sample, sample_key
    df = spark.range(0, 700).withColumnRenamed("id", "order_id").withColumn("x", F.col("order_id") * 2)
    got = sorted(r.order_id for r in hash_sample(df, "order_id", k=k, oversample=1).collect())
    ref = (df.withColumn("h", sample_key(F.col("order_id"), df.schema["order_id"].dataType, 42))
             .orderBy("h", "order_id").limit(k))
    assert got == sorted(r.order_id for r in ref.collect()) and len(got) == min(k, 700)


def test_box_stats_whiskers_and_outliers_match_numpy(spark):
    import numpy as np
    from ordermill.operators.stats import box_stats
    data = {"a": [1, 2, 2, 3, 3, 3, 4, 20, -9], "b": [5, 5, 5, 5, 6]}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs] + [("a", None)], "g string, v long")
    got = {r.g: r for r in box_stats(df, "v", ["g"]).collect()}
    for g, vs in data.items():
        a = np.array(vs, dtype=float)
        q1, med, q3 = np.percentile(a, [25, 50, 75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = a[(a >= lo) & (a <= hi)]
        r = got[g]
        assert (r.q1, r.median, r.q3) == pytest.approx((q1, med, q3))
        assert (r.whisker_low, r.whisker_high) == (inside.min(), inside.max())
        assert r.outliers == int(((a < lo) | (a > hi)).sum()) and r.n == len(vs)
        assert r.mean == pytest.approx(a.mean())
