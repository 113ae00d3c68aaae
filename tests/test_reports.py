"""What cleaning rejects is counted; repeated sellers; title case."""

import os
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordermill.operators.quality import null_report, rejected_values
from ordermill.plans import sql_suite as Q
from ordermill.plans.master import title_case
from ordermill.sources.readers import RECORD, read_csv_table, rejected_csv


def test_title_case_equals_python(spark):
    names = ["2nd_pc", "d'agua", "cama_mesa_banho", "", "a", "1a2b_c3", "ÉCLAIR_é", "pcs&co", "o'neil's_2x4", "ALL CAPS", "漢a_b", "x__y", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(title_case(F.col("n"))).collect()]
    assert got == [None if n is None else n.replace("_", " ").title() for n in names]


def test_null_report_counts_what_does_not_parse(spark):
    df = spark.createDataFrame([("2018-01-01 10:00:00", None), ("n/a", "2018-01-05"), (None, ""), ("2018-02-30", "x"), ("n/a", "x")],
                               "order_purchase_timestamp string, order_delivered_customer_date string")
    rows = {r.column: (r.null_count, r.unparsable_count) for r in null_report(df, unparsable=True).collect()}
    assert rows == {"order_purchase_timestamp": (4, 3), "order_delivered_customer_date": (4, 3)}
    assert null_report(df).columns == ["column", "null_count"]
    bad = [tuple(r) for r in rejected_values(df, {c: T.TimestampNTZType() for c in [*df.columns, "absent"]}).collect()]
    assert bad == [("order_delivered_customer_date", "x", 2), ("order_delivered_customer_date", "", 1),
                   ("order_purchase_timestamp", "n/a", 2), ("order_purchase_timestamp", "2018-02-30", 1)]
    assert rejected_values(df, {"absent": T.LongType()}).count() == 0


def test_csv_rejects_values_and_records(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="om-rejected-"), "items.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("order_id,order_item_id,product_id,seller_id,price,freight_value\n"
                "o1,1,p,s,10.50,1.00\no1,two,p,s,ten,1.00\no2,1,p,s,ten,\no3,1,p\no4,1,p,s,1.00,2.00,extra\n")
    got = {(r.column, r.value): r.rows for r in rejected_csv(spark, path, "items").collect()}
    assert got == {("order_item_id", "two"): 1, ("price", "ten"): 2, (RECORD, "o3,1,p"): 1, (RECORD, "o4,1,p,s,1.00,2.00,extra"): 1}
    table = read_csv_table(spark, path, "items")  # all records stay, with what could be read
    assert table.count() == 5 and table.where("price IS NULL").count() == 3


def seller_tables(spark, copies):
    items = spark.createDataFrame([(o, 1, "p", f"s{o % 3}", Decimal(o + 1), Decimal(1)) for o in range(60)],
                                  "order_id long, order_item_id int, product_id string, seller_id string, price decimal(12,2), freight_value decimal(12,2)")
    stamp = F.lit("2018-01-01 00:00:00").cast("timestamp_ntz")
    orders = spark.range(60).select(F.col("id").alias("order_id"), F.lit("delivered").alias("order_status"),
                                    (stamp + F.make_dt_interval((F.col("id") % 5).cast("int"))).alias("order_delivered_customer_date"),
                                    (stamp + F.expr("INTERVAL 2 DAYS")).alias("order_estimated_delivery_date"))
    reviews = spark.createDataFrame([(o, 1 + o % 5) for o in range(0, 60, 2)] + [(4, 5), (4, 1)], "order_id long, review_score int")
    sellers = spark.createDataFrame([("s0", "SP")] * copies + [("s1", "SP"), ("s1", "RJ"), ("s2", None)], "seller_id string, seller_state string")
    return sellers, items, orders, reviews


@pytest.mark.parametrize("copies", [1, 2, 5])
def test_repeated_sellers_multiply_sums_as_the_join_does(spark, copies):
    sellers, items, orders, reviews = seller_tables(spark, copies)
    got = {(r.seller_id, r.seller_state): (r.total_orders, r.total_revenue, r.avg_review, r.late_rate_pct)
           for r in Q.seller_health_items(sellers, items, orders, reviews).collect()}
    for name, df in (("w_sellers", sellers), ("w_items", items), ("w_orders", orders), ("w_reviews", reviews)):
        df.createOrReplaceTempView(name)
    want = spark.sql("""
        SELECT s.seller_id, s.seller_state, count(DISTINCT i.order_id), CAST(sum(i.price) AS DOUBLE), round(avg(r.review_score), 2),
          round(100.0 * count_if(o.order_delivered_customer_date > o.order_estimated_delivery_date) / count(*), 2)
        FROM w_items i JOIN w_orders o ON o.order_id = i.order_id JOIN w_sellers s ON s.seller_id = i.seller_id
        LEFT JOIN w_reviews r ON r.order_id = o.order_id GROUP BY ALL""").collect()
    assert got == {(r[0], r[1]): (r[2], r[3], r[4], float(r[5])) for r in want} and len(got) == 4


def test_repeated_sellers_in_pareto(spark):
    sellers, items, orders, _ = seller_tables(spark, 3)
    got = {r.seller_id: r.revenue for r in Q.pareto_sellers(sellers, items, orders).collect()}
    each = {f"s{k}": sum(o + 1 for o in range(60) if o % 3 == k) for k in range(3)}
    assert got == {"s0": 3 * each["s0"], "s1": 2 * each["s1"], "s2": each["s2"]}
