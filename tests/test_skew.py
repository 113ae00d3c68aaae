"""A key holding a third of all rows: results equal a brute-force pandas computation."""

import random
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ordermill.operators.picks import dedup, order_category, order_revenue, order_seller
from ordermill.operators.ranking import global_row_number


@pytest.fixture(scope="module")
def hot_items(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(3000):
        order = 42 if i % 3 == 0 else rnd.randint(1, 400)
        item = rnd.randint(1, 60 if order == 42 else 4)          # many duplicate (order, item) pairs
        rows.append((order, item, rnd.randint(1, 30), rnd.choice([None, 7, 8, 9]),
                     Decimal(rnd.randint(100, 99999)) / 100, Decimal(rnd.randint(0, 500)) / 100))
    pdf = pd.DataFrame(rows, columns=["order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value"])
    df = spark.createDataFrame(rows, "order_id long, order_item_id int, product_id long, seller_id long, "
                                     "price decimal(12,2), freight_value decimal(12,2)")
    return pdf, df


def _first_rows(pdf):
    key = ["order_id", "order_item_id"]
    rest = ["product_id", "seller_id", "price", "freight_value"]
    s = pdf.sort_values(key + rest, na_position="first", kind="mergesort")
    return s.drop_duplicates(key, keep="first")


def test_dedup_hot_key(hot_items):
    pdf, df = hot_items
    want = sorted(_first_rows(pdf).itertuples(index=False, name=None), key=str)
    got = sorted((tuple(r) for r in dedup(df, ["order_id", "order_item_id"]).collect()), key=str)
    assert [tuple(None if pd.isna(x) else x for x in w) for w in want] == got


def test_per_order_picks_hot_key(hot_items):
    pdf, df = hot_items
    d = _first_rows(pdf)
    rev = {r.order_id: (r.total_price, r.item_count) for r in order_revenue(dedup(df, ["order_id", "order_item_id"])).collect()}
    g = d.groupby("order_id")
    for oid, part in g:
        assert rev[oid] == (sum(part["price"]), len(part))
    sel = {r.order_id: r.seller_id for r in order_seller(dedup(df, ["order_id", "order_item_id"])).collect()}
    for oid, part in g:
        nn = part.dropna(subset=["seller_id"]).sort_values("order_item_id")
        assert sel[oid] == (None if nn.empty else int(nn["seller_id"].iloc[0]))


def test_modal_category_hot_key(spark, hot_items):
    pdf, df = hot_items
    items = df.withColumn("category", F.concat(F.lit("c"), (F.col("product_id") % 5).cast("string")))
    got = dict((r.order_id, r.main_category) for r in order_category(items).collect())
    p = pdf.assign(category="c" + (pdf["product_id"] % 5).astype(str))
    for oid, part in p.groupby("order_id"):
        counts = part["category"].value_counts()
        best = sorted(counts[counts == counts.max()].index)[0]
        assert got[oid] == best


def test_ranking_hot_value(spark, hot_items):
    _, df = hot_items
    base = df.groupBy("order_id", "order_item_id").agg(F.sum("price").alias("v"))
    base = base.withColumn("v", F.when(F.col("order_id") == 42, F.lit(Decimal(1))).otherwise(F.col("v")))
    order = [("v", True), ("order_id", True), ("order_item_id", True)]
    a = global_row_number(base, order, "rn", partitions=6)
    b = global_row_number(base, order, "rn", method="window")
    assert a.exceptAll(b).count() == 0
