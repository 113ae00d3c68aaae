"""The per-order item summary: hash aggregates on numbers, the same picks as a brute force."""

import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ordermill.plans.master import order_item_summary

SCHEMA = "order_id long, order_item_id {}, product_id long, seller_id {}, price decimal(12,2), freight_value decimal(12,2)"
LOW, HIGH = -2 ** 63, 2 ** 63 - 1


def rows_of(sellers):
    rnd = random.Random(8)
    rows = [(rnd.choice([42, rnd.randint(1, 60), None]), rnd.choice([None, -2 ** 31, 2 ** 31 - 1, 0, 1, 2, 3]), rnd.randint(1, 40),
             rnd.choice([None, *sellers]), rnd.choice([None, Decimal(rnd.randint(0, 9999)) / 100]),
             Decimal(rnd.randint(0, 500)) / 100) for _ in range(1500)]
    return [*rows, (900, 1, 999, None, None, None)]


@pytest.mark.parametrize("item, seller, sellers", [
    ("int", "long", [LOW, LOW + 1, -1, 0, 7, HIGH]), ("int", "int", [-2 ** 31, -1, 0, 2 ** 31 - 1]),
    ("long", "long", [LOW, -1, 7, HIGH]), ("int", "string", ["a", "", "b"])])
def test_summary_equals_brute_force(spark, item, seller, sellers):
    rows = rows_of(sellers)
    products = {p: None if p % 7 == 0 else f"c{p % 5}" for p in range(1, 41)}
    got = {r.order_id: r for r in order_item_summary(
        spark.createDataFrame(rows, SCHEMA.format(item, seller)),
        spark.createDataFrame(list(products.items()), "product_id long, product_category_name string")).collect()}
    orders = {}
    for r in rows:
        orders.setdefault(r[0], []).append(r)
    assert set(got) == set(orders)
    for order, mine in orders.items():
        g = got[order]
        counts = Counter(products.get(r[2]) for r in mine if products.get(r[2]) is not None)
        assert g.main_category == (min(counts, key=lambda c: (-counts[c], c)) if counts else "unknown")
        sold = [((r[1] is not None, r[1] or 0), r[3]) for r in mine if r[3] is not None]
        assert g.seller_id == (min(sold)[1] if sold else None)
        assert g.total_price == sum(r[4] or 0 for r in mine) and g.total_freight == sum(r[5] or 0 for r in mine)
        assert g.item_count == sum(r[1] is not None for r in mine) and g.total_value == g.total_price + g.total_freight


def test_no_object_per_order_and_no_sort_by_product(spark):
    items = spark.createDataFrame(rows_of([1, 2]), SCHEMA.format("int", "long"))
    products = spark.range(50).select(F.col("id").alias("product_id"), F.lit("c").alias("product_category_name"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = order_item_summary(items, products)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "ObjectHashAggregate" not in plan and "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
