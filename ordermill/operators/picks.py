"""Deduplication and per-key picks, deterministic whatever the input order.

The reference relies on file order ("keep first", "last review", "first seller").  A
distributed table has no file order, so each pick is the first row of its key in an explicit,
total order: a ``row_number`` over the key of which only number 1 is wanted.  Spark turns that into
a group limit, which keeps one row per key in every map task before the shuffle and again after it:
a key holding a third of all rows leaves each task as one row, rows travel as they are, and no
row is packed into a struct and compared field by field in a sort aggregate.  Only columns that the
pick needs travel.  (Figures of both forms are in PLANS.md.)
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordermill.functions.exact import from_cents, to_cents


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key (null keys are one key) in ``order``."""
    rn = "_om_rn"
    return (df.withColumn(rn, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
            .where(F.col(rn) == 1).drop(rn))


def dedup(df: DataFrame, keys: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """One row per ``keys``: the first by ``order_by`` (ascending), then by every other
    column in schema order.  Column order is preserved."""
    rest = [c for c in df.columns if c not in keys and c not in order_by]
    order = [F.col(c).asc_nulls_first() for c in [*order_by, *rest]]
    return first_rows(df, keys, order) if order else df.distinct()


# --- aggregate expressions shared by the single-purpose picks and the master build ------

def revenue_aggs() -> list[Column]:
    # summed as integer cents (exact, primitive arithmetic), returned as DECIMAL money;
    # pandas sums of an all-null group are 0 (not null)
    def money_sum(c: str) -> Column:
        return from_cents(F.coalesce(F.sum(to_cents(F.col(c))), F.lit(0).cast("bigint")))
    return [money_sum("price").alias("total_price"),
            money_sum("freight_value").alias("total_freight"),
            F.count("order_item_id").alias("item_count")]


def category_agg(category: str, default: str = "unknown") -> Column:
    """Most frequent non-null category; ties -> smallest name; none -> ``default``."""
    return F.coalesce(F.mode(F.col(category), True), F.lit(default)).alias("main_category")


def seller_agg() -> Column:
    """First non-null seller by item number (then seller id)."""
    s = F.col("seller_id")
    return F.min(F.when(s.isNotNull(), F.struct(F.col("order_item_id"), s)))["seller_id"].alias("seller_id")


_SPREAD = 1 << 64  # apart by this, item numbers and seller ids share one number


def seller_key(items: DataFrame) -> tuple[Column, Callable[[Column], Column]]:
    """(key, seller of the least key): the rule of :func:`seller_agg` as one value per row.  With an
    integer item number and seller id it is a number, which hash aggregation updates in place; else a struct."""
    item, s = F.col("order_item_id"), F.col("seller_id")
    ints = (T.ByteType, T.ShortType, T.IntegerType)
    if isinstance(items.schema["order_item_id"].dataType, ints) and \
            isinstance(items.schema["seller_id"].dataType, (*ints, T.LongType)):
        dtype, wide = items.schema["seller_id"].dataType, lambda v: F.lit(Decimal(v)).cast("decimal(20,0)")
        number = F.coalesce(item.cast("bigint"), F.lit(-(1 << 31) - 1)).cast("decimal(11,0)")  # a null number comes first
        key = (number * wide(_SPREAD) + s.cast("decimal(20,0)")).cast("decimal(38,0)")
        return F.when(s.isNotNull(), key), lambda k: (
            F.pmod(k + wide(_SPREAD >> 1), wide(_SPREAD)).cast("decimal(20,0)") - wide(_SPREAD >> 1)).cast(dtype)
    return F.when(s.isNotNull(), F.struct(item, s)), lambda k: k["seller_id"]


def with_category(items: DataFrame, products: DataFrame | None, category: str = "category") -> tuple[DataFrame, str]:
    """Items carrying a category column: their own ``category`` if present, else the
    product's category through a left join on product_id."""
    if category in items.columns:
        return items, category
    if products is None:
        raise ValueError("items have no category column and no products table was given")
    # each task hashes its products instead of sorting its items
    named = products.select("product_id", "product_category_name").hint("shuffle_hash")
    return (items.join(named, "product_id", "left"),
            "product_category_name")


def order_revenue(items: DataFrame) -> DataFrame:
    """order_id, total_price, total_freight, item_count, total_value (price + freight)."""
    g = items.groupBy("order_id").agg(*revenue_aggs())
    return g.withColumn("total_value", F.col("total_price") + F.col("total_freight"))


def order_category(items: DataFrame, products: DataFrame | None = None, default: str = "unknown") -> DataFrame:
    """order_id, main_category (modal category of the order's items)."""
    it, cat = with_category(items, products)
    return it.groupBy("order_id").agg(category_agg(cat, default))


def order_seller(items: DataFrame) -> DataFrame:
    """order_id, seller_id (the primary seller: first non-null one by item number, then id; null
    for an order without any)."""
    rows = items.select("order_id", "order_item_id", "seller_id")
    order = [F.col("seller_id").isNull(), F.col("order_item_id").asc_nulls_first(), F.col("seller_id").asc_nulls_first()]
    return first_rows(rows, ["order_id"], order).select("order_id", "seller_id")


def order_payment(payments: DataFrame) -> DataFrame:
    """The largest payment of each order; equal values -> the largest payment_type."""
    names = ["payment_value", "payment_type", "payment_installments"]
    return first_rows(payments.select("order_id", *names), ["order_id"], [F.col(c).desc_nulls_last() for c in names]) \
        .select("order_id", "payment_type", "payment_installments", "payment_value")


def order_review(reviews: DataFrame, order_by: Sequence[str] = ("review_creation_date",)) -> DataFrame:
    """order_id, review_score of the latest review: greatest by ``order_by``, then by the score.
    No other column of the reviews (their title and text above all) is read."""
    order_by = [c for c in order_by if c in reviews.columns and c not in ("order_id", "review_score")]
    rows = reviews.select("order_id", *order_by, "review_score")
    return first_rows(rows, ["order_id"], [F.col(c).desc_nulls_last() for c in [*order_by, "review_score"]]) \
        .select("order_id", "review_score")
