"""The order-grain master table: one row per delivered order.

Plan shape (what keeps it cheap at scale):

* every right side is reduced to one row per ``order_id`` *before* joining (revenue,
  modal category and primary seller come out of one aggregation per order and category),
  so the five order-keyed joins are 1:1 and share the ``order_id`` hash partitioning;
* customers and sellers are joined by key; AQE turns either into a broadcast join when
  its runtime size is under the threshold and splits skewed partitions otherwise;
* the category translation is reduced to one row per category before the lookup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordermill.functions.exact import from_cents, to_cents
from ordermill.functions.time import hours_between
from ordermill.operators.clean import clean_items, clean_orders, delivered_orders
from ordermill.operators.picks import order_payment, order_review, seller_key, with_category
from ordermill.sources.roles import Tables


def order_item_summary(items: DataFrame, products: DataFrame | None, default: str = "unknown") -> DataFrame:
    """order_id, total_price, total_freight, item_count, total_value, main_category,
    seller_id of the (clean) items.

    Items are first added up per order and category, in hash aggregates on numbers; the modal category
    (smallest name on ties) is then the greatest of an order's few counts.  A ``mode`` beside the sums would
    keep an object per order in an aggregate that sorts and serialises all of them."""
    it, cat = with_category(items, products)
    key, seller = seller_key(it)
    parts = it.groupBy("order_id", F.col(cat).alias("_om_cat")).agg(
        F.count(F.lit(1)).alias("_om_n"), F.count("order_item_id").alias("_om_items"), F.min(key).alias("_om_seller"),
        *[F.sum(to_cents(F.col(c))).alias(f"_om_{c}") for c in ("price", "freight_value")])
    name = F.col("_om_cat")
    # negative counts: the least struct is the greatest count, then the smallest name
    modal = F.min(F.when(name.isNotNull(), F.struct((-F.col("_om_n")).alias("n"), name.alias("name"))))["name"]
    money = lambda c: from_cents(F.coalesce(F.sum(f"_om_{c}"), F.lit(0).cast("bigint")))
    # a row per category is few, so an order's rows meet without another aggregate in the map tasks
    g = parts.repartition("order_id").groupBy("order_id").agg(
        money("price").alias("total_price"), money("freight_value").alias("total_freight"),
        F.sum("_om_items").alias("item_count"), F.coalesce(modal, F.lit(default)).alias("main_category"),
        seller(F.min("_om_seller")).alias("seller_id"))
    return g.select("order_id", "total_price", "total_freight", "item_count",
                    (F.col("total_price") + F.col("total_freight")).alias("total_value"),
                    "main_category", "seller_id")


def title_case(col: Column) -> Column:
    """Fallback label for untranslated categories: '_' -> ' ', then every letter that does not
    follow a letter large and all others small, so also after digits and apostrophes (``2nd_pc``
    gives ``2Nd Pc``).  A letter is a character whose cases differ; characters are mapped one by one
    (so ``ß`` stays as it is).  The lookup comes first: only names without a translation get here."""
    text = F.lower(F.replace(col, F.lit("_"), F.lit(" ")))
    char = lambda i: F.substring(text, i, F.lit(1))
    letter = lambda c: F.lower(c) != F.upper(c)
    titled = F.transform(F.sequence(F.lit(1), F.length(text)),
                         lambda i: F.when((i > 1) & letter(char(i - 1)), char(i)).otherwise(F.initcap(char(i))))
    return F.when(F.length(text) > 0, F.array_join(titled, "")).otherwise(text)


def category_lookup(translation: DataFrame) -> DataFrame:
    """One English name per category (duplicate keys keep the largest name)."""
    return translation.groupBy("product_category_name").agg(
        F.max("product_category_name_english").alias("product_category_name_english"))


def build_master(t: Tables, *, items_clean: DataFrame | None = None, orders_clean: DataFrame | None = None,
                 per_order: DataFrame | None = None, payment: DataFrame | None = None, review: DataFrame | None = None,
                 status: str = "delivered", lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """The master table from the raw role tables (cleaning included).

    Already computed parts can be passed in: cleaned orders or items, :func:`order_item_summary`,
    ``order_payment``, ``order_review``.  Parts stored in buckets of order_id join without a shuffle."""
    orders = orders_clean if orders_clean is not None else clean_orders(t.orders)
    delivered = delivered_orders(orders, status)
    if per_order is None:
        per_order = order_item_summary(items_clean if items_clean is not None else clean_items(t.items, lo, hi), t.products)
    m = (delivered
         .join(per_order, "order_id", "left")
         .join(payment if payment is not None else order_payment(t.payments), "order_id", "left")
         .join(review if review is not None else order_review(t.reviews, t.review_order), "order_id", "left"))
    customers = t.customers
    sellers = t.sellers
    m = m.join(customers, "customer_id", "left").join(sellers, "seller_id", "left")
    lookup = category_lookup(t.translation).withColumnRenamed("product_category_name", "main_category")
    m = m.join(lookup, "main_category", "left")
    english = F.coalesce(F.col("product_category_name_english"), title_case(F.col("main_category")))
    cols = (delivered.columns
            + ["total_price", "total_freight", "item_count", "total_value", "main_category", "seller_id",
               "payment_type", "payment_installments", "payment_value", "review_score"]
            + [c for c in customers.columns if c != "customer_id"]
            + [c for c in sellers.columns if c != "seller_id"])
    return m.select(*cols, english.alias("category_english"),
                    hours_between("order_estimated_delivery_date", "order_delivered_customer_date")
                    .alias("delay_hours"))

