"""Role tables: the eight logical inputs every operator is written against.

Operators never assume where a table came from.  ``Tables`` bundles the eight role
DataFrames; the CSV reader (``readers.read_marketplace_csv``) and the test-table adapter
(``fixture.fixture_tables``) both produce one.  Ids may be strings (CSV exports) or
longs (test tables); no operator depends on the id type.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Column names the operators read, per role.
ORDERS = ("order_id", "customer_id", "order_status", "order_purchase_timestamp",
          "order_delivered_customer_date", "order_estimated_delivery_date")
ITEMS = ("order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value")
PAYMENTS = ("order_id", "payment_type", "payment_installments", "payment_value")
REVIEWS = ("order_id", "review_score", "review_creation_date")
CUSTOMERS = ("customer_id", "customer_unique_id", "customer_state")
SELLERS = ("seller_id", "seller_state")
PRODUCTS = ("product_id", "product_category_name")
TRANSLATION = ("product_category_name", "product_category_name_english")

DATE_COLUMNS = ("order_purchase_timestamp", "order_delivered_customer_date",
                "order_estimated_delivery_date")

DATE_TYPES = {c: T.TimestampNTZType() for c in DATE_COLUMNS}

MONEY = T.DecimalType(12, 2)

# Explicit CSV schemas (no inference) for the public marketplace export layout.
CSV_SCHEMAS: dict[str, T.StructType] = {
    "orders": T.StructType([
        T.StructField("order_id", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("order_status", T.StringType()),
        # dates arrive as text and are parsed with try_to_timestamp (bad text -> null)
        T.StructField("order_purchase_timestamp", T.StringType()),
        T.StructField("order_approved_at", T.StringType()),
        T.StructField("order_delivered_carrier_date", T.StringType()),
        T.StructField("order_delivered_customer_date", T.StringType()),
        T.StructField("order_estimated_delivery_date", T.StringType()),
    ]),
    "items": T.StructType([
        T.StructField("order_id", T.StringType()),
        T.StructField("order_item_id", T.IntegerType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("seller_id", T.StringType()),
        T.StructField("shipping_limit_date", T.StringType()),
        T.StructField("price", MONEY),
        T.StructField("freight_value", MONEY),
    ]),
    "payments": T.StructType([
        T.StructField("order_id", T.StringType()),
        T.StructField("payment_sequential", T.IntegerType()),
        T.StructField("payment_type", T.StringType()),
        T.StructField("payment_installments", T.LongType()),
        T.StructField("payment_value", T.DecimalType(22, 2)),
    ]),
    "reviews": T.StructType([
        T.StructField("review_id", T.StringType()),
        T.StructField("order_id", T.StringType()),
        T.StructField("review_score", T.IntegerType()),
        T.StructField("review_comment_title", T.StringType()),
        T.StructField("review_comment_message", T.StringType()),
        T.StructField("review_creation_date", T.TimestampNTZType()),
        T.StructField("review_answer_timestamp", T.TimestampNTZType()),
    ]),
    "customers": T.StructType([
        T.StructField("customer_id", T.StringType()),
        T.StructField("customer_unique_id", T.StringType()),
        T.StructField("customer_zip_code_prefix", T.StringType()),
        T.StructField("customer_city", T.StringType()),
        T.StructField("customer_state", T.StringType()),
    ]),
    "sellers": T.StructType([
        T.StructField("seller_id", T.StringType()),
        T.StructField("seller_zip_code_prefix", T.StringType()),
        T.StructField("seller_city", T.StringType()),
        T.StructField("seller_state", T.StringType()),
    ]),
    "products": T.StructType([
        T.StructField("product_id", T.StringType()),
        T.StructField("product_category_name", T.StringType()),
        T.StructField("product_name_lenght", T.IntegerType()),
        T.StructField("product_description_lenght", T.IntegerType()),
        T.StructField("product_photos_qty", T.IntegerType()),
        T.StructField("product_weight_g", T.IntegerType()),
        T.StructField("product_length_cm", T.IntegerType()),
        T.StructField("product_height_cm", T.IntegerType()),
        T.StructField("product_width_cm", T.IntegerType()),
    ]),
    "translation": T.StructType([
        T.StructField("product_category_name", T.StringType()),
        T.StructField("product_category_name_english", T.StringType()),
    ]),
}


@dataclass(frozen=True)
class Tables:
    """The eight role tables.  ``review_order`` names the columns that decide which
    review of an order is the latest (compared in this order, then all other columns)."""

    orders: DataFrame
    items: DataFrame
    payments: DataFrame
    reviews: DataFrame
    customers: DataFrame
    sellers: DataFrame
    products: DataFrame
    translation: DataFrame
    review_order: tuple[str, ...] = ("review_creation_date",)

    def role_names(self) -> list[str]:
        return [f.name for f in fields(self) if f.name != "review_order"]

    def frames(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in self.role_names()}
