"""Adapter from the TPC-H-style test tables to the eight role tables.

The test data has no marketplace tables, so each role is derived from a driver table
by fixed integer arithmetic (documented in FIXTURES.md section 2).  Everything is a
projection, filter or aggregate over the whole input tables, so the work grows with
the scale factor.  The DuckDB oracle re-states the same rules independently in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermill.functions.exact import from_cents, to_cents
from ordermill.sources.roles import MONEY, Tables

DAY = 86400

# Fixed values of the adapter (FIXTURES.md section 2).
DELIVERED_STATUSES = ["F", "O"]
PAYMENT_TYPES = {"A": "credit_card", "N": "boleto", "R": "voucher"}
UNTRANSLATED = ["brand_7", "brand_13"]


def _sec(ts: Column, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, ts)


# Columns of the test tables this adapter reads.  Declaring them skips schema inference
# (a footer-reading job per table and query) and prunes every other column at the scan.
INPUT_SCHEMAS = {
    "nation": "n_nationkey int, n_name string",
    "customer": "c_custkey bigint, c_nationkey int",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "part": "p_partkey bigint, p_brand string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz",
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                 "l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(INPUT_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def fixture_orders(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    day0 = F.col("o_orderdate")
    second_of_day = (k * 7919) % DAY
    return orders.select(
        k.alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.when(F.col("o_orderstatus").isin(DELIVERED_STATUSES), F.lit("delivered"))
         .otherwise(F.lit("shipped")).alias("order_status"),
        _sec(day0, second_of_day).alias("order_purchase_timestamp"),
        F.when(k % 53 == 0, F.lit(None))
         .otherwise(_sec(day0, (3 + (k * 11) % 37) * DAY + second_of_day + ((k * 31) % 24) * 3600))
         .cast("timestamp_ntz").alias("order_delivered_customer_date"),
        _sec(day0, (4 + (F.col("o_custkey") * 13) % 30 + (k % 10) * 3) * DAY)
         .alias("order_estimated_delivery_date"),
    )


# Texts that are no date, put in place of some dates (FIXTURES.md section 2).
BAD_DATES = ["n/a", "2017-13-45 00:00:00", ""]


def orders_as_text(orders: DataFrame) -> DataFrame:
    """The orders as a text export would hold them: dates as text, some of them garbage.  Each date
    column has its own rows, by the order's number."""
    def text(name: str, every: int) -> Column:
        bad = F.element_at(F.array(*[F.lit(b) for b in BAD_DATES]), (F.col("order_id") % len(BAD_DATES) + 1).cast("int"))
        return F.when(F.col("order_id") % every == 0, bad).otherwise(F.col(name).cast("string")).alias(name)
    every = {"order_purchase_timestamp": 41, "order_delivered_customer_date": 17, "order_estimated_delivery_date": 29}
    return orders.select(*[text(c, every[c]) if c in every else F.col(c) for c in orders.columns])


def _price(lineitem: DataFrame) -> Column:
    return F.col("l_extendedprice").cast(MONEY)


def fixture_items(lineitem: DataFrame) -> DataFrame:
    k = F.col("l_orderkey")
    return lineitem.select(
        k.alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.when((F.col("l_linenumber") <= 3) & (k % 10 >= 2), k % 10)
         .otherwise(F.col("l_suppkey")).alias("seller_id"),
        _price(lineitem).alias("price"),
        F.col("l_quantity").cast(MONEY).alias("freight_value"),
    )


def fixture_payments(lineitem: DataFrame) -> DataFrame:
    mapping = F.create_map(*[F.lit(x) for pair in PAYMENT_TYPES.items() for x in pair])
    return (lineitem.groupBy("l_orderkey", "l_returnflag")
            .agg(F.count(F.lit(1)).alias("payment_installments"),
                 from_cents(F.sum(to_cents(_price(lineitem)))).alias("payment_value"))
            .select(F.col("l_orderkey").alias("order_id"),
                    mapping[F.col("l_returnflag")].alias("payment_type"),
                    "payment_installments", "payment_value"))


def fixture_reviews(lineitem: DataFrame) -> DataFrame:
    k = F.col("l_orderkey")
    score = F.least(F.lit(5), 1 + F.col("l_quantity").cast("int") % 3
                    + F.floor((k % 10) / 3).cast("int"))
    return (lineitem.where(F.col("l_linestatus") == "F")
            .select(k.alias("order_id"),
                    score.cast("int").alias("review_score"),
                    F.col("l_shipdate").alias("review_creation_date"),
                    F.col("l_linenumber").alias("review_line"),
                    F.col("l_partkey").alias("review_part"),
                    F.col("l_suppkey").alias("review_supp")))


def fixture_customers(customer: DataFrame, nation: DataFrame) -> DataFrame:
    return (customer.join(nation, customer.c_nationkey == nation.n_nationkey)
            .select(F.col("c_custkey").alias("customer_id"),
                    F.floor(F.col("c_custkey") / 2).cast("bigint").alias("customer_unique_id"),
                    F.col("n_name").alias("customer_state")))


def fixture_sellers(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    return (supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
            .select(F.col("s_suppkey").alias("seller_id"), F.col("n_name").alias("seller_state")))


def fixture_products(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_partkey").alias("product_id"),
        F.when(F.col("p_partkey") % 41 == 0, F.lit(None).cast("string"))
         .otherwise(F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("_"))))
         .alias("product_category_name"))


def fixture_translation(products: DataFrame) -> DataFrame:
    cats = (products.where(F.col("product_category_name").isNotNull())
            .where(~F.col("product_category_name").isin(UNTRANSLATED))
            .select("product_category_name").distinct())
    return cats.select("product_category_name",
                       F.concat(F.lit("EN "), F.col("product_category_name"))
                        .alias("product_category_name_english"))


def fixture_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Role tables over the whole test tables at ``sf_dir``."""
    lineitem = _read(spark, sf_dir, "lineitem")
    nation = _read(spark, sf_dir, "nation")
    products = fixture_products(_read(spark, sf_dir, "part"))
    return Tables(
        orders=fixture_orders(_read(spark, sf_dir, "orders")),
        items=fixture_items(lineitem),
        payments=fixture_payments(lineitem),
        reviews=fixture_reviews(lineitem),
        customers=fixture_customers(_read(spark, sf_dir, "customer"), nation),
        sellers=fixture_sellers(_read(spark, sf_dir, "supplier"), nation),
        products=products,
        translation=fixture_translation(products),
        review_order=("review_creation_date", "review_line", "review_part", "review_supp"),
    )
