"""Named queries over the test tables: ``name -> (spark, sf_dir) -> DataFrame``.

Each entry runs an ordermill operator over the *whole* role tables derived from the
test data.  DECIMAL outputs are returned as DOUBLE (exact for two-decimal money) so
results compare across engines.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordermill.operators import clean, picks, quality
from ordermill.plans import analyses as A
from ordermill.plans import sql_suite as Q
from ordermill.plans.master import build_master, order_item_summary
from ordermill.session import app_key, materialize
from ordermill.sources.fixture import INPUT_SCHEMAS, fixture_tables, orders_as_text
from ordermill.sources.roles import DATE_TYPES, Tables

# The test tables' dates run 1995-2001, so the fixed RFM snapshot is placed just after.
FIXTURE_SNAPSHOT = "2001-12-01"


def decimals_to_double(df: DataFrame) -> DataFrame:
    cols = [F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
            for f in df.schema.fields]
    return df.select(*cols)


# The cleaning products (de-duplicated items, order-grain parts, the master table) are built once
# per (application, input folder) and materialised to the reliable checkpoint folder, as the
# reference writes them once and runs every later step on the written files.  They hold for the
# input files they were built from: each use lists the folder's files (path, length, time of change),
# and a changed listing builds the product anew.
_PRODUCTS: dict[tuple[str, str, str], tuple[tuple, DataFrame]] = {}
_TABLES: dict[tuple[str, str], tuple[tuple, Tables]] = {}


def input_listing(spark: SparkSession, sf: str) -> tuple:
    """(path, bytes, time of change) of every input file of the role tables."""
    paths = [f"{sf}/{name}.parquet" for name in INPUT_SCHEMAS]
    try:
        context = spark.sparkContext
    except Exception:  # noqa: BLE001  (Spark Connect has no context: Spark lists the files)
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
        return tuple(sorted(map(tuple, files.select("path", "length", "modificationTime").collect())))
    out, open_ = [], [context._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    conf = context._jsc.hadoopConfiguration()
    while open_:
        path = open_.pop()
        for status in path.getFileSystem(conf).listStatus(path):
            if status.isDirectory():
                open_.append(status.getPath())
            else:
                out.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return tuple(sorted(out))


def _product(spark: SparkSession, sf: str, name: str, build, store: bool = True, bucket_by: tuple[str, ...] = ()) -> DataFrame:
    """Products are parquet, so their readers prune columns and push filters; those with one row
    per order are clustered by order_id, so that they join without a shuffle."""
    key, listing = (app_key(spark), sf, name), input_listing(spark, sf)
    if key not in _PRODUCTS or _PRODUCTS[key][0] != listing:
        _PRODUCTS[key] = listing, materialize(build(), columnar=True, bucket_by=bucket_by) if store else build()
    return _PRODUCTS[key][1]


def clear_products() -> None:
    """Forget all products, so that the next query builds its own from the input files."""
    _PRODUCTS.clear()
    _TABLES.clear()


PER_ORDER = ("order_id",)


def _items_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return _product(spark, sf, "items_dedup",
                    lambda: picks.dedup(tables_for(spark, sf).items, ["order_id", "order_item_id"]))


def _items_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Clipping is a projection over the stored de-duplicated items: nothing is written again."""
    return _product(spark, sf, "items_clean", lambda: clean.winsorise(_items_dedup(spark, sf), "price"), store=False)


def _orders_clean(spark: SparkSession, sf: str) -> DataFrame:
    return _product(spark, sf, "orders_clean", lambda: clean.clean_orders(tables_for(spark, sf).orders), bucket_by=PER_ORDER)


def _order_payment(spark: SparkSession, sf: str) -> DataFrame:
    return _product(spark, sf, "order_payment", lambda: picks.order_payment(tables_for(spark, sf).payments),
                    bucket_by=PER_ORDER)


def _order_review(spark: SparkSession, sf: str) -> DataFrame:
    t = tables_for(spark, sf)
    return _product(spark, sf, "order_review", lambda: picks.order_review(t.reviews, t.review_order), bucket_by=PER_ORDER)


def _item_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _product(spark, sf, "item_summary",
                    lambda: order_item_summary(_items_clean(spark, sf), tables_for(spark, sf).products), bucket_by=PER_ORDER)


def master_plan(spark: SparkSession, sf: str) -> DataFrame:
    """The master as a plan over its stored parts."""
    return build_master(tables_for(spark, sf), orders_clean=_orders_clean(spark, sf), per_order=_item_summary(spark, sf),
                        payment=_order_payment(spark, sf), review=_order_review(spark, sf))


def _master(spark: SparkSession, sf: str) -> DataFrame:
    return _product(spark, sf, "master", lambda: master_plan(spark, sf))


def tables_for(spark: SparkSession, sf: str) -> Tables:
    """The (lazy) role tables of one input folder, listed once as long as its files stay."""
    key, listing = (app_key(spark), sf), input_listing(spark, sf)
    if key not in _TABLES or _TABLES[key][0] != listing:
        _TABLES[key] = listing, fixture_tables(spark, sf)
    return _TABLES[key][1]


def _tables(fn):
    return lambda spark, sf: fn(tables_for(spark, sf))


def _on_master(fn):
    return lambda spark, sf: fn(_master(spark, sf))


# seller scores and RFM segments are computed once and the tier counts, histogram and
# segment summary derive from them, as in the reference's analysis run
def _seller_health(spark: SparkSession, sf: str) -> DataFrame:
    return _product(spark, sf, "seller_health", lambda: A.seller_health(_master(spark, sf)))


def _rfm(spark: SparkSession, sf: str) -> DataFrame:
    return _product(spark, sf, "rfm_segments", lambda: A.rfm_segments(_master(spark, sf)))




RAW: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    # cleaning and reports
    "profile_tables": _tables(quality.profile_tables),
    "null_report": _tables(lambda t: quality.null_report(t.orders)),
    "date_report": _tables(lambda t: quality.null_report(orders_as_text(t.orders), unparsable=True)),
    "rejected_dates": _tables(lambda t: quality.rejected_values(orders_as_text(t.orders), DATE_TYPES)),
    "parsed_orders": _tables(lambda t: clean.clean_orders(orders_as_text(t.orders))),
    "dedup_report": lambda spark, sf: quality.dedup_report(
        tables_for(spark, sf).orders, tables_for(spark, sf).items,
        orders_dedup=_orders_clean(spark, sf), items_dedup=_items_dedup(spark, sf)),
    "clean_orders": _orders_clean,
    "clean_items": _items_clean,
    "price_bounds": lambda spark, sf: clean.quantile_bounds(_items_dedup(spark, sf), "price")
                                           .select(F.col("p_lo").alias("p01"), F.col("p_hi").alias("p99")),
    "delivered_orders": lambda spark, sf: clean.delivered_orders(_orders_clean(spark, sf)),
    "delivery_summary": lambda spark, sf: clean.delivery_summary(clean.delivered_orders(_orders_clean(spark, sf))),
    "order_revenue": lambda spark, sf: picks.order_revenue(_items_clean(spark, sf)),
    "order_category": lambda spark, sf: picks.order_category(_items_dedup(spark, sf),
                                                             tables_for(spark, sf).products),
    "order_seller": lambda spark, sf: picks.order_seller(_items_dedup(spark, sf)),
    "order_payment": _order_payment,
    "order_review": _order_review,
    "master": _master,
    # the ten SQL analyses
    "sql_monthly_trend": _tables(lambda t: Q.monthly_trend_sql(t.orders, t.items)),
    "sql_top_categories": _tables(lambda t: Q.top_categories(t.items, t.products, t.translation, t.reviews)),
    "sql_late_by_state": _tables(lambda t: Q.late_by_state(t.orders, t.customers)),
    "sql_review_by_timeliness": _tables(lambda t: Q.review_by_timeliness(t.orders, t.reviews)),
    "sql_seller_health": _tables(lambda t: Q.seller_health_items(t.sellers, t.items, t.orders, t.reviews)),
    "sql_payment_breakdown": _tables(lambda t: Q.payment_breakdown(t.payments, t.orders)),
    "sql_peak_times": _tables(lambda t: Q.peak_times(t.orders)),
    "sql_pareto_sellers": _tables(lambda t: Q.pareto_sellers(t.sellers, t.items, t.orders)),
    "sql_pareto_sellers_pct": _tables(lambda t: Q.pareto_sellers(t.sellers, t.items, t.orders, top_pct=20)),
    "sql_mom_growth": _tables(lambda t: Q.mom_growth(t.orders, t.items)),
    "sql_rfm_scores": _tables(lambda t: Q.rfm_ntile(t.customers, t.orders, t.items, snapshot=FIXTURE_SNAPSHOT)),
    # analyses over the master table
    "monthly_trend": _on_master(A.monthly_trend),
    "monthly_highlights": _on_master(A.monthly_highlights),
    "category_revenue": _on_master(A.category_revenue),
    "state_delivery": _on_master(A.state_delivery),
    "state_delivery_mean": _on_master(lambda m: A.state_delivery_mean(m, digits=6)),
    "delay_review_corr": _on_master(lambda m: A.delay_review_corr(m, digits=6)),
    "delay_review_corr_sample": _on_master(lambda m: A.delay_review_corr(m, digits=6, fit_on="sample")),
    "delay_review_sample": _on_master(A.delay_review_sample),
    "delay_review_trendline": _on_master(lambda m: A.delay_review_trendline(m, digits=6)),
    "review_box_stats": _on_master(A.review_box_stats),
    "payment_share": _on_master(A.payment_share),
    "installment_distribution": _on_master(A.installment_distribution),
    "order_heatmap": _on_master(A.order_heatmap),
    "seller_health": _seller_health,
    "seller_health_histogram": lambda spark, sf: A.health_histogram(_seller_health(spark, sf)),
    "seller_tiers": lambda spark, sf: A.tier_counts(_seller_health(spark, sf)),
    "rfm_segments": _rfm,
    "rfm_segment_summary": lambda spark, sf: A.segment_summary(_rfm(spark, sf)),
    "weekly_revenue": _on_master(A.weekly_revenue),
    "revenue_forecast": _on_master(A.revenue_forecast),
    "executive_kpis": _on_master(A.executive_kpis),
    "late_share_top_states": _on_master(A.late_share_top_states),
    "late_vs_on_time_score": _on_master(A.late_vs_on_time_score),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda fn: (lambda spark, sf: decimals_to_double(fn(spark, sf))))(fn)
            for name, fn in RAW.items()}
