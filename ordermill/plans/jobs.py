"""The two batch jobs: cleaning (raw tables -> cleaned tables and master) and analyses
(master -> analysis tables).  Both read and write through ``ordermill.sources``.

    python -m ordermill.plans.jobs clean   --raw DIR --out DIR [--format parquet|csv]
    python -m ordermill.plans.jobs clean   --fixture SF_DIR --out DIR   (the TPC-H-style test tables)
    python -m ordermill.plans.jobs analyse --out DIR [--format parquet|csv]
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordermill.operators.clean import clean_orders, delivered_orders, delivery_summary, winsorise
from ordermill.operators.picks import dedup
from ordermill.operators.quality import dedup_report, null_report, profile_tables
from ordermill.plans import analyses as A
from ordermill.plans.master import build_master
from ordermill.session import materialize
from ordermill.sources.readers import read_marketplace_csv, rejected_marketplace_csv
from ordermill.sources.roles import Tables
from ordermill.sources.sinks import write_table

# analysis outputs written by the analysis job: name -> operator over the master table
ANALYSIS_OUTPUTS = {
    "seller_health_scores": A.seller_health,
    "rfm_segments": A.rfm_segments,
    "monthly_trend": A.monthly_trend,
    "category_revenue": A.category_revenue,
    "state_delivery": A.state_delivery,
    "payment_share": A.payment_share,
    "order_heatmap": A.order_heatmap,
    "weekly_revenue": A.weekly_revenue,
    "revenue_forecast": A.revenue_forecast,
    "executive_kpis": A.executive_kpis,
}


def run_cleaning(tables: Tables, out: str, fmt: str = "parquet", rejected: DataFrame | None = None) -> DataFrame:
    """Write the reports, ``delivered_orders``, ``items_clean`` and ``master``; return the
    written master (read back).

    Orders and items are cleaned once: the reports, the outputs and the master read the stored
    results.  ``rejected`` is a frame of values that could not be read, written as a report."""
    orders = materialize(clean_orders(tables.orders), bucket_by=("order_id",))
    items = materialize(dedup(tables.items, ["order_id", "order_item_id"]), columnar=True)
    write_table(profile_tables(tables), f"{out}/reports/row_counts", fmt)
    write_table(null_report(tables.orders, unparsable=True), f"{out}/reports/date_nulls", fmt)
    write_table(dedup_report(tables.orders, tables.items, orders, items), f"{out}/reports/duplicates", fmt)
    if rejected is not None:
        write_table(rejected, f"{out}/reports/rejected_values", fmt)
    items = winsorise(items, "price")
    delivered = delivered_orders(orders)
    write_table(delivery_summary(delivered), f"{out}/reports/delivery_summary", fmt)
    write_table(delivered, f"{out}/delivered_orders", fmt)
    write_table(items, f"{out}/items_clean", fmt)
    master = build_master(tables, items_clean=items, orders_clean=orders)
    # parquet output is partitioned by purchase month so later readers prune by month
    write_table(master, f"{out}/master", fmt, partition_by=("month",) if fmt == "parquet" else ())
    if fmt == "csv":  # text has no types: they stand beside it
        master.sparkSession.range(1).select(F.lit(master.schema.json()).alias("value")) \
              .write.mode("overwrite").text(f"{out}/master_schema")
    return read_master(master.sparkSession, out, fmt)


def read_master(spark: SparkSession, out: str, fmt: str = "parquet") -> DataFrame:
    if fmt == "parquet":
        return spark.read.parquet(f"{out}/master")
    if fmt == "csv":
        schema = T.StructType.fromJson(json.loads(spark.read.text(f"{out}/master_schema").first()[0]))
        return spark.read.schema(schema).option("header", True).option("escape", '"').option("enforceSchema", False).csv(f"{out}/master")
    raise ValueError(f"unsupported format {fmt!r}")


def run_analyses(master: DataFrame, out: str, fmt: str = "parquet") -> list[str]:
    written = []
    for name, op in ANALYSIS_OUTPUTS.items():
        write_table(op(master), f"{out}/analyses/{name}", fmt)
        written.append(name)
    return written


def main(argv: list[str] | None = None) -> None:
    from ordermill.session import get_session

    ap = argparse.ArgumentParser(prog="ordermill.plans.jobs")
    ap.add_argument("job", choices=["clean", "analyse"])
    ap.add_argument("--raw", help="folder with the raw CSV export (clean job)")
    ap.add_argument("--fixture", help="folder with the TPC-H-style test tables (clean job)")
    ap.add_argument("--out", required=True)
    ap.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    args = ap.parse_args(argv)
    spark = get_session()
    if args.job == "clean":
        if args.fixture:
            from ordermill.sources.fixture import fixture_tables
            run_cleaning(fixture_tables(spark, args.fixture), args.out, args.format)
        else:
            run_cleaning(read_marketplace_csv(spark, args.raw), args.out, args.format,
                         rejected_marketplace_csv(spark, args.raw))
    else:
        run_analyses(read_master(spark, args.out, args.format), args.out, args.format)


if __name__ == "__main__":
    main()
