"""Readers for the raw marketplace tables (CSV with header, or parquet)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordermill.sources.roles import CSV_SCHEMAS, DATE_TYPES, Tables

# File names of the public marketplace CSV export, per role.
CSV_FILES = {
    "orders": "olist_orders_dataset.csv",
    "items": "olist_order_items_dataset.csv",
    "payments": "olist_order_payments_dataset.csv",
    "reviews": "olist_order_reviews_dataset.csv",
    "customers": "olist_customers_dataset.csv",
    "sellers": "olist_sellers_dataset.csv",
    "products": "olist_products_dataset.csv",
    "translation": "product_category_name_translation.csv",
}


def read_csv_table(spark: SparkSession, path: str, role: str) -> DataFrame:
    """One raw CSV table: the role's columns by header name and type (no inference; absent
    ones and values that don't parse are null), then any further columns as text.
    Only reviews, whose comments hold line breaks, are read unsplit."""
    raw = _raw_csv(spark, path, role)
    fields = {f.name: f for f in CSV_SCHEMAS[role].fields}
    known = [F.col(f"`{n}`").try_cast(f.dataType).alias(n) if n in raw.columns else F.lit(None).cast(f.dataType).alias(n)
             for n, f in fields.items()]
    return raw.select(*known, *[F.col(f"`{c}`") for c in raw.columns if c not in fields])


def _raw_csv(spark: SparkSession, path: str, role: str, corrupt: str | None = None) -> DataFrame:
    """All columns as text; ``corrupt`` names a column for the whole text of records that have
    too few or too many fields (their other columns hold what could be read)."""
    reader = (spark.read.option("header", True).option("multiLine", role == "reviews").option("escape", '"')
              .option("mode", "PERMISSIVE"))
    if corrupt is None:
        return reader.csv(path)
    columns = reader.csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, corrupt]])
    # records are judged by their number of fields, so all fields are parsed
    return reader.schema(schema).option("columnNameOfCorruptRecord", corrupt).option("columnPruning", False).csv(path)


def unparsable_values(spark: SparkSession, path: str, role: str) -> DataFrame:
    """One row: per column of the role, how many values are present but don't parse."""
    raw = _raw_csv(spark, path, role)
    bad = [F.count_if(F.col(f"`{f.name}`").isNotNull() & F.col(f"`{f.name}`").try_cast(f.dataType).isNull()).alias(f.name)
           for f in CSV_SCHEMAS[role].fields if f.name in raw.columns]
    return raw.agg(*bad)


RECORD = "(record)"  # stands for the column where a whole record is out of shape


def rejected_csv(spark: SparkSession, path: str, role: str) -> DataFrame:
    """role, column, value, rows: what reading and cleaning the file turn into null.

    Dates are checked as dates, other columns by their type; a record with too few or too many fields is listed
    whole, under ``RECORD`` (it stays in the table with the fields that could be read)."""
    corrupt = "_om_corrupt"
    raw = _raw_csv(spark, path, role, corrupt)
    kinds = {f.name: DATE_TYPES.get(f.name, f.dataType) for f in CSV_SCHEMAS[role].fields}
    kinds = {c: t for c, t in kinds.items() if c in raw.columns and not isinstance(t, T.StringType)}
    bad = [F.when(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(t).isNull(),
                  F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value"))) for c, t in kinds.items()]
    bad.append(F.when(F.col(corrupt).isNotNull(), F.struct(F.lit(RECORD).alias("column"), F.col(corrupt).alias("value"))))
    return (raw.select(F.explode(F.array_compact(F.array(*bad))).alias("cell"))
            .groupBy(F.lit(role).alias("role"), "cell.column", "cell.value").agg(F.count(F.lit(1)).alias("rows")))


def rejected_marketplace_csv(spark: SparkSession, raw_dir: str, files: dict[str, str] | None = None) -> DataFrame:
    """:func:`rejected_csv` of all eight files."""
    names = {**CSV_FILES, **(files or {})}
    return reduce(DataFrame.unionByName, [rejected_csv(spark, f"{raw_dir}/{name}", role) for role, name in names.items()])


def read_marketplace_csv(spark: SparkSession, raw_dir: str, files: dict[str, str] | None = None) -> Tables:
    """The eight role tables from a directory of the CSV export (``files`` overrides the
    file name of any role)."""
    names = {**CSV_FILES, **(files or {})}
    frames = {role: read_csv_table(spark, f"{raw_dir}/{name}", role) for role, name in names.items()}
    return Tables(**frames, review_order=("review_creation_date", "review_answer_timestamp", "review_id"))


def read_parquet_tables(spark: SparkSession, base: str,
                        review_order: tuple[str, ...] = ("review_creation_date",)) -> Tables:
    """The eight role tables from ``<base>/<role>`` parquet folders (as written by
    :func:`ordermill.sources.sinks.write_tables`)."""
    frames = {role: spark.read.parquet(f"{base}/{role}") for role in CSV_FILES}
    return Tables(**frames, review_order=review_order)
