"""Named SQL views over the role tables, so SQL written against the raw marketplace
tables runs on Spark SQL (``spark.sql``) unchanged apart from dialect details:

* ``DATE_FORMAT(ts, '%Y-%m')`` is ``date_format(ts, 'yyyy-MM')`` in Spark;
* ``DAYNAME(ts)`` (full name) is ``date_format(ts, 'EEEE')`` (Spark's ``dayname`` gives 'Mon');
* ``ROUND`` of a DECIMAL average can round twice (the average keeps 6 decimals first);
  the DataFrame operators in ``ordermill.plans.sql_suite`` round exactly.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ordermill.sources.roles import Tables

# The table names the SQL queries use, per role.
VIEW_NAMES = {
    "orders": "orders",
    "items": "order_items",
    "payments": "order_payments",
    "reviews": "order_reviews",
    "customers": "customers",
    "sellers": "sellers",
    "products": "products",
    "translation": "product_category_name_translation",
}


def register_views(spark: SparkSession, tables: Tables, prefix: str = "") -> list[str]:
    """Register every role table as a temporary view; returns the view names."""
    names = []
    for role, df in tables.frames().items():
        name = prefix + VIEW_NAMES[role]
        df.createOrReplaceTempView(name)
        names.append(name)
    return names
