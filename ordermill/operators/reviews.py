"""Per-order review aggregates used to reproduce join fan-out without exploding rows.

``x JOIN reviews ON order_id`` repeats every row of ``x`` once per review of its order.
Aggregates over such a join only need, per order, the number of review rows and the
sums of the review columns, so the reviews are reduced to one row per order first (a
partial aggregation, robust to an order with a huge number of reviews) and joined 1:1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def review_weights(reviews: DataFrame) -> DataFrame:
    """order_id, rv_rows (rows), rv_n (non-null scores), rv_sum, rv_five, rv_low."""
    s = F.col("review_score")
    return reviews.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("rv_rows"),
        F.count(s).alias("rv_n"),
        F.sum(s).cast("bigint").alias("rv_sum"),
        F.count_if(s == 5).alias("rv_five"),
        F.count_if(s <= 2).alias("rv_low"),
    )


def latest_review_weights(latest: DataFrame) -> DataFrame:
    """Same columns from a one-review-per-order frame (``review_policy="latest"``)."""
    s = F.col("review_score")
    return latest.select(
        "order_id", F.lit(1).cast("bigint").alias("rv_rows"),
        F.when(s.isNotNull(), 1).otherwise(0).cast("bigint").alias("rv_n"),
        s.cast("bigint").alias("rv_sum"),
        F.when(s == 5, 1).otherwise(0).cast("bigint").alias("rv_five"),
        F.when(s <= 2, 1).otherwise(0).cast("bigint").alias("rv_low"))


def fan_out_weight() -> "F.Column":
    """Rows a left join to the reviews would produce for one row (at least one)."""
    return F.coalesce(F.col("rv_rows"), F.lit(1)).cast("bigint")
