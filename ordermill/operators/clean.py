"""Cleaning steps: date parsing, duplicates, price winsorising, delivered features."""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordermill.functions.time import floor_days, is_late, month_label, weekday_name
from ordermill.operators.picks import dedup
from ordermill.operators.ranking import quantile_places
from ordermill.operators.selection import select_ranks
from ordermill.session import materialize
from ordermill.sources.roles import DATE_COLUMNS, MONEY


def parse_timestamps(df: DataFrame, columns: Sequence[str] = DATE_COLUMNS) -> DataFrame:
    """Text dates -> TIMESTAMP_NTZ, unparsable text -> null (never an error).
    Columns that are already timestamps are only normalised to NTZ; absent columns are
    skipped."""
    out = df
    for c in columns:
        if c not in df.columns:
            continue
        dtype = df.schema[c].dataType
        if isinstance(dtype, T.StringType):
            out = out.withColumn(c, F.col(c).try_cast("timestamp_ntz"))  # no session zone
        elif not isinstance(dtype, T.TimestampNTZType):
            out = out.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return out


def clean_orders(orders: DataFrame, order_by: Sequence[str] = ()) -> DataFrame:
    """Parsed dates, one row per order_id."""
    return dedup(parse_timestamps(orders), ["order_id"], order_by)


def exact_bounds(df: DataFrame, col: str, lo: float = 0.01, hi: float = 0.99) -> list[Decimal | None]:
    """The ``lo``/``hi`` quantiles of a money column (linear interpolation), rounded half-up to
    cents; found by counting passes over ``df`` (no sort, no range shuffle)."""
    wanted = lambda n: [at for q in quantile_places([lo, hi], n) for at in q[:2]]
    ((n, places),) = select_ranks(df.where(F.col(col).isNotNull()), [[(col, True)]], [wanted])[()]
    if not n:
        return [None, None]
    out = []
    for k, (_, _, rem, den) in enumerate(quantile_places([lo, hi], n)):
        low, high = (Fraction(places[2 * k + i][0]) * 100 for i in (0, 1))
        cents = low + (high - low) * rem / den
        whole = (2 * abs(cents) + 1) // 2
        out.append(Decimal(int(whole if cents >= 0 else -whole)).scaleb(-2))
    return out


def quantile_bounds(df: DataFrame, col: str, lo: float = 0.01, hi: float = 0.99,
                    approx: bool = False) -> DataFrame:
    """One row (p_lo, p_hi): linear-interpolation quantiles of a money column, rounded
    half-up to cents.  Exact by default (:func:`exact_bounds`); ``approx=True`` uses
    ``percentile_approx`` (one pass, bounded memory, not interpolated)."""
    if approx:
        pa = F.percentile_approx(F.col(col), [lo, hi], 10000)
        return df.agg(pa[0].cast(MONEY).alias("p_lo"), pa[1].cast(MONEY).alias("p_hi"))
    return df.sparkSession.range(1).select(
        *[F.lit(b).cast(MONEY).alias(c) for b, c in zip(exact_bounds(df, col, lo, hi), ("p_lo", "p_hi"))])


def clip(col: Column, lo: Column, hi: Column) -> Column:
    """``min(max(col, lo), hi)`` where a null input stays null (greatest/least skip nulls)."""
    return F.when(col.isNull(), F.lit(None)).otherwise(F.least(F.greatest(col, lo), hi))


def winsorise(df: DataFrame, col: str, lo: float = 0.01, hi: float = 0.99, approx: bool = False) -> DataFrame:
    """Clip ``col`` to its ``lo``/``hi`` quantiles (bounds rounded to cents): a projection over
    ``df`` with the exact bounds as literals, or with the approximate ones as a scalar subquery."""
    dtype = df.schema[col].dataType
    if approx:
        scalar = quantile_bounds(df, col, lo, hi, approx).select(F.struct("p_lo", "p_hi")).scalar()
        b = F.col("_om_bounds")
        return (df.withColumn("_om_bounds", scalar)
                .withColumn(col, clip(F.col(col), b["p_lo"], b["p_hi"]).cast(dtype)).drop("_om_bounds"))
    low, high = (F.lit(b).cast(MONEY) for b in exact_bounds(df, col, lo, hi))
    return df.withColumn(col, clip(F.col(col), low, high).cast(dtype))


def clean_items(items: DataFrame, lo: float = 0.01, hi: float = 0.99, order_by: Sequence[str] = (),
                approx: bool = False, store: bool = True) -> DataFrame:
    """One row per (order_id, order_item_id), price winsorised to [p_lo, p_hi].

    The de-duplication is a full shuffle of the largest table, and the search for the quantile
    bounds and the clipping read it, so by default it is written once as parquet (of which the search
    reads one column); the clipping is a projection over it."""
    d = dedup(items, ["order_id", "order_item_id"], order_by)
    return winsorise(materialize(d, columnar=True) if store else d, "price", lo, hi, approx)


def delivered_orders(orders: DataFrame, status: str = "delivered") -> DataFrame:
    """Delivered orders with delivery_days, is_late, month, year, weekday, hour."""
    p = F.col("order_purchase_timestamp")
    return (orders.where(F.col("order_status") == status)
            .withColumn("delivery_days", floor_days("order_purchase_timestamp", "order_delivered_customer_date"))
            .withColumn("is_late", is_late("order_delivered_customer_date", "order_estimated_delivery_date"))
            .withColumn("month", month_label(p))
            .withColumn("year", F.year(p))
            .withColumn("weekday", weekday_name(p))
            .withColumn("hour", F.hour(p)))


def delivery_summary(delivered: DataFrame) -> DataFrame:
    """delivered, late_count, late_pct, mean_delivery_days (one row)."""
    g = delivered.agg(F.count(F.lit(1)).alias("delivered"),
                      F.count_if(F.col("is_late")).alias("late_count"),
                      F.sum("delivery_days").alias("_d"), F.count("delivery_days").alias("_dn"))
    return g.select("delivered", "late_count",
                    (F.col("late_count") / F.col("delivered") * 100).alias("late_pct"),
                    (F.col("_d").cast("double") / F.col("_dn")).alias("mean_delivery_days"))
