"""Data-quality reports: row counts, null counts after parsing, duplicates removed."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordermill.operators.clean import parse_timestamps
from ordermill.operators.picks import dedup
from ordermill.sources.roles import DATE_COLUMNS, Tables


def profile_tables(tables: Tables) -> DataFrame:
    """table, row_count for every role table (one aggregate per table, unioned)."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table"), "row_count")
             for name, df in tables.frames().items()]
    return reduce(DataFrame.unionByName, parts)


def null_report(orders: DataFrame, columns: Sequence[str] = DATE_COLUMNS, unparsable: bool = False) -> DataFrame:
    """column, null_count of each date column after parsing (bad text counts as null); with
    ``unparsable`` also unparsable_count, the values that were there and are no date."""
    present = [c for c in columns if c in orders.columns]
    parsed = parse_timestamps(orders.select(*[F.col(c) for c in present],
                                            *[F.col(c).isNotNull().alias(f"_om_has_{c}") for c in present]), present)
    wide = parsed.agg(*[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in present],
                      *[F.count_if(F.col(c).isNull() & F.col(f"_om_has_{c}")).alias(f"u_{c}") for c in present])
    cells = ", ".join(f"'{c}', `n_{c}`, `u_{c}`" for c in present)
    out = wide.selectExpr(f"stack({len(present)}, {cells}) as (column, null_count, unparsable_count)")
    return out if unparsable else out.drop("unparsable_count")


def rejected_values(raw: DataFrame, types: Mapping[str, T.DataType]) -> DataFrame:
    """column, value, rows: the texts that are no value of their column's type, which the cleaning
    turns into null, with the number of rows that hold them.  Nothing is thrown away unseen; equal
    texts are summed before the shuffle, so a garbage value in a third of all rows is one row."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"))
             for c in types if c in raw.columns]
    bad = [F.when(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(t).isNull(), cell)
           for (c, t), cell in zip([(c, t) for c, t in types.items() if c in raw.columns], cells)]
    if not bad:
        return raw.sparkSession.createDataFrame([], "column string, value string, rows bigint")
    return (raw.select(F.explode(F.array_compact(F.array(*bad))).alias("cell")).groupBy("cell.column", "cell.value")
            .agg(F.count(F.lit(1)).alias("rows")).orderBy("column", F.desc("rows"), "value"))


def dedup_report(orders: DataFrame, items: DataFrame, orders_dedup: DataFrame | None = None,
                 items_dedup: DataFrame | None = None) -> DataFrame:
    """table, rows_before, rows_after, removed for the orders and items de-duplication
    (already de-duplicated frames can be passed in)."""
    done = {"orders": orders_dedup, "order_items": items_dedup}

    def one(name: str, df: DataFrame, keys: list[str]) -> DataFrame:
        after_df = done[name] if done[name] is not None else dedup(df, keys)
        after = after_df.agg(F.count(F.lit(1))).scalar()
        return (df.agg(F.count(F.lit(1)).alias("rows_before")).withColumn("rows_after", after)
                .select(F.lit(name).alias("table"), "rows_before", "rows_after",
                        (F.col("rows_before") - F.col("rows_after")).alias("removed")))
    return one("orders", orders, ["order_id"]).unionByName(one("order_items", items, ["order_id", "order_item_id"]))
