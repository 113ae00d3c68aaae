"""Writers for cleaned tables and analysis results."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame

from ordermill.sources.roles import Tables


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = ()) -> None:
    """Write ``df`` as parquet (default) or CSV with a header row."""
    if partition_by:
        # AQE rebalances the write: a hot partition value is split over several tasks and
        # small ones are merged, instead of one task (and file) per value and input split
        df = df.hint("rebalance", *partition_by)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")


def write_tables(tables: Tables, base: str, fmt: str = "parquet") -> None:
    for role, df in tables.frames().items():
        write_table(df, f"{base}/{role}", fmt)
