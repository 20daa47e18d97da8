"""Writers: plain tables, append-only index, write-once run folders."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def append_rows(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    write_table(df, path, mode="append", partition_by=partition_by)


def write_once(df: DataFrame, path: str) -> None:
    """Refuses to touch a run that already exists."""
    df.write.mode("errorifexists").parquet(path)
