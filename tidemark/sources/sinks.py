"""Result writers. The writer makes missing folders; executors write in parallel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_per_series(df: DataFrame, path: str, series: str) -> None:
    """One CSV folder per series."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').partitionBy(series).csv(path)
