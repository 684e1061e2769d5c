"""Writers for cleaned readings, cohort series, trajectories and result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_readings(df: DataFrame, path: str, keys: Sequence[str], ts: str, mode: str = "overwrite") -> None:
    """Parquet clustered by time of writing task: range-partitioned and sorted by (keys, ts)."""
    df.repartitionByRange(*keys, ts).sortWithinPartitions(*keys, ts).write.mode(mode).parquet(path)


def write_series(
    df: DataFrame, path: str, partition_by: str = "cohort", ts: str = "ts", mode: str = "overwrite"
) -> None:
    """Parquet folders per cohort; a cohort without rows gets no folder.

    Range partitioning on (cohort, ts) splits a long cohort over several tasks.
    """
    (
        df.repartitionByRange(F.col(partition_by), F.col(ts))
        .sortWithinPartitions(partition_by, ts)
        .write.mode(mode)
        .partitionBy(partition_by)
        .parquet(path)
    )


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_tables(tables: Mapping[str, DataFrame], folder: str, fmt: str = "csv") -> None:
    """One folder per named result table."""
    for name, df in tables.items():
        (write_csv if fmt == "csv" else write_json)(df, f"{folder}/{name}")
