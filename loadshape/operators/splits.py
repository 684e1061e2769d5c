"""Chronological splits and positional slices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadshape.operators.ordering import lookup

SPLITS = ("train", "calibration", "validation", "test")
Ranges = Mapping[str, tuple[str, str]]


def check_ranges(ranges: Ranges) -> list[tuple[str, date, date]]:
    """The four splits as (name, first day, last day); raises unless ordered and disjoint."""
    missing = [s for s in SPLITS if s not in ranges]
    if missing:
        raise ValueError(f"no dates for splits {missing}")
    parsed = [(s, *[date.fromisoformat(str(d)) for d in ranges[s]]) for s in SPLITS]
    previous = None
    for name, start, end in parsed:
        if start > end or (previous is not None and start <= previous):
            raise ValueError(f"Invalid split boundaries: chronological order violated at '{name}' in {parsed}")
        previous = end
    return parsed


def tag_splits(df: DataFrame, ranges: Ranges, ts: str = "ts") -> DataFrame:
    """Add ``split``; the last day of each range counts in full, rows outside all ranges go."""
    label = None
    parsed = check_ranges(ranges)
    t = F.col(ts)
    for name, start, end in parsed:
        inside = (t >= F.lit(str(start)).cast("timestamp_ntz")) & (
            t < F.lit(str(end + timedelta(days=1))).cast("timestamp_ntz")
        )
        label = F.when(inside, name) if label is None else label.when(inside, name)
    # the outer bounds are plain comparisons, so they reach the file scan
    outer = (t >= F.lit(str(parsed[0][1])).cast("timestamp_ntz")) & (
        t < F.lit(str(parsed[-1][2] + timedelta(days=1))).cast("timestamp_ntz")
    )
    return df.where(outer).withColumn("split", label).where(F.col("split").isNotNull())


def split_summary(df: DataFrame, spark: SparkSession | None = None, ts: str = "ts") -> DataFrame:
    """Rows and first/last time of each of the four splits, 0 for an empty one."""
    names = df.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    found = df.groupBy("split").agg(
        F.count("*").alias("n_rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")
    )
    return names.join(found, "split", "left").select(
        "split",
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        "first_ts",
        "last_ts",
        F.col("n_rows").isNull().alias("is_empty"),
    )


def relative_position(df: DataFrame, keys: Sequence[str], seq: str = "seq", out: str = "pos") -> DataFrame:
    """Position within the group, for rows whose ``seq`` runs without gaps in the group."""
    first = df.groupBy(*keys).agg(F.min(seq).alias("_first"))
    return (
        lookup(df, first, keys)
        .withColumn(out, F.col(seq) - F.col("_first"))
        .drop("_first")
    )


def series_slice(
    df: DataFrame,
    keys: Sequence[str],
    seq: str = "seq",
    rows: tuple[int, int] | None = None,
    part: tuple[int, int] | None = None,
) -> DataFrame:
    """Rows [lo, hi) of each series, or the ``part`` = (i, k): the i-th of k parts.

    Parts follow integer division as in ``y[: n // 3]`` and ``y[2 * n // 3 :]``.
    """
    stats = df.groupBy(*keys).agg(F.min(seq).alias("_first"), F.count("*").alias("_n"))
    placed = lookup(df, stats, keys).withColumn("_pos", F.col(seq) - F.col("_first"))
    if rows is not None:
        keep = (F.col("_pos") >= rows[0]) & (F.col("_pos") < rows[1])
    else:
        i, k = part
        keep = (F.col("_pos") >= F.floor(F.col("_n") * i / k)) & (
            F.col("_pos") < F.floor(F.col("_n") * (i + 1) / k)
        )
    return placed.where(keep).drop("_first", "_n", "_pos")


def day_blocks(df: DataFrame, pos: str = "pos", block: int = 48) -> DataFrame:
    """Positional block number, ``pos // block``."""
    return df.withColumn("block", F.floor(F.col(pos) / block).cast("long"))
