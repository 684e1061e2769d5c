"""Data-quality audit of readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadshape.operators.ordering import exact_quantiles


def totals(df: DataFrame, valid_range: tuple[float, float] = (0.0, 50.0)) -> DataFrame:
    """One row: records, date range, households, NULLs and range violations."""
    low, high = valid_range
    e = F.col("energy_kwh")
    return df.agg(
        F.count("*").alias("total_records"),
        F.min("timestamp").alias("start_ts"),
        F.max("timestamp").alias("end_ts"),
        # a NULL id counts as one more household, as in a distinct over rows
        (
            F.count_distinct("household_id")
            + F.max(F.col("household_id").isNull().cast("int"))
        ).cast("long").alias("customer_count"),
        F.count_if(e.isNull()).alias("null_energy_count"),
        F.count_if(F.col("timestamp").isNull()).alias("null_timestamp_count"),
        F.count_if(e < low).alias("negative_count"),
        F.count_if(e > high).alias("extreme_count"),
    )


def tariff_counts(df: DataFrame) -> DataFrame:
    """Records per tariff group; NULL is a group."""
    return df.groupBy("tariff_group").agg(F.count("*").alias("records"))


def duplicate_count(df: DataFrame, keys=("household_id", "timestamp")) -> DataFrame:
    """Records minus distinct keys, NULL keys comparing equal."""
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("_n"))
        .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_records"))
    )


def household_quality(df: DataFrame) -> DataFrame:
    """Per household: observations, span in days, NULL readings and their ratio."""
    span = F.timestamp_diff("MICROSECOND", F.col("min_ts"), F.col("max_ts"))
    return (
        df.where(F.col("household_id").isNotNull())
        .groupBy("household_id")
        .agg(
            F.count("timestamp").alias("obs_count"),
            F.min("timestamp").alias("min_ts"),
            F.max("timestamp").alias("max_ts"),
            F.count_if(F.col("energy_kwh").isNull()).alias("null_count"),
        )
        .withColumn("duration_days", span / F.lit(86_400_000_000.0))
        .withColumn("missing_ratio", F.try_divide("null_count", "obs_count"))
    )


def _excluded(min_history_days: float, max_missing_ratio: float) -> tuple[Column, Column]:
    short = F.coalesce(F.col("duration_days") < min_history_days, F.lit(False))
    # NULL readings without any timestamped reading: an unbounded ratio
    sparse = F.coalesce(
        F.col("missing_ratio") > max_missing_ratio,
        (F.col("obs_count") == 0) & (F.col("null_count") > 0),
    )
    return short, sparse


def exclusion_summary(df: DataFrame, min_history_days: float = 90, max_missing_ratio: float = 0.10) -> DataFrame:
    """How many households each inclusion rule excludes, and how many remain."""
    short, sparse = _excluded(min_history_days, max_missing_ratio)
    return household_quality(df).agg(
        F.count_if(short).alias("insufficient_history"),
        F.count_if(sparse).alias("high_missingness"),
        F.count_if(short | sparse).alias("total_excluded"),
        F.count_if(~(short | sparse)).alias("total_retained"),
    )


def retained_households(df: DataFrame, min_history_days: float = 90, max_missing_ratio: float = 0.10) -> DataFrame:
    """All households less the excluded ones."""
    short, sparse = _excluded(min_history_days, max_missing_ratio)
    return household_quality(df).where(~(short | sparse)).select("household_id")


def consumption_summary(df: DataFrame, value: str = "energy_kwh") -> DataFrame:
    """One row: mean, std (ddof 1), min, p25, median, p75, p99, max of the non-NULL readings."""
    keyed = df.select(F.lit(0).alias("_all"), F.col(value))
    levels = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p99": 0.99}
    moments = {"mean": F.avg("_v"), "std": F.stddev_samp("_v"), "min": F.min("_v"), "max": F.max("_v")}
    return exact_quantiles(keyed, ["_all"], value, levels, also=moments).select("mean", "std", "min", *levels, "max")
