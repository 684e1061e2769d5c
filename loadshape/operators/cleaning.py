"""Cleaning readings and choosing households."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadshape.operators.ordering import lookup

KEY = ("household_id", "timestamp")


def drop_null_keys(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    return df.dropna(subset=list(keys))


def first_per_key(
    df: DataFrame, keys: Sequence[str] = KEY, order_by: Sequence[str] = ("energy_kwh",)
) -> DataFrame:
    """One row per key: the first by ``order_by`` (NULLs last), then by all other columns.

    Written as a minimum of structs, which is combined before the shuffle: a
    key with very many copies arrives as one row per input task.
    """
    rest = [c for c in df.columns if c not in keys and c not in order_by]
    ranked = [c for c in order_by if c not in keys] + rest
    parts: list[Column] = []
    for c in ranked:
        parts += [F.col(c).isNull().alias(f"_null_{c}"), F.col(c)]
    best = df.groupBy(*keys).agg(F.min(F.struct(*parts)).alias("_row"))
    return best.select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns]
    )


def fill_and_clip(
    df: DataFrame, low: float = 0.0, high: float = 50.0, value: str = "energy_kwh"
) -> DataFrame:
    """NULL becomes 0, then values are clipped to [low, high]; NaN stays NaN."""
    v = F.coalesce(F.col(value), F.lit(0.0))
    clipped = F.least(F.greatest(v, F.lit(float(low))), F.lit(float(high)))
    return df.withColumn(value, F.when(F.isnan(v), v).otherwise(clipped))


def household_history(
    df: DataFrame, household: str = "household_id", ts: str = "timestamp", value: str = "energy_kwh"
) -> DataFrame:
    """First and last reading, number of readings and span in days per household."""
    span = F.timestamp_diff("MICROSECOND", F.col("min_ts"), F.col("max_ts"))
    return (
        df.groupBy(household)
        .agg(F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"), F.count(value).alias("count"))
        .withColumn("duration_days", F.floor(span / 1_000_000) / F.lit(86400.0))
    )


def households_with_history(df: DataFrame, min_days: float, household: str = "household_id", **kw) -> DataFrame:
    """Households whose first-to-last span is at least ``min_days``."""
    return household_history(df, household, **kw).where(F.col("duration_days") >= min_days).select(household)


def keep_households(
    df: DataFrame, ids: DataFrame, household: str = "household_id", ts: str = "timestamp"
) -> DataFrame:
    """Readings of the listed households; the id list has one row per household."""
    return lookup(df, ids.select(household), [household], "left_semi")


def clean_readings(
    df: DataFrame,
    min_history_days: float = 90,
    valid_range: tuple[float, float] = (0.0, 50.0),
    order_by: Sequence[str] = ("energy_kwh",),
    max_missing_ratio: float | None = None,
) -> DataFrame:
    """Drop NULL keys, keep one row per key, fill and clip, keep households with enough history.

    ``max_missing_ratio`` additionally enforces the audit's missing-value limit,
    which cleaning otherwise only reports.
    """
    keyed = first_per_key(drop_null_keys(df), KEY, order_by)
    valid = households_with_history(keyed, min_history_days)
    if max_missing_ratio is not None:
        sparse = (
            keyed.groupBy("household_id")
            .agg((F.count_if(F.col("energy_kwh").isNull()) / F.count("*")).alias("_ratio"))
            .where(F.col("_ratio") > max_missing_ratio)
        )
        valid = valid.join(sparse, "household_id", "left_anti")
    return keep_households(fill_and_clip(keyed, *valid_range), valid)


def seeded_order(id_col: str, seed: int) -> Column:
    """Repeatable pseudo-random order of ids: equal on every engine with md5."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(id_col).cast("string")))


def sample_households(df: DataFrame, n: int = 50, seed: int = 42, household: str = "household_id") -> DataFrame:
    """Ids of ``min(n, all)`` households drawn without replacement."""
    ids = df.select(household).distinct()
    return ids.orderBy(seeded_order(household, seed), household).limit(n)


def sample_readings(df: DataFrame, n: int = 50, seed: int = 42, household: str = "household_id") -> DataFrame:
    """All readings of a seeded household sample of any size; Spark broadcasts the ids where they are measured to be few."""
    return df.join(sample_households(df, n, seed, household), household, "left_semi")
