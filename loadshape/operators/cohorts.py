"""Cohort load series and their profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadshape.functions.columns import step_of_day
from loadshape.operators.ordering import exact_quantiles, lookup

# Tariff patterns of the two trial cohorts, case-insensitive.
DYNAMIC_TARIFF = "(?i)tou|dynamic"
STANDARD_TARIFF = "(?i)std|flat"

LOAD_COLUMNS = ("load_kwh", "load_mean_kwh", "load_std_kwh", "active_households")


def tariff_cohorts(tariff: str = "tariff_group") -> dict[str, Column]:
    """Membership condition per cohort label; a NULL tariff is in neither tariff cohort."""
    t = F.col(tariff)
    return {
        "total_population": F.lit(True),
        "dtou": F.coalesce(t.rlike(DYNAMIC_TARIFF), F.lit(False)),
        "standard": F.coalesce(t.rlike(STANDARD_TARIFF), F.lit(False)),
    }


def cohort_aggregates(cohorts: Mapping[str, Column], value: str, active) -> Column:
    """One array entry per cohort, each a set of conditional aggregates."""
    e = F.col(value)
    entries = []
    for name, member in cohorts.items():
        inside = F.when(member, e)
        entries.append(
            F.struct(
                F.lit(name).alias("cohort"),
                F.count_if(member).alias("_rows"),
                F.coalesce(F.sum(inside), F.lit(0.0)).alias("load_kwh"),
                F.avg(inside).alias("load_mean_kwh"),
                F.stddev_samp(inside).alias("load_std_kwh"),
                active(member).alias("active_households"),
            )
        )
    return F.array(*entries)


def cohort_load(
    df: DataFrame,
    cohorts: Mapping[str, Column] | None = None,
    ts: str = "timestamp",
    value: str = "energy_kwh",
    household: str | None = None,
) -> DataFrame:
    """Load per cohort and timestamp: sum, mean, std (ddof 1) and active households.

    All cohorts are conditional aggregates of one ``groupBy(ts)``: one scan, no
    row is copied, and every partial sum is combined before the shuffle.  With
    one reading per (household, ts), as cleaning leaves them, the row count is
    the household count; pass ``household`` to count distinct ids instead.
    """
    if household:
        def active(member):
            return F.count_distinct(F.when(member, F.col(household)))
    else:
        active = F.count_if
    entries = cohort_aggregates(cohorts or tariff_cohorts(), value, active)
    wide = df.groupBy(F.col(ts).alias("ts")).agg(entries.alias("_cohorts"))
    return wide.select("ts", F.inline("_cohorts")).where("_rows > 0").select("cohort", "ts", *LOAD_COLUMNS)


def hourly_profile(df: DataFrame, keys: Sequence[str] = ("cohort",), ts: str = "ts", value: str = "load_kwh") -> DataFrame:
    """Mean load by hour of day."""
    return df.groupBy(*keys, F.hour(ts).alias("hour")).agg(F.avg(value).alias("mean_load"))


def step_profile(
    df: DataFrame,
    keys: Sequence[str] = ("cohort",),
    ts: str = "ts",
    value: str = "load_kwh",
    steps_per_day: int = 48,
) -> DataFrame:
    """Mean, std (ddof 1), p10 and p90 by step of day."""
    group = [*keys, "half_hour_idx"]
    stepped = df.select(*keys, step_of_day(ts, steps_per_day).alias("half_hour_idx"), value)
    moments = {"mean": F.avg("_v"), "std": F.stddev_samp("_v")}
    return exact_quantiles(stepped, group, value, {"p10": 0.1, "p90": 0.9}, also=moments).select(*group, *moments, "p10", "p90")


def density_histogram(
    df: DataFrame, keys: Sequence[str], value: str = "load_kwh", bins: int = 35
) -> DataFrame:
    """Equal-width density histogram of each group between its own minimum and maximum.

    The last bin is closed.  Empty bins are returned with density 0, at most
    ``bins`` rows per group.
    """
    keys = list(keys)
    present = df.where(F.col(value).isNotNull())
    ranges = present.groupBy(*keys).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count("*").alias("_n")
    )
    # a single-valued sample gets a unit-wide range around its value
    flat = F.col("_lo") == F.col("_hi")
    ranges = ranges.select(
        *keys,
        "_n",
        F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"),
    )
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    counts = (
        lookup(present, ranges, keys)
        .groupBy(*keys, at.alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    grid = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    n = F.coalesce(F.col("n"), F.lit(0))
    return grid.join(counts, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        (F.col("_lo") + F.col("bin") * width).alias("bin_start"),
        n.alias("n"),
        (n / (F.col("_n") * width)).alias("density"),
    )
