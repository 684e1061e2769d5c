"""Conditional reliability: interval metrics by operational subgroup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadshape.functions.columns import covers, day_type, peak_status, season, tertile
from loadshape.operators.metrics import interval_sums, metrics_from_sums
from loadshape.operators.ordering import (
    CHUNK,
    chunk_window,
    chunked,
    exact_quantiles,
    lookup,
    unchunk,
)
from loadshape.session import cut_lineage

# Tertile levels of the load and ramp regimes.
TERTILES = {"_t1": 0.333, "_t2": 0.667}


def add_ramps(
    df: DataFrame, keys: Sequence[str], y: str = "y", seq: str = "seq", out: str = "ramp", chunk: int = CHUNK
) -> DataFrame:
    """Absolute change from the previous row of the series, 0 for the first."""
    w = chunk_window(keys, seq)
    parts = chunked(df, 1, seq, chunk)
    return unchunk(parts.withColumn(out, F.abs(F.col(y) - F.lag(y, 1).over(w)))).withColumn(
        out, F.coalesce(F.col(out), F.lit(0.0))
    )


def add_regime(
    df: DataFrame, keys: Sequence[str], value: str, out: str, labels: tuple[str, str, str],
) -> DataFrame:
    """Tertile label of ``value`` within its series.

    The tertiles, a row per series, are found and written when this is called, so that their size is known to the join.
    """
    cuts = cut_lineage(exact_quantiles(df, keys, value, TERTILES), "tertiles")
    return lookup(df, cuts, keys).withColumn(out, tertile(value, "_t1", "_t2", labels)).drop("_t1", "_t2")


def reliability_keys(
    df: DataFrame, keys: Sequence[str], y: str = "y", ts: str = "ts", seq: str = "seq", chunk: int = CHUNK,
) -> tuple[DataFrame, dict[str, Column]]:
    """Rows with every subgroup label, and the dimensions available for them."""
    ramped = add_ramps(df, keys, y, seq, "ramp", chunk)
    # both variables in one sketch and one pass over the brackets
    both = F.inline(F.array(*[
        F.struct(F.lit(n).alias("_of"), F.col(c).cast("double").alias("_value")) for n, c in (("_l", y), ("_t", "ramp"))
    ]))
    levels = exact_quantiles(ramped.select(*keys, both), [*keys, "_of"], "_value", TERTILES)
    cuts = levels.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_of") == n, F.col(f"_t{i}"))).alias(f"{n}{i}") for n in ("_l", "_t") for i in (1, 2)
    ])
    labelled = lookup(ramped, cut_lineage(cuts, "tertiles"), keys)
    hour = F.hour(ts)
    # Names of the dimensions and subgroups
    dims: dict[str, Column] = {
        "by_hour": hour.cast("string"),
        "by_peak_status": peak_status(hour),
        "by_day_type": day_type(ts),
        "by_season": season(F.month(ts)),
        "by_load_regime": tertile(y, "_l1", "_l2", ("Low Demand", "Medium Demand", "High Demand")),
        "by_ramp_regime": tertile("ramp", "_t1", "_t2", ("Low Ramp", "Medium Ramp", "High Ramp")),
    }
    if "horizon" in df.columns:
        dims["by_horizon"] = F.col("horizon").cast("string")
    if "shift_flag" in df.columns:
        dims["by_shift_status"] = F.when(F.col("shift_flag"), "Shift Detected").otherwise("Normal / Low Shift")
    return labelled, dims


def conditional_reliability(
    df: DataFrame,
    keys: Sequence[str],
    alpha: float = 0.10,
    y: str = "y",
    lower: str = "lower",
    upper: str = "upper",
    ts: str = "ts",
    seq: str = "seq",
    digits: int | None = 4,
    chunk: int = CHUNK,
) -> DataFrame:
    """Interval metrics per (series, dimension, subgroup), all dimensions in one pass.

    Rows are fanned out to their subgroups right before the partial sums, so
    the shuffle carries one row per subgroup and task.
    """
    labelled, dims = reliability_keys(df, keys, y, ts, seq, chunk)
    fanned = labelled.select(
        *keys, y, lower, upper,
        F.inline(F.array(*[F.struct(F.lit(n).alias("dimension"), c.alias("subgroup")) for n, c in dims.items()])),
    ).where(F.col("subgroup").isNotNull())
    sums = interval_sums(fanned, [*keys, "dimension", "subgroup"], alpha, y, lower, upper)
    metrics = metrics_from_sums(alpha, digits)
    return sums.select(*keys, "dimension", "subgroup", "n_obs", *[c.alias(n) for n, c in metrics.items()])


def hourly_coverage(
    intervals: DataFrame, keys: Sequence[str], methods: Sequence[str], method: str = "method",
    ts: str = "ts", y: str = "y",
) -> DataFrame:
    """Coverage in percent by hour of day, one column per method."""
    inside = covers(y, "lower", "upper").cast("double")
    return intervals.where(F.col(method).isin(list(methods))).groupBy(*keys, F.hour(ts).alias("hour")).agg(
        *[(F.avg(F.when(F.col(method) == m, inside)) * 100).alias(f"{m}_pct") for m in methods]
    )


def shift_against_residual(intervals: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Shift score next to the absolute residual of every step."""
    return intervals.select(*keys, ts, "shift_score", F.abs(F.col("y") - F.col("y_pred")).alias("abs_residual"))
