"""Paired day-block bootstrap on daily sums."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadshape.functions.columns import rounded
from loadshape.operators.metrics import metrics_from_sums

METRICS = ("ace", "interval_score", "mpiw", "empirical_coverage")
MIN_DAYS = 5


def day_draws(day_counts: DataFrame, n_resamples: int, seed: int, n_days: str = "n_days") -> DataFrame:
    """Per distinct number of days and day: the resamples that draw it, and how often.

    Draw k of resample b is the first 32 bits of md5('seed|b|k') modulo the
    number of days, which any engine reproduces.
    """
    sizes = day_counts.select(n_days).distinct()
    resamples = sizes.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_resamples - 1))))
    resamples = resamples.repartition(n_days, "b")  # draw in parallel
    draws = resamples.withColumn("k", F.explode(F.sequence(F.lit(0), (F.col(n_days) - 1).cast("int"))))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("b").cast("string"), F.col("k").cast("string")))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    times = draws.groupBy(n_days, "b", (number % F.col(n_days)).alias("day_idx")).agg(
        F.count("*").alias("times")
    )
    # at most n_resamples entries per day, kept as two plain arrays of 4-byte numbers
    entry = F.struct("b", F.col("times").cast("int").alias("times"))
    packed = times.groupBy(n_days, "day_idx").agg(F.sort_array(F.collect_list(entry)).alias("_e"))
    return packed.select(n_days, "day_idx", F.col("_e.b").alias("_b"), F.col("_e.times").alias("_times"))


def unpack_draws(draws: DataFrame, *columns: str) -> DataFrame:
    """One row per (day, resample that draws it)."""
    return draws.select(*columns, "_times", F.posexplode("_b").alias("_i", "b")).select(
        *columns, "b", F.get("_times", F.col("_i")).alias("times")
    )


#: Resamples, and series, that meet in one task.
RESAMPLE_BLOCK, SERIES_BLOCK = 512, 256


def _draw_lists(sizes: DataFrame, n_resamples: int, seed: int) -> DataFrame:
    """(n_days, b, days): the days that resample ``b`` draws, as ``day_draws`` has them, in one array."""
    resamples = sizes.select("n_days").distinct().withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_resamples - 1))))

    def number(k: Column) -> Column:
        digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("b").cast("string"), k.cast("string")))
        return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % F.col("n_days")).cast("int")

    resamples = resamples.repartition("n_days", "b")  # draw in parallel
    return resamples.withColumn("days", F.transform(F.sequence(F.lit(0), (F.col("n_days") - 1).cast("int")), number))


def resampled_metrics(
    daily: DataFrame,
    keys: Sequence[str],
    method_a: str,
    method_b: str,
    alpha: float = 0.10,
    n_resamples: int = 2000,
    seed: int = 42,
    method: str = "method",
    day: str = "day",
    digits: int | None = 4,
) -> DataFrame:
    """Metrics of both methods per (series, resample), on the same days for both.

    ``daily`` holds ``daily_sums``; raw rows are never read again.  How often a resample draws each day is a row of
    a matrix, the daily sums of a series are another, and the resampled sums are their product: a block of resamples and
    a block of series with the same number of days meet in one task, and only one row per (series, resample) comes
    out.  ``digits`` rounds the metrics before they are differenced (None: full precision).
    """
    keys = list(keys)
    sums = ("n_obs", "n_covered", "sum_width", "sum_score")
    sums_of = [f"{c}_{s}" for s in "ab" for c in sums]

    def side(name: str, suffix: str):
        return [F.sum(F.when(F.col(method) == name, F.col(c))).cast("double").alias(f"{c}_{suffix}") for c in sums]

    days = daily.where(F.col(method).isin(method_a, method_b)).groupBy(*keys, day).agg(
        *side(method_a, "a"), *side(method_b, "b")
    )
    # days of one series: bounded by the calendar, one row of arrays
    packed = days.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(day, *sums_of))).alias("_days"))
    packed = packed.select(*keys, F.size("_days").cast("bigint").alias("n_days"), *[F.col(f"_days.{c}").alias(c) for c in sums_of])
    blocks = packed.groupBy("n_days").agg(F.ceil(F.count(F.lit(1)) / SERIES_BLOCK).cast("int").alias("_blocks"))
    left = packed.join(blocks, "n_days").withColumn("_series", F.pmod(F.xxhash64(*keys), F.col("_blocks")).cast("int"))
    last = (n_resamples - 1) // RESAMPLE_BLOCK
    left = left.withColumn("_resamples", F.explode(F.sequence(F.lit(0), F.lit(last)))).drop("_blocks")
    right = _draw_lists(blocks, n_resamples, seed).join(blocks.withColumnRenamed("n_days", "_n"), F.col("n_days") == F.col("_n"))
    right = right.select(
        F.col("n_days").alias("n_days"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_series"),
        F.floor(F.col("b") / RESAMPLE_BLOCK).cast("int").alias("_resamples"), "b", "days",
    )
    schema = T.StructType(
        [daily.schema[k] for k in keys] + T._parse_datatype_string(f"n_days bigint, b int, {', '.join(f'{c} double' for c in sums_of)}").fields
    )

    def product(series: pd.DataFrame, draws: pd.DataFrame) -> pd.DataFrame:
        if not len(series) or not len(draws):
            return pd.DataFrame({f.name: [] for f in schema})
        draws = draws.sort_values("b")
        drawn = np.stack(draws["days"].to_numpy())
        n, k = drawn.shape
        times = np.bincount((drawn + np.arange(n)[:, None] * k).ravel(), minlength=n * k).reshape(n, k).astype(float)
        out = {key: np.repeat(series[key].to_numpy(), n) for key in keys}
        out |= {"n_days": k, "b": np.tile(draws["b"].to_numpy(), len(series))}
        for c in sums_of:
            held = np.stack(series[c].to_numpy()).astype(float)
            there = ~np.isnan(held)
            total = np.where(there, held, 0.0) @ times.T
            # a sum over days of which none has the method is missing
            out[c] = np.where(there.astype(float) @ times.T > 0, total, np.nan).ravel()
        return pd.DataFrame(out)

    by = ["n_days", "_series", "_resamples"]
    drawn = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(product, schema)
    drawn = drawn.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in sums_of})
    out = []
    for s in "ab":
        m = metrics_from_sums(alpha, digits, *[f"{c}_{s}" for c in sums])
        out += [m[name].alias(f"{name}_{s}") for name in METRICS]
    return drawn.select(*keys, "n_days", "b", *out)


def paired_bootstrap(
    daily: DataFrame,
    keys: Sequence[str],
    method_a: str,
    method_b: str,
    alpha: float = 0.10,
    n_resamples: int = 2000,
    seed: int = 42,
    method: str = "method",
    day: str = "day",
    round_before_diff: bool = True,
    digits: int | None = 4,
    too_short: str = "null",
) -> DataFrame:
    """Mean difference, 95 % interval and two-sided p-value per series and metric.

    A series with fewer than 5 days gets NULL statistics, or an error with
    ``too_short='error'``.
    """
    keys = list(keys)
    samples = resampled_metrics(
        daily, keys, method_a, method_b, alpha, n_resamples, seed, method, day,
        4 if round_before_diff else None,
    )
    if too_short == "error":
        enough = F.assert_true(F.col("n_days") >= MIN_DAYS, "Insufficient daily blocks for block bootstrapping")
        samples = samples.where(enough.isNull())
    long = samples.select(
        *keys, "n_days", "b",
        F.inline(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(f"{m}_a").alias("a"), F.col(f"{m}_b").alias("b_value"))
            for m in METRICS
        ])),
    )
    d = F.col("a") - F.col("b_value")
    diffs = long.withColumn("_d", d)
    # a group holds one difference per resample, n_resamples in all
    ci = F.percentile("_d", F.array(F.lit(0.025), F.lit(0.975)))
    stats = diffs.groupBy(*keys, "n_days", "metric").agg(
        F.avg("a").alias("mean_a"),
        F.avg("b_value").alias("mean_b"),
        F.avg("_d").alias("mean_diff"),
        ci.alias("_ci"),
        F.least(
            F.lit(1.0),
            2.0 * F.least(F.avg((F.col("_d") <= 0).cast("double")), F.avg((F.col("_d") >= 0).cast("double"))),
        ).alias("p_value"),
        F.count("*").alias("n_resamples"),
    )
    lo, hi = F.get("_ci", F.lit(0)), F.get("_ci", F.lit(1))
    enough = F.col("n_days") >= MIN_DAYS
    values = {
        "mean_a": F.col("mean_a"), "mean_b": F.col("mean_b"), "mean_diff": F.col("mean_diff"),
        "ci_lower": lo, "ci_upper": hi, "p_value": F.col("p_value"),
    }
    return stats.select(
        *keys, "metric",
        *[F.when(enough, rounded(c, digits)).alias(n) for n, c in values.items()],
        F.when(enough, (lo > 0) | (hi < 0)).alias("is_significant_05"),
        "n_resamples",
        "n_days",
    )


def formatted_bootstrap(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Result table with the interval as text and the verdict as Yes/No."""
    return results.select(
        *keys, "metric", "mean_a", "mean_b", "mean_diff",
        F.format_string("[%.4f, %.4f]", "ci_lower", "ci_upper").alias("ci_95"),
        "p_value",
        F.when(F.col("is_significant_05"), "Yes").otherwise("No").alias("significant"),
    )
