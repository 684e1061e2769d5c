"""Point and interval metrics as sums, so that any coarser table is a re-aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadshape.functions.columns import covers, pinball, rounded, winkler


def point_metrics(
    df: DataFrame, keys: Sequence[str], y: str = "y", pred: str = "y_pred", digits: int | None = 4
) -> DataFrame:
    """MAE, RMSE, NMAE and sMAPE (%) per group."""
    e = F.col(y) - F.col(pred)
    mid = (F.abs(F.col(y)) + F.abs(F.col(pred))) / 2.0 + 1e-6
    mae = F.avg(F.abs(e))
    metrics = {
        "mae": mae,
        "rmse": F.sqrt(F.avg(e * e)),
        "nmae": mae / F.greatest(F.avg(y), F.lit(1e-6)),
        "smape": F.avg(F.abs(e) / mid) * 100.0,
    }
    return df.groupBy(*keys).agg(*[rounded(c, digits).alias(n) for n, c in metrics.items()])


def interval_sums(
    df: DataFrame,
    keys: Sequence[str | Column],
    alpha: float | Column = 0.10,
    y: str = "y",
    lower: str = "lower",
    upper: str = "upper",
) -> DataFrame:
    """Sufficient statistics: rows, covered rows, summed width and summed interval score; over rows with an outcome."""
    known = F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double"))
    return df.where(known).groupBy(*keys).agg(
        F.count("*").alias("n_obs"),
        F.count_if(covers(y, lower, upper)).alias("n_covered"),
        F.sum(F.col(upper) - F.col(lower)).alias("sum_width"),
        F.sum(winkler(y, lower, upper, alpha)).alias("sum_score"),
    )


def metrics_from_sums(
    alpha: float | Column = 0.10, digits: int | None = 4, n="n_obs", covered="n_covered",
    width="sum_width", score="sum_score",
) -> dict[str, Column]:
    """Coverage, target, absolute coverage error, mean width and mean interval score."""
    a = F.lit(float(alpha)) if isinstance(alpha, (int, float)) else alpha
    target = F.lit(1.0) - a
    coverage = F.col(covered) / F.col(n)
    raw = {
        "empirical_coverage": coverage,
        "target_coverage": target,
        "ace": F.abs(coverage - target),
        "mpiw": F.col(width) / F.col(n),
        "interval_score": F.col(score) / F.col(n),
    }
    return {name: rounded(c, digits) for name, c in raw.items()}


def interval_metrics(
    df: DataFrame,
    keys: Sequence[str],
    alpha: float | Column = 0.10,
    y: str = "y",
    lower: str = "lower",
    upper: str = "upper",
    digits: int | None = 4,
) -> DataFrame:
    """Interval metrics per group; pass an ``alpha`` column only if it is one of ``keys``."""
    sums = interval_sums(df, keys, alpha, y, lower, upper)
    metrics = metrics_from_sums(alpha, digits)
    return sums.select(*keys, "n_obs", *[c.alias(n) for n, c in metrics.items()])


def pinball_loss(df: DataFrame, keys: Sequence[str], y: str, quantiles: Mapping[float, str]) -> DataFrame:
    """Mean pinball loss per group and quantile level (level -> forecast column)."""
    losses = [
        F.struct(F.lit(float(tau)).alias("tau"), F.avg(pinball(y, col, tau)).alias("pinball"))
        for tau, col in quantiles.items()
    ]
    return df.groupBy(*keys).agg(F.array(*losses).alias("_l")).select(*keys, F.inline("_l"))


def daily_sums(
    intervals: DataFrame,
    keys: Sequence[str],
    alpha: float | Column = 0.10,
    ts: str = "ts",
    y: str = "y",
    lower: str = "lower",
    upper: str = "upper",
) -> DataFrame:
    """``interval_sums`` per day."""
    return interval_sums(intervals, [*keys, F.to_date(ts).alias("day")], alpha, y, lower, upper)


def daily_diagnostics(
    intervals: DataFrame,
    keys: Sequence[str],
    methods: Mapping[str, str],
    alpha: float = 0.10,
    error_of: str | None = None,
    method: str = "method",
    ts: str = "ts",
    y: str = "y",
    pred: str = "y_pred",
    flag: str = "shift_flag",
) -> DataFrame:
    """Per series and day: MAE, coverage of each named method, flagged steps and coverage error.

    ``methods`` maps a short name to a method label of the long interval table;
    coverage errors are taken for ``error_of`` (default: the first).
    """
    first = error_of or next(iter(methods))
    aggs = [F.avg(F.when(F.col(method) == methods[first], F.abs(F.col(y) - F.col(pred)))).alias("day_mae")]
    for short, label in methods.items():
        inside = covers(y, "lower", "upper").cast("double")
        aggs.append(F.avg(F.when(F.col(method) == label, inside)).alias(f"day_{short}_cov"))
    if flag in intervals.columns:
        aggs.append(F.count_if((F.col(method) == methods[first]) & F.col(flag)).alias("day_flagged_steps"))
    days = intervals.where(F.col(method).isin(list(methods.values()))).groupBy(
        *keys, F.to_date(ts).alias("day")
    )
    return days.agg(*aggs).withColumn(
        f"day_{first}_ace", F.abs(F.col(f"day_{first}_cov") - (F.lit(1.0) - F.lit(alpha)))
    )


def worst_days(days: DataFrame, keys: Sequence[str], by: str, k: int = 20) -> DataFrame:
    """The ``k`` days with the largest ``by`` per series, earlier days first among equals.

    The rank filter is applied before the shuffle as well, so a task receives at
    most ``k`` days per series from each input task.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(by).desc(), F.col("day"))
    return days.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def formatted_results(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Result table in percent: coverage, target and coverage error to 2 digits."""
    pct = {"empirical_coverage": "coverage_pct", "target_coverage": "target_pct", "ace": "ace_pct"}
    return metrics.select(
        *keys,
        *[F.round(F.col(c) * 100, 2).alias(name) for c, name in pct.items()],
        "mpiw",
        "interval_score",
    )


def coverage_width(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean width against coverage in percent, one point per method."""
    return metrics.select(*keys, "mpiw", (F.col("empirical_coverage") * 100).alias("coverage_pct"))
