"""Ablation and sensitivity grids: each grid is one job over a table of variants."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadshape.functions.columns import absolute_residual, point_band
from loadshape.operators.adaptive import (
    AciVariant,
    ShiftAwareVariant,
    aci_intervals,
    shift_aware_intervals,
)
from loadshape.operators.conformal import (
    calibration_quantiles,
    pack_calibration,
    rolling_bands,
    rolling_intervals,
    rolling_quantiles,
)
from loadshape.operators.metrics import interval_metrics
from loadshape.operators.ordering import lookup
from loadshape.plans.backtest import BacktestSettings, place_rows, with_shift_scores

# The grids, and below the configuration labels of their result tables.
GAMMAS = (0.005, 0.01, 0.02, 0.05)
WINDOW_DAYS = (14, 28, 56)
LEVELS = (0.80, 0.90, 0.95)
# Names and rates of the shift-aware variations.
SA_VARIATIONS: Mapping[str, tuple[float, float]] = {
    "slow_only": (0.005, 0.005),
    "fast_moderate": (0.005, 0.025),
    "fast_aggressive": (0.005, 0.050),
}


def _sa_intervals(placed, keys, variants, settings, seq):
    cal, test = placed
    packed = pack_calibration(cal, keys, {"_abs": absolute_residual("y", "y_pred")}, seq, settings.reference_length)
    scored = with_shift_scores(cal, test, keys, packed, settings)
    return shift_aware_intervals(cal, scored, keys, variants, block=settings.block, seq=seq, rows=test)


def _static_levels(placed, keys, alphas: Mapping[str, float], seq):
    """Static bounds for several alphas: one row per test step and level."""
    cal, test = placed
    q = calibration_quantiles(cal, keys, absolute_residual("y", "y_pred"), alphas)
    long = lookup(test, q, keys).select(
        *keys, "ts", "y", "y_pred",
        F.inline(F.array(*[
            F.struct(F.lit(n).alias("level"), F.lit(a).alias("alpha"), F.col(n).alias("q"))
            for n, a in alphas.items()
        ])),
    )
    lower, upper = point_band("y_pred", "q")
    return long.withColumns({"lower": lower, "upper": upper})


def core_methods(
    forecasts: DataFrame, keys: Sequence[str], settings: BacktestSettings = BacktestSettings(), seq: str = "seq",
) -> DataFrame:
    """Static, rolling, ACI, and shift-aware with the detector off and on."""
    s = settings
    placed = cal, test = place_rows(forecasts, keys, seq)
    cols = [*keys, "y", "lower", "upper"]
    static = _static_levels(placed, keys, {"l": s.alpha}, seq).select(
        F.lit("Static Conformal (P1)").alias("configuration"), *cols
    )
    rolling = rolling_intervals(cal, test, keys, s.alpha, s.rolling_window, s.block).select(
        F.lit("Rolling Conformal (P3)").alias("configuration"), *cols
    )
    aci = aci_intervals(cal, test, keys, [s.aci], s.block).select(
        F.lit("Adaptive Conformal Inference (P4)").alias("configuration"), *cols
    )
    on = replace(s.sa_acp, name="SA-ACP (Proposed - P5)")
    off = replace(
        s.sa_acp, name="SA-ACP (Detector Disabled - A4)", gamma_fast=s.sa_acp.gamma_slow, enable_detector=False
    )
    sa = _sa_intervals(placed, keys, [on, off], s, seq).select(F.col("variant").alias("configuration"), *cols)
    everything = static.unionByName(rolling).unionByName(aci).unionByName(sa)
    return interval_metrics(everything, [*keys, "configuration"], s.alpha)


def gamma_rates(
    forecasts: DataFrame, keys: Sequence[str], gammas: Sequence[float] = GAMMAS,
    settings: BacktestSettings = BacktestSettings(), seq: str = "seq",
) -> DataFrame:
    """ACI at several adaptation rates."""
    cal, test = place_rows(forecasts, keys, seq)
    variants = [replace(settings.aci, name=repr(float(g)), gamma=float(g)) for g in gammas]
    intervals = aci_intervals(cal, test, keys, variants, settings.block)
    return interval_metrics(
        intervals.withColumn("gamma", F.col("variant").cast("double")), [*keys, "gamma"], settings.alpha
    )


def window_lengths(
    forecasts: DataFrame, keys: Sequence[str], days: Sequence[int] = WINDOW_DAYS, steps_per_day: int = 48,
    settings: BacktestSettings = BacktestSettings(), seq: str = "seq",
) -> DataFrame:
    """Rolling conformal at several window lengths."""
    cal, test = place_rows(forecasts, keys, seq)
    q = rolling_quantiles(cal, test, keys, [d * steps_per_day for d in days], settings.block, settings.alpha)
    q = q.withColumn("window_days", (F.col("window") / steps_per_day).cast("int")).drop("window")
    intervals = rolling_bands(test, q, keys, settings.block, "y_pred", "pos")
    return interval_metrics(intervals, [*keys, "window_days"], settings.alpha)


def coverage_levels(
    forecasts: DataFrame, keys: Sequence[str], levels: Sequence[float] = LEVELS,
    settings: BacktestSettings = BacktestSettings(), methods: Sequence[str] = ("static", "sa_acp"), seq: str = "seq",
) -> DataFrame:
    """Static and shift-aware calibration at several nominal levels."""
    alphas = {f"{int(round(lv * 100))}%": round(1.0 - lv, 2) for lv in levels}
    placed = place_rows(forecasts, keys, seq)
    tables = []
    cols = [*keys, "method", "nominal_level", "alpha", "y", "lower", "upper"]
    if "static" in methods:
        tables.append(
            _static_levels(placed, keys, alphas, seq)
            .withColumn("method", F.lit("Static Conformal"))
            .withColumnRenamed("level", "nominal_level")
            .select(*cols)
        )
    if "sa_acp" in methods:
        variants = [replace(settings.sa_acp, name=n, alpha=a) for n, a in alphas.items()]
        alpha = F.lit(None).cast("double")
        for n, a in alphas.items():
            alpha = F.when(F.col("variant") == n, F.lit(a)).otherwise(alpha)
        tables.append(
            _sa_intervals(placed, keys, variants, settings, seq)
            .withColumn("method", F.lit("SA-ACP (Proposed)"))
            .withColumn("alpha", alpha)
            .withColumnRenamed("variant", "nominal_level")
            .select(*cols)
        )
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    metrics = interval_metrics(out, [*keys, "method", "nominal_level", "alpha"], F.col("alpha"))
    return metrics.drop("alpha")


def shift_aware_variations(
    forecasts: DataFrame, keys: Sequence[str], variations: Mapping[str, tuple[float, float]] = SA_VARIATIONS,
    settings: BacktestSettings = BacktestSettings(), seq: str = "seq",
) -> DataFrame:
    """Shift-aware calibration at several pairs of slow and fast rates."""
    variants = [
        replace(settings.sa_acp, name=n, gamma_slow=slow, gamma_fast=fast) for n, (slow, fast) in variations.items()
    ]
    placed = place_rows(forecasts, keys, seq)
    return interval_metrics(
        _sa_intervals(placed, keys, variants, settings, seq), [*keys, "variant"], settings.alpha
    )


def lag_choice(features: DataFrame, keys: Sequence[str], target: str, lags: Sequence[int] = (48, 336)) -> DataFrame:
    """Residual variance and error of the seasonal naive forecast at several lags."""
    rows = features.select(
        *keys, F.col(target).alias("_y"),
        F.inline(F.array(*[
            F.struct(F.lit(k).alias("season_lag"), F.greatest(F.lit(0.0), F.col(f"load_lag_{k}")).alias("_p"))
            for k in lags
        ])),
    )
    e = F.col("_y") - F.col("_p")
    return rows.groupBy(*keys, "season_lag").agg(
        F.var_pop(e).alias("residual_variance"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse")
    )


__all__ = [
    "AciVariant", "ShiftAwareVariant", "core_methods", "coverage_levels", "gamma_rates", "lag_choice",
    "shift_aware_variations", "window_lengths",
]
