"""The whole run over many series: features, four point models, quantile models, and the backtest of all interval methods."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadshape.operators import boosting, features, models
from loadshape.operators.metrics import point_metrics
from loadshape.operators.splits import tag_splits
from loadshape.plans.backtest import BacktestSettings, run_backtest
from loadshape.session import cut_lineage

# Names of the point models in result tables.
SEASONAL_DAY = "seasonal_naive_day"
SEASONAL_WEEK = "seasonal_naive_week"
RIDGE = "ridge"
BOOSTED = "hist_gradient_boosting"
POINT_MODELS = (SEASONAL_DAY, SEASONAL_WEEK, RIDGE, BOOSTED)


@dataclass(frozen=True)
class ModelSettings:
    ridge_alpha: float = 1.0
    rounds: int = 150
    max_depth: int = 6
    learning_rate: float = 0.05
    min_leaf: int = 20
    levels: Mapping[str, float] = field(default_factory=lambda: dict(models.QUANTILES))
    primary: str = BOOSTED


def model_forecasts(
    series: DataFrame, keys: Sequence[str], ranges: Mapping[str, tuple], target: str = "load_kwh", ts: str = "ts",
    settings: ModelSettings = ModelSettings(),
) -> DataFrame:
    """Rows of all splits with ``y``, one column per point model and one per quantile level; fitted on the training rows.

    ``series`` is a regular series (keys, ts, seq, target).  The ridge sees features scaled by the training rows.
    """
    keys, s = list(keys), settings
    names = features.feature_names()
    rows = cut_lineage(tag_splits(features.forecasting_table(series, keys), ranges), "features")
    train = rows.where("split = 'train'")
    scaled = [f"_s_{n}" for n in names]
    scaler = features.fit_scaler(train, keys, names)
    both = features.scale(rows, scaler, keys, names).select(
        *keys, ts, "seq", "split", F.col(target).alias("y"), *[F.col(n).alias(f"_s_{n}") for n in names]
    )
    ridge = models.ridge_fit(both.where("split = 'train'"), keys, scaled, "y", s.ridge_alpha)
    linear = models.ridge_predict(both, ridge, keys, scaled, RIDGE).select(*keys, ts, "seq", "split", "y", RIDGE)
    shape = {"rounds": s.rounds, "max_depth": s.max_depth, "learning_rate": s.learning_rate, "min_leaf": s.min_leaf}
    points = boosting.boosted_fit(train, keys, names, target, None, **shape)
    levels = boosting.boosted_fit(train, keys, names, target, s.levels, **shape)
    # outputs of one table of models: all are evaluated where the rows are
    outputs = {boosting.MEAN: BOOSTED}
    grown = boosting.boosted_predict(rows, points, keys, names, outputs, s.max_depth)
    grown = boosting.boosted_predict(grown, levels, keys, names, list(s.levels), s.max_depth)
    grown = models.add_seasonal_naive(grown, 48, SEASONAL_DAY)
    grown = models.add_seasonal_naive(grown, 336, SEASONAL_WEEK)
    return linear.join(grown.select(*keys, ts, SEASONAL_DAY, SEASONAL_WEEK, BOOSTED, *s.levels), [*keys, ts])


def point_table(forecasts: DataFrame, keys: Sequence[str], split: str = "test") -> DataFrame:
    """Point metrics of every model on one split."""
    rows = models.stack_models(forecasts.where(F.col("split") == split), keys, {m: m for m in POINT_MODELS}, "y")
    return point_metrics(rows, [*keys, "model"])


def backtest_forecasts(
    forecasts: DataFrame, keys: Sequence[str], settings: BacktestSettings = BacktestSettings(),
    model_settings: ModelSettings = ModelSettings(),
) -> DataFrame:
    """``run_backtest`` of the primary point model and the outermost quantile levels."""
    primary = models.primary_model([m for m in POINT_MODELS if m in forecasts.columns], model_settings.primary)
    low, high = models.outer_levels(model_settings.levels)
    rows = forecasts.select(
        *keys, "ts", "seq", "split", "y", F.col(primary).alias("y_pred"), F.col(low).alias("q_lo"), F.col(high).alias("q_hi")
    )
    return run_backtest(rows, keys, settings)
