"""Leakage-safe day-ahead features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadshape.functions.columns import TRIAL_BANK_HOLIDAYS, cyclic, step_of_day
from loadshape.operators.ordering import (
    CHUNK,
    chunk_window,
    chunked,
    lookup,
    positions,
    unchunk,
)

LAGS = (48, 96, 144, 336)
CALENDAR = (
    "half_hour_idx", "hour", "day_of_week", "is_weekend", "month", "day_of_year",
    "sin_hh", "cos_hh", "sin_dow", "cos_dow", "sin_doy", "cos_doy", "is_bank_holiday",
)


def load_feature_names(lags: Sequence[int] = LAGS, horizon: int = 48) -> list[str]:
    h = f"h{horizon}"
    return [f"load_lag_{k}" for k in lags] + [
        f"origin_load_{h}", f"origin_ramp_{h}",
        f"origin_mean_24h_{h}", f"origin_std_24h_{h}", f"origin_min_24h_{h}", f"origin_max_24h_{h}",
        f"origin_mean_7d_{h}", f"origin_std_7d_{h}",
    ]


def feature_names(lags: Sequence[int] = LAGS, horizon: int = 48) -> list[str]:
    return list(CALENDAR) + load_feature_names(lags, horizon)


def check_lags(lags: Sequence[int], horizon: int) -> None:
    bad = [k for k in lags if k < horizon]
    if bad:
        raise ValueError(
            f"Data Leakage Violation: lags {bad} are smaller than the horizon {horizon}; "
            "that load is not yet observed at the forecast origin"
        )


def _minutes(c: Column) -> Column:
    """Minutes since 1970 on the clock, whatever the session zone."""
    return F.unix_date(c.cast("date")).cast("long") * 1440 + F.hour(c) * 60 + F.minute(c)


def regularise(
    df: DataFrame,
    keys: Sequence[str],
    step_minutes: int = 30,
    ts: str = "ts",
    value: str = "load_kwh",
    fill: str = "null",
    start=None,
    end=None,
    series: DataFrame | None = None,
) -> DataFrame:
    """Put every series on a gap-free grid and number it.

    The grid has a step every ``step_minutes`` from midnight on, between ``start`` and ``end``, or
    from the first to the last row of each series.  A reading between two steps
    belongs to the earlier one, and readings of one step are added up (NULLs
    count as missing, other columns take their least value); rows outside an explicit ``start`` or ``end``
    are not asked for.  ``fill`` is ``null`` or ``zero``.  ``seq`` is the step number, so chunked
    windows need no further numbering.  With ``start``, ``end`` and a table of
    the ``series`` (one row each), ``df`` is read once; otherwise a first pass
    finds the series and their ends.  A NULL key is a series like any other.
    """
    keys = list(keys)
    step = F.expr(f"interval {int(step_minutes)} minutes")
    rest = [c for c in df.columns if c not in (*keys, ts, value, "seq")]
    day = F.date_trunc("day", F.col(ts)).cast("timestamp_ntz")
    passed = F.floor((F.hour(ts) * 60 + F.minute(ts)) / F.lit(step_minutes))
    df = df.withColumn(ts, F.timestamp_add("MINUTE", (passed * step_minutes).cast("int"), day))
    df = df.groupBy(*keys, ts).agg(F.sum(value).alias(value), *[F.min(c).alias(c) for c in rest])
    lo = F.min(ts) if start is None else F.lit(start).cast("timestamp_ntz")
    hi = F.max(ts) if end is None else F.lit(end).cast("timestamp_ntz")
    if series is not None and start is not None and end is not None:
        bounds = series.select(*keys, lo.alias("_lo"), hi.alias("_hi"))
    else:
        bounds = df.groupBy(*keys).agg(lo.alias("_lo"), hi.alias("_hi"))
    # a day at a time, so that no cell holds a whole series
    first, last = (F.date_trunc("day", F.col(c)).cast("timestamp_ntz") for c in ("_lo", "_hi"))
    days = bounds.select(*keys, "_lo", "_hi", F.explode(F.sequence(first, last, F.expr("interval 1 day"))).alias("_day"))
    steps = F.sequence("_day", F.timestamp_add("MICROSECOND", F.lit(86_399_999_999), F.col("_day")), step)
    grid = days.select(*keys, "_lo", "_hi", F.explode(steps).alias(ts)).where((F.col(ts) >= F.col("_lo")) & (F.col(ts) <= F.col("_hi")))
    gap = (_minutes(F.col(ts)) - _minutes(F.col("_lo"))) / F.lit(step_minutes)
    grid = grid.select(*keys, ts, F.floor(gap).cast("long").alias("_pos"))
    joined = lookup(grid, df, [*keys, ts], "left")
    v = F.col(value) if fill == "null" else F.coalesce(F.col(value), F.lit(0.0))
    return joined.select(*keys, ts, v.alias(value), *rest, F.col("_pos").cast("long").alias("seq"))


def calendar_features(
    df: DataFrame,
    ts: str = "ts",
    steps_per_day: int = 48,
    holidays: Sequence[str] | DataFrame | None = TRIAL_BANK_HOLIDAYS,
) -> DataFrame:
    """Calendar columns known in advance.

    ``holidays`` is a list of ISO dates, a table with a ``date`` column of
    distinct days, or None for a constant 0.
    """
    t = F.col(ts)
    out = df.withColumns(
        {
            "half_hour_idx": step_of_day(t, steps_per_day),
            "hour": F.hour(t),
            "day_of_week": F.weekday(t),
            "is_weekend": (F.weekday(t) >= 5).cast("double"),
            "month": F.month(t),
            "day_of_year": F.dayofyear(t),
        }
    )
    cycles = {"hh": ("half_hour_idx", float(steps_per_day)), "dow": ("day_of_week", 7.0), "doy": ("day_of_year", 365.25)}
    waves = {}
    for name, (column, period) in cycles.items():
        waves[f"sin_{name}"], waves[f"cos_{name}"] = cyclic(column, period)
    out = out.withColumns(waves)
    if holidays is None:
        return out.withColumn("is_bank_holiday", F.lit(0.0))
    if isinstance(holidays, DataFrame):
        days = holidays.select(F.col("date").cast("date").alias("_day")).distinct()
        hit = days.withColumn("_hit", F.lit(True))
        return (
            out.withColumn("_day", F.to_date(t))
            .join(hit, "_day", "left")
            .withColumn("is_bank_holiday", F.coalesce(F.col("_hit"), F.lit(False)).cast("double"))
            .drop("_day", "_hit")
        )
    listed = F.to_date(t).isin([F.lit(d).cast("date") for d in holidays])
    return out.withColumn("is_bank_holiday", listed.cast("double"))


def lag_features(
    df: DataFrame,
    keys: Sequence[str],
    value: str = "load_kwh",
    seq: str = "seq",
    horizon: int = 48,
    lags: Sequence[int] = LAGS,
    rolling: bool = True,
    steps_per_day: int = 48,
    chunk: int = CHUNK,
) -> DataFrame:
    """Lags and statistics of the load up to the forecast origin ``t - horizon``.

    All frames share one window over (keys, chunk): one shuffle, one sort.
    """
    check_lags(lags, horizon)
    day, week = steps_per_day, 7 * steps_per_day
    halo = max([*lags, horizon + 1] + ([horizon + week - 1] if rolling else []))
    parts = chunked(df, halo, seq, chunk)
    w = chunk_window(keys, seq)
    v = F.col(value)
    h = f"h{horizon}"
    cols = {f"load_lag_{k}": F.lag(v, k).over(w) for k in lags}
    cols[f"origin_load_{h}"] = F.lag(v, horizon).over(w)
    cols[f"origin_ramp_{h}"] = F.lag(v, horizon).over(w) - F.lag(v, horizon + 1).over(w)
    if rolling:
        d = w.rowsBetween(-(horizon + day - 1), -horizon)
        s = w.rowsBetween(-(horizon + week - 1), -horizon)
        full_d = F.count(v).over(d) >= day // 2
        full_s = F.count(v).over(s) >= 2 * day
        cols[f"origin_mean_24h_{h}"] = F.when(full_d, F.avg(v).over(d))
        cols[f"origin_std_24h_{h}"] = F.when(full_d, F.stddev_samp(v).over(d))
        cols[f"origin_min_24h_{h}"] = F.when(full_d, F.min(v).over(d))
        cols[f"origin_max_24h_{h}"] = F.when(full_d, F.max(v).over(d))
        cols[f"origin_mean_7d_{h}"] = F.when(full_s, F.avg(v).over(s))
        cols[f"origin_std_7d_{h}"] = F.when(full_s, F.stddev_samp(v).over(s))
    return unchunk(parts.withColumns(cols))


def forecasting_table(
    df: DataFrame,
    keys: Sequence[str],
    ts: str = "ts",
    target: str = "load_kwh",
    horizon: int = 48,
    lags: Sequence[int] = LAGS,
    holidays=TRIAL_BANK_HOLIDAYS,
    warmup: str = "carry",
    steps_per_day: int = 48,
    drop_incomplete: bool = True,
    chunk: int = CHUNK,
) -> DataFrame:
    """Calendar and load features; rows with any missing feature or target are dropped.

    ``warmup='carry'`` lets lags reach back over split borders (still leak-free);
    ``'per_split'`` starts every split anew, as one feature table per split would.
    A ``seq`` column of the input is used as is, else rows are numbered here.
    """
    group = list(keys) + (["split"] if warmup == "per_split" else [])
    numbered = df
    if warmup == "per_split" or "seq" not in df.columns:
        numbered = positions(df, group, ts)
    lagged = lag_features(
        numbered, group, target, "seq", horizon, lags, True, steps_per_day, chunk
    )
    out = calendar_features(lagged, ts, steps_per_day, holidays)
    if drop_incomplete:
        out = out.dropna(subset=[*feature_names(lags, horizon), target])
    return out


def fit_scaler(train: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean and scale (std, ddof 0; 1 where the variance is 0) per series, from training rows only."""
    aggs = []
    for c in columns:
        std = F.stddev_pop(c)
        aggs += [
            F.avg(c).alias(f"_mean_{c}"),
            F.when(std > 0, std).otherwise(F.lit(1.0)).alias(f"_scale_{c}"),
        ]
    return train.groupBy(*keys).agg(*aggs)


def scale(df: DataFrame, scaler: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Standardise ``columns`` with a fitted scaler."""
    joined = lookup(df, scaler, keys)
    return joined.select(
        *[
            ((F.col(c) - F.col(f"_mean_{c}")) / F.col(f"_scale_{c}")).alias(c) if c in columns else F.col(c)
            for c in df.columns
        ]
    )


def rolling_coverage(
    df: DataFrame,
    keys: Sequence[str],
    covered: str = "covered",
    window: int = 336,
    seq: str = "seq",
    out: str = "rolling_coverage",
    chunk: int = CHUNK,
) -> DataFrame:
    """Trailing mean of ``covered``; NULL until the window is full."""
    parts = chunked(df, window - 1, seq, chunk)
    w = chunk_window(keys, seq).rowsBetween(-(window - 1), 0)
    c = F.col(covered).cast("double")
    mean = F.when(F.count(c).over(w) == window, F.avg(c).over(w))
    return unchunk(parts.withColumn(out, mean))
