"""Distribution shift: per-step detectors and two-sample statistics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadshape.functions.columns import rounded, two_sided_normal
from loadshape.operators.ordering import (
    CHUNK,
    HOT_MIN,
    chunk_window,
    chunked,
    exact_quantiles,
    lookup,
    positions,
    ranked_values,
    unchunk,
)


# per-step detectors ---------------------------------------------------------

def trailing_distances(scores: np.ndarray, halo: int, window: int, least: int, reference: np.ndarray) -> np.ndarray:
    """Distance of the trailing window at every score after the first ``halo``; NaN until ``least`` are seen.

    All values are ranked once.  Between two neighbouring ones the distance grows by |F - G| times their gap; in units of
    one over both sizes F - G is a whole number, which a score entering or leaving the window changes
    by one size on the values above it.  A step is one insertion and one removal, without any sorting.
    """
    out = np.full(scores.size - halo, np.nan)
    m = reference.size
    if m == 0 or scores.size <= halo:
        return out
    grid, at = np.unique(np.concatenate([scores, reference]), return_inverse=True)
    gaps, at = np.diff(grid), at[: scores.size]
    below = np.searchsorted(np.sort(reference), grid[:-1], side="right").astype(float)  # of the reference
    first = max(0, halo - window + 1)  # the window before the first own score starts here
    count = np.zeros(len(gaps))  # of the window
    size = 0
    off = np.zeros(len(gaps))
    for i in range(first, scores.size):
        if size < window:  # only while a series starts, or at the first window of a chunk
            size += 1
            count[at[i] :] += 1
            full = size == window
            if full or i >= halo:
                off = count * m - below * size
        else:
            gone, come = at[i - window], at[i]
            if gone < come:
                off[gone:come] -= m
            else:
                off[come:gone] += m
        if i >= halo and size >= least:
            out[i - halo] = np.abs(off) @ gaps / (size * m)
    return out


def wasserstein_scores(
    test: DataFrame,
    reference: DataFrame,
    keys: Sequence[str],
    score: str = "score",
    pos: str = "pos",
    window: int = 336,
    reference_length: int = 1344,
    ref_scores: str = "ref_scores",
    chunk: int = CHUNK,
    out: str = "shift_score",
) -> DataFrame:
    """Trailing-window 1-Wasserstein distance to the reference, in reference standard deviations.

    ``reference`` has one row per series with calibration scores in time order
    (``pack_calibration``); its last ``reference_length`` count.  The buffer
    starts empty at ``pos`` 0 and includes the current score; the result is NULL
    until max(24, window // 4) scores are seen.  Series are cut into chunks with
    the ``window - 1`` scores before each, so a long series spreads over tasks.
    """
    least = max(24, window // 4)
    columns = [c for c in test.columns if c not in keys]

    @F.pandas_udf("array<double>")
    def distances(scores: pd.Series, halo: pd.Series, ref: pd.Series) -> pd.Series:
        return pd.Series(
            [
                trailing_distances(np.asarray(s, float), int(h), window, least, np.asarray(r, float))
                for s, h, r in zip(scores, halo, ref, strict=True)
            ]
        )

    parts = chunked(test, window - 1, pos, chunk)
    packed = parts.groupBy(*keys, "_chunk").agg(
        F.sort_array(
            F.collect_list(F.struct(F.col(pos).alias("_at"), "_halo", F.col(score).cast("double").alias("_score")))
        ).alias("_scores"),
        F.sort_array(
            F.collect_list(F.when(~F.col("_halo"), F.struct(F.col(pos).alias("_at"), F.struct(*columns).alias("_row"))))
        ).alias("_own"),
    )
    ref = F.col(ref_scores)
    kept = F.slice(ref, F.greatest(F.size(ref) - reference_length, F.lit(0)) + 1, F.lit(reference_length))
    n = F.size("_ref")
    mean = F.aggregate("_ref", F.lit(0.0), lambda a, x: a + x) / n
    spread = F.aggregate("_ref", F.lit(0.0), lambda a, x: a + F.pow(x - F.col("_mean"), 2)) / n
    refs = (
        reference.select(*keys, kept.alias("_ref"))
        .withColumn("_mean", mean)
        .withColumn("_std", F.greatest(F.sqrt(spread), F.lit(1e-6)))
        .drop("_mean")
    )
    joined = lookup(packed.where(F.size("_own") > 0), refs, keys, "left")
    empty = F.array().cast("array<double>")
    halo = F.size("_scores") - F.size("_own")
    scored = joined.withColumn(
        "_w1", distances(F.col("_scores._score"), halo, F.coalesce("_ref", empty))
    )
    rows = scored.select(
        *keys, "_std", F.explode(F.arrays_zip(F.col("_own._row").alias("row"), F.col("_w1").alias("w1"))).alias("_z")
    )
    w1 = F.col("_z.w1")
    return rows.select(*keys, "_z.row.*", F.when(~F.isnan(w1), w1 / F.col("_std")).alias(out))


def mean_shift_scores(
    test: DataFrame,
    cal: DataFrame,
    keys: Sequence[str],
    score: str = "score",
    pos: str = "pos",
    window: int = 336,
    out: str = "shift_score",
    chunk: int = CHUNK,
) -> DataFrame:
    """Standardised distance of the trailing mean score from the calibration mean; NULL below 24 scores."""
    ref = cal.groupBy(*keys).agg(
        F.avg(score).alias("_mu"), F.greatest(F.stddev_pop(score), F.lit(1e-6)).alias("_sigma")
    )
    parts = chunked(test, window - 1, pos, chunk)
    w = chunk_window(keys, pos).rowsBetween(-(window - 1), 0)
    trailing = unchunk(
        parts.withColumn("_m", F.avg(score).over(w)).withColumn("_n", F.count(score).over(w))
    )
    joined = lookup(trailing, ref, keys, "left")
    z = F.abs(F.col("_m") - F.col("_mu")) / (F.col("_sigma") / F.sqrt("_n"))
    return joined.withColumn(out, F.when(F.col("_n") >= 24, z)).drop("_m", "_n", "_mu", "_sigma")


def flag_shift(df: DataFrame, threshold: float, score: str = "shift_score", out: str = "shift_flag") -> DataFrame:
    """Score 0 and no flag while the detector is still filling; else flag at ``threshold``."""
    return df.withColumn(out, F.coalesce(F.col(score) >= threshold, F.lit(False))).withColumn(
        score, F.coalesce(F.col(score), F.lit(0.0))
    )


# two-sample statistics ------------------------------------------------------

def two_sample_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    period: str,
    pre: str,
    post: str,
    hot_min: int = HOT_MIN,
) -> DataFrame:
    """1-Wasserstein, Kolmogorov-Smirnov and Mann-Whitney statistics from one ranked pass.

    All three follow from the running counts of both samples over the merged
    distinct values.  The KS p-value is the asymptotic series, the Mann-Whitney
    one the normal approximation with tie and continuity correction.
    """
    both = df.where(F.col(period).isin(pre, post))
    side = {"a": F.when(F.col(period) == pre, 1).otherwise(0), "b": F.when(F.col(period) == post, 1).otherwise(0)}
    ranked = ranked_values(both, keys, value, side, hot_min)
    # a series with one period only has no statistics
    gap = F.abs(F.try_divide("cum_a", "total_a") - F.try_divide("cum_b", "total_b"))
    ties = (F.col("a") + F.col("b")).cast("double")
    before = (F.col("cum_a") + F.col("cum_b")).cast("double") - ties
    sums = ranked.groupBy(*keys).agg(
        F.max("total_a").alias("n_pre"),
        F.max("total_b").alias("n_post"),
        F.sum(gap * (F.col("next_value") - F.col("value"))).alias("wasserstein_1d"),
        F.max(gap).alias("ks_statistic"),
        F.sum(F.col("a") * (before + (ties + 1) / 2)).alias("_rank_sum"),
        F.sum(ties * ties * ties - ties).alias("tie_term"),
    )
    n1, n2 = F.col("n_pre").cast("double"), F.col("n_post").cast("double")
    n = n1 + n2
    u1 = F.col("_rank_sum") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("tie_term"), n * (n - 1))))
    lam = F.sqrt(F.round(n1 * n2 / n)) * F.col("ks_statistic")
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(100)),
        lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(F.col("_lam") * F.col("_lam") * k * k * -2.0),
    )
    ks_p = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)

    return (
        sums.withColumn("u_statistic", u1)
        .withColumn("mann_whitney_z", F.try_divide(F.greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5, sd))
        .withColumn("_lam", lam)
        # below 0.2 the alternating series is 1 to machine precision but slow to settle
        .withColumn("ks_p_value", F.when(F.col("_lam") < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ks_p))))
        .withColumn("mann_whitney_p_value", two_sided_normal("mann_whitney_z"))
        .withColumn("significant_shift", F.col("ks_p_value") < 0.01)
        .drop("_rank_sum", "_lam")
    )


def period_moments(df: DataFrame, keys: Sequence[str], value: str, period: str) -> DataFrame:
    """Count, mean, std (ddof 0), median, p95 and p99 per series and period."""
    group = [*keys, period]
    base = df.where(F.col(value).isNotNull())
    moments = base.groupBy(*group).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")
    )
    tails = {"median": 0.5, "p95": 0.95, "p99": 0.99}
    quantiles = exact_quantiles(base, group, value, tails)
    return lookup(moments, quantiles, group)


def ramps_and_autocorrelation(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    period: str,
    lags: Sequence[int] = (48, 336),
    ts: str = "ts",
    chunk: int = CHUNK,
) -> DataFrame:
    """Mean absolute ramp and biased autocorrelations per series and period.

    NULL values are dropped first, differences and lags are taken over the rows
    that remain.  ``acf_k`` is NULL where the sample is too short for lag k,
    that is min(350, n // 2 - 1) < k, or < 48 for any lag.
    """
    group = [*keys, period]
    rows = positions(df.where(F.col(value).isNotNull()).select(*group, ts, value), group, ts)
    centre = rows.groupBy(*group).agg(F.avg(value).alias("_mu"))
    centred = lookup(rows, centre, group).withColumn("_d", F.col(value) - F.col("_mu"))
    parts = chunked(centred, max(lags), "seq", chunk)
    w = chunk_window(group, "seq")
    lagged = unchunk(
        parts.withColumns(
            {"_ramp": F.abs(F.col(value) - F.lag(value, 1).over(w))}
            | {f"_p{k}": F.col("_d") * F.lag("_d", k).over(w) for k in lags}
        )
    )
    reach = F.least(F.lit(350), F.floor(F.count("*") / 2) - 1)
    return lagged.groupBy(*group).agg(
        F.avg("_ramp").alias("mean_absolute_ramp"),
        reach.alias("_reach"),
        *[F.try_divide(F.sum(f"_p{k}"), F.sum(F.col("_d") * F.col("_d"))).alias(f"acf_{k}") for k in lags],
    )


def characterise_shift(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    period: str,
    pre: str,
    post: str,
    ts: str = "ts",
    digits: int | None = 4,
    hot_min: int = HOT_MIN,
) -> DataFrame:
    """One row per series comparing two periods: moments, tails, ramps, autocorrelation, distances, tests."""
    both = df.where(F.col(period).isin(pre, post)).select(*keys, period, ts, value)
    lags = (48, 336)
    per_period = period_moments(both, keys, value, period).join(
        ramps_and_autocorrelation(both, keys, value, period, lags, ts), [*keys, period]
    )
    names = ["n", "mean", "std", "median", "p95", "p99", "mean_absolute_ramp", "acf_48", "acf_336", "_reach"]

    def pick(label: str, suffix: str):
        return [F.max(F.when(F.col(period) == label, F.col(c))).alias(f"{c}_{suffix}") for c in names]

    wide = per_period.groupBy(*keys).agg(*pick(pre, "pre"), *pick(post, "post"))
    tests = two_sample_statistics(both, keys, value, period, pre, post, hot_min)
    joined = wide.join(tests.drop("n_pre", "n_post"), list(keys))
    reach = F.least("_reach_pre", "_reach_post")

    def change(c: str):
        return F.round(F.try_divide(F.col(f"{c}_post") - F.col(f"{c}_pre"), F.col(f"{c}_pre")) * 100.0, 2)

    out = [F.col("n_pre"), F.col("n_post")]
    for c in ("mean", "std", "median", "p95", "p99", "mean_absolute_ramp"):
        out += [rounded(f"{c}_{s}", digits).alias(f"{c}_{s}") for s in ("pre", "post")]
    out += [change("mean").alias("mean_pct_change"), change("std").alias("std_pct_change")]
    for k in lags:
        out += [
            F.when(reach >= max(k, 48), rounded(f"acf_{k}_{s}", digits)).alias(f"acf_{k}_{s}")
            for s in ("pre", "post")
        ]
    out += [rounded(c, digits).alias(c) for c in ("wasserstein_1d", "ks_statistic")]
    out += [F.col(c) for c in ("ks_p_value", "mann_whitney_p_value", "significant_shift")]
    return joined.select(*keys, *out)
