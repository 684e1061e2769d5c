"""Column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# London bank holidays of the smart-meter trial years, 2011-2014.
TRIAL_BANK_HOLIDAYS = (
    "2011-12-26", "2011-12-27",
    "2012-01-02", "2012-04-06", "2012-04-09", "2012-05-07", "2012-06-04",
    "2012-06-05", "2012-08-27", "2012-12-25", "2012-12-26",
    "2013-01-01", "2013-03-29", "2013-04-01", "2013-05-06", "2013-05-27",
    "2013-08-26", "2013-12-25", "2013-12-26",
    "2014-01-01", "2014-04-18", "2014-04-21", "2014-05-05", "2014-05-26",
)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rounded(x, digits: int | None) -> Column:
    return _c(x) if digits is None else F.round(_c(x), digits)


# calendar -----------------------------------------------------------------

def step_of_day(ts, steps_per_day: int = 48) -> Column:
    minutes = F.hour(_c(ts)) * 60 + F.minute(_c(ts))
    return F.floor(minutes / F.lit(1440 / steps_per_day)).cast("int")


def cyclic(x, period: float) -> tuple[Column, Column]:
    angle = _c(x) * F.lit(2 * math.pi) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def season(month) -> Column:
    m = _c(month)
    return (
        F.when(m.isin(12, 1, 2), "Winter")
        .when(m.isin(3, 4, 5), "Spring")
        .when(m.isin(6, 7, 8), "Summer")
        .otherwise("Autumn")
    )


def peak_status(hour) -> Column:
    return F.when(_c(hour).between(17, 21), "Peak (17-21h)").otherwise("Off-Peak")


def day_type(ts) -> Column:
    return F.when(F.weekday(_c(ts)) >= 5, "Weekend").otherwise("Weekday")


def tertile(x, low, high, labels=("Low", "Medium", "High")) -> Column:
    """Right-closed bins; equal cut points leave the middle bin empty."""
    return (
        F.when(_c(x) <= _c(low), labels[0])
        .when(_c(x) <= _c(high), labels[1])
        .when(_c(x).isNotNull(), labels[2])
    )


# scores and losses -----------------------------------------------------------

def absolute_residual(y, p) -> Column:
    return F.abs(_c(y) - _c(p))


def band_violation(y, lower, upper) -> Column:
    """Signed distance outside [lower, upper]; negative inside."""
    return F.greatest(_c(lower) - _c(y), _c(y) - _c(upper))


def covers(y, lower, upper) -> Column:
    return (_c(y) >= _c(lower)) & (_c(y) <= _c(upper))


def winkler(y, lower, upper, alpha) -> Column:
    y, lower, upper = _c(y), _c(lower), _c(upper)
    rate = F.lit(2.0) / (F.lit(float(alpha)) if isinstance(alpha, (int, float)) else _c(alpha))
    below = F.when(y < lower, rate * (lower - y)).otherwise(F.lit(0.0))
    above = F.when(y > upper, rate * (y - upper)).otherwise(F.lit(0.0))
    return upper - lower + below + above


def pinball(y, q, tau: float) -> Column:
    e = _c(y) - _c(q)
    return F.greatest(F.lit(float(tau)) * e, F.lit(float(tau) - 1.0) * e)


# intervals -------------------------------------------------------------------

def point_band(p, q) -> tuple[Column, Column]:
    """[max(0, p - q), p + q]"""
    return F.greatest(F.lit(0.0), _c(p) - _c(q)), _c(p) + _c(q)


def quantile_band(lo, hi, q=None) -> tuple[Column, Column]:
    """[max(0, lo - q), max(lower, hi + q)]"""
    q = F.lit(0.0) if q is None else _c(q)
    lower = F.greatest(F.lit(0.0), _c(lo) - q)
    return lower, F.greatest(lower, _c(hi) + q)


def conformal_level(n, alpha) -> Column:
    """min(1, ceil((n + 1)(1 - alpha)) / n)"""
    a = F.lit(float(alpha)) if isinstance(alpha, (int, float)) else _c(alpha)
    n = _c(n)
    return F.least(F.lit(1.0), F.ceil((n + 1) * (F.lit(1.0) - a)) / n)


def array_quantile(sorted_scores, level) -> Column:
    """Linear-interpolation quantile of an ascending array at a column level."""
    a = _c(sorted_scores)
    h = (F.size(a) - 1) * level
    lo, hi = F.floor(h).cast("int"), F.ceil(h).cast("int")
    low = F.get(a, lo)
    return low + (h - lo) * (F.get(a, hi) - low)


def conformal_quantile(sorted_scores, alpha) -> Column:
    """Finite-sample quantile of an ascending score array; 0 for an empty one."""
    a = _c(sorted_scores)
    n = F.size(a)
    return F.when(n <= 0, F.lit(0.0)).otherwise(
        array_quantile(a, conformal_level(F.nullif(n, F.lit(0)), alpha))
    )


# A published rational Chebyshev fit of erfc(x) = t exp(-x^2 + c0 + c1 t + ... + c9 t^9), t = 1 / (1 + x / 2),
# for x >= 0, with a relative error below 1.2e-7.
ERFC = (
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
)


def two_sided_normal(z) -> Column:
    """P(|Z| >= z) of a standard normal Z, 1 for a z of 0 or below."""
    x = F.greatest(_c(z), F.lit(0.0)) / F.lit(math.sqrt(2.0))
    t = 1.0 / (1.0 + x / 2.0)
    power = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        power = power * t + c
    return F.when(_c(z).isNotNull(), F.least(F.lit(1.0), t * F.exp(power - x * x)))
