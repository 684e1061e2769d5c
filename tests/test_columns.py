import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadshape.functions import columns as C


def one(df, column):
    return df.select(column.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def row(spark):
    return spark.range(1)


def array(values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_conformal_quantile_of_one_to_ten(row):
    assert one(row, C.conformal_quantile(array(range(1, 11)), 0.2)) == pytest.approx(9.1)


def test_conformal_quantile_empty_is_zero(row):
    assert one(row, C.conformal_quantile(F.array().cast("array<double>"), 0.1)) == 0.0


@pytest.mark.parametrize("alpha", [0.01, 0.05, 0.1, 0.3, 0.5])
def test_conformal_quantile_matches_numpy(row, alpha):
    scores = np.sort(np.random.default_rng(1).normal(size=57))
    level = min(1.0, np.ceil(58 * (1 - alpha)) / 57)
    assert one(row, C.conformal_quantile(array(scores), alpha)) == pytest.approx(np.quantile(scores, level))


def test_calendar_labels(row):
    saturday_evening = F.lit(dt.datetime(2024, 1, 6, 21, 59)).cast("timestamp_ntz")
    assert one(row, C.day_type(saturday_evening)) == "Weekend"
    assert one(row, C.peak_status(F.hour(saturday_evening))) == "Peak (17-21h)"
    assert one(row, C.step_of_day(saturday_evening)) == 43
    assert [one(row, C.season(F.lit(m))) for m in (12, 3, 8, 11)] == ["Winter", "Spring", "Summer", "Autumn"]


def test_winkler_hand_values(row):
    scores = [one(row, C.winkler(F.lit(y), F.lit(8.0), F.lit(12.0), 0.1)) for y in (10.0, 5.0, 15.0)]
    assert scores == pytest.approx([4.0, 64.0, 64.0])


def test_pinball_hand_values(row):
    assert one(row, C.pinball(F.lit(10.0), F.lit(8.0), 0.9)) == pytest.approx(1.8)
    assert one(row, C.pinball(F.lit(10.0), F.lit(12.0), 0.9)) == pytest.approx(0.2)


def test_bands(row):
    lower, upper = C.point_band(F.lit(1.0), F.lit(3.0))
    assert (one(row, lower), one(row, upper)) == (0.0, 4.0)
    lower, upper = C.quantile_band(F.lit(4.0), F.lit(5.0), F.lit(-2.0))
    assert (one(row, lower), one(row, upper)) == (6.0, 6.0)


def test_tertile_bins_are_right_closed(row):
    label = lambda v: one(row, C.tertile(F.lit(v), F.lit(1.0), F.lit(2.0)))
    assert [label(v) for v in (1.0, 1.5, 2.0, 2.1)] == ["Low", "Medium", "Medium", "High"]


def test_two_sided_normal(spark):
    z = [0.0, 1e-9, 0.3, 1.0, 1.959963984540054, 3.0, 6.0, 12.0, -1.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in z] + [(None,)], "z double").select(C.two_sided_normal("z")).collect()]
    for value, p in zip(z, got):
        assert p == pytest.approx(min(1.0, math.erfc(max(value, 0.0) / math.sqrt(2))), rel=2e-7)
    assert got[-1] is None
