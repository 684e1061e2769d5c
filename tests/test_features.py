import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadshape.operators import features as X
from loadshape.operators import splits as S

START = dt.datetime(2012, 1, 1)


def series(spark, values, name="a", start=START):
    pdf = pd.DataFrame({"k": name, "seq": range(len(values)), "load_kwh": np.asarray(values, float)})
    pdf["ts"] = [start + dt.timedelta(minutes=30 * i) for i in range(len(values))]
    return spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def table(df):
    return df.toPandas().sort_values(["k", "ts"]).reset_index(drop=True)


def test_future_change_leaves_past_features_alone(spark):
    y = np.random.default_rng(0).uniform(10, 50, 500)
    bumped = y.copy()
    bumped[300:] += 1000
    names = X.load_feature_names()
    a = table(X.lag_features(series(spark, y), ["k"], chunk=400))[names]
    b = table(X.lag_features(series(spark, bumped), ["k"], chunk=400))[names]
    pd.testing.assert_frame_equal(a[: 300 + 48], b[: 300 + 48])
    assert not a[348:].equals(b[348:])


def test_features_match_pandas(spark):
    y = pd.Series(np.random.default_rng(1).uniform(10, 50, 900))
    got = table(X.lag_features(series(spark, y), ["k"], chunk=384))
    origin = y.shift(48)
    day, week = origin.rolling(48, min_periods=24), origin.rolling(336, min_periods=96)
    want = {
        "load_lag_48": y.shift(48), "load_lag_336": y.shift(336), "origin_ramp_h48": origin - y.shift(49),
        "origin_mean_24h_h48": day.mean(), "origin_std_24h_h48": day.std(), "origin_min_24h_h48": day.min(),
        "origin_max_24h_h48": day.max(), "origin_mean_7d_h48": week.mean(), "origin_std_7d_h48": week.std(),
    }
    for name, column in want.items():
        np.testing.assert_allclose(got[name], column, err_msg=name)


def test_short_lag_is_refused(spark):
    with pytest.raises(ValueError, match="Data Leakage Violation"):
        X.lag_features(series(spark, range(100)), ["k"], horizon=48, lags=[24])


def test_one_shuffle_one_sort(spark):
    df = series(spark, np.arange(900)).repartition(3)
    plan = X.forecasting_table(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("Exchange hashpartitioning") == 1
    assert initial.count("Sort [") == 1


def test_warmup_choices(spark):
    ranges = {"train": ("2012-01-01", "2012-01-10"), "calibration": ("2012-01-11", "2012-01-20"),
              "validation": ("2012-01-21", "2012-01-22"), "test": ("2012-01-23", "2012-01-31")}
    df = S.tag_splits(series(spark, np.arange(31 * 48.0)), ranges)
    carried = X.forecasting_table(df, ["k"]).groupBy("split").count().collect()
    anew = X.forecasting_table(df, ["k"], warmup="per_split").groupBy("split").count().collect()
    assert dict(map(tuple, carried)) == {"train": 144, "calibration": 480, "validation": 96, "test": 432}
    assert dict(map(tuple, anew)) == {"train": 144, "calibration": 144, "test": 96}


def test_scaler_sees_training_rows_only(spark):
    rng = np.random.default_rng(2)
    train, test = rng.normal(10, 2, 500), rng.normal(50, 10, 500)
    df = series(spark, np.concatenate([train, test])).withColumn("flat", F.lit(3.0))
    scaler = X.fit_scaler(df.where("seq < 500"), ["k"], ["load_kwh", "flat"])
    row = scaler.first()
    assert row["_mean_load_kwh"] == pytest.approx(train.mean()) and row["_scale_load_kwh"] == pytest.approx(train.std())
    assert row["_scale_flat"] == 1.0
    out = table(X.scale(df, scaler, ["k"], ["load_kwh", "flat"]))
    np.testing.assert_allclose(out["load_kwh"][500:], (test - train.mean()) / train.std())
    assert (out["flat"] == 0).all()


def test_bank_holidays(spark):
    df = series(spark, np.zeros(96), start=dt.datetime(2012, 12, 25))
    listed = table(X.calendar_features(df))["is_bank_holiday"]
    assert listed.tolist() == [1.0] * 96
    assert table(X.calendar_features(df, holidays=None))["is_bank_holiday"].sum() == 0


def test_regularise_fills_gaps(spark):
    df = series(spark, np.arange(10.0)).where("seq not in (3, 4)")
    zero = table(X.regularise(df, ["k"], fill="zero"))
    assert zero["seq"].tolist() == list(range(10)) and zero["load_kwh"].tolist()[3:5] == [0.0, 0.0]
    assert table(X.regularise(df, ["k"]))["load_kwh"].isna().sum() == 2


def test_rolling_coverage(spark):
    flags = np.random.default_rng(3).random(700) < 0.8
    df = series(spark, flags).withColumn("covered", F.col("load_kwh") > 0)
    got = table(X.rolling_coverage(df, ["k"], window=336, chunk=400))["rolling_coverage"]
    np.testing.assert_allclose(got, pd.Series(flags.astype(float)).rolling(336).mean())


# splits

RANGES = {"train": ("2012-01-01", "2012-10-31"), "calibration": ("2012-11-01", "2012-12-31"),
          "validation": ("2013-01-01", "2013-02-28"), "test": ("2013-03-01", "2013-12-31")}


def test_splits_are_ordered_and_whole(spark):
    df = series(spark, np.full(731 * 48, 10.0)).select("k", "ts")
    rows = {r["split"]: r for r in S.split_summary(S.tag_splits(df, RANGES)).collect()}
    assert sum(r["n_rows"] for r in rows.values()) == 731 * 48
    order = [rows[s] for s in S.SPLITS]
    assert all(a["last_ts"] < b["first_ts"] for a, b in zip(order, order[1:], strict=False))
    assert rows["train"]["last_ts"] == dt.datetime(2012, 10, 31, 23, 30)


def test_empty_split_is_reported(spark):
    df = series(spark, np.zeros(48)).select("k", "ts")
    rows = {r["split"]: r["is_empty"] for r in S.split_summary(S.tag_splits(df, RANGES)).collect()}
    assert rows == {"train": False, "calibration": True, "validation": True, "test": True}


def test_overlapping_ranges_raise():
    with pytest.raises(ValueError, match="Invalid split boundaries"):
        S.check_ranges(RANGES | {"train": ("2012-01-01", "2012-11-01")})


def test_series_slices(spark):
    df = series(spark, np.arange(100.0))
    assert table(S.series_slice(df, ["k"], rows=(7, 14)))["seq"].tolist() == list(range(7, 14))
    assert table(S.series_slice(df, ["k"], part=(0, 3)))["seq"].max() == 32
    assert table(S.series_slice(df, ["k"], part=(2, 3)))["seq"].min() == 66


def test_readings_off_the_grid_are_added_to_their_step(spark):
    import datetime as dt

    at = [dt.datetime(2024, 1, 1, 0, 30), dt.datetime(2024, 1, 1, 0, 40), dt.datetime(2024, 1, 2, 1, 0), dt.datetime(2024, 1, 1, 0, 30)]
    df = spark.createDataFrame([("a", at[0], 1.0), ("a", at[1], 5.0), ("a", at[2], 1.0), (None, at[3], 2.0)], "k string, ts timestamp_ntz, load_kwh double")
    rows = X.regularise(df, ["k"], fill="zero").orderBy("k", "seq").collect()
    assert [(r.k, r.seq, r.load_kwh) for r in rows if r.load_kwh] == [(None, 0, 2.0), ("a", 0, 6.0), ("a", 49, 1.0)]
    assert len(rows) == 51 and rows[-1].ts == at[2]
