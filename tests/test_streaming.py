import datetime as dt
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadshape.operators import cohorts
from loadshape.operators.adaptive import AciVariant, ShiftAwareVariant
from loadshape.plans import backtest
from loadshape.plans.backtest import BacktestSettings
from loadshape.streaming import calibrator as K
from loadshape.streaming import ingest as G

START = dt.datetime(2024, 1, 1)


def feed(spark, pdf, folder, parts, schema):
    """Write the rows as files whose order of modification is the order of arrival."""
    os.makedirs(folder, exist_ok=True)
    for i, idx in enumerate(np.array_split(np.arange(len(pdf)), parts)):
        path = f"{folder}/part-{i:03d}.parquet"
        pdf.iloc[idx].to_parquet(path, index=False, coerce_timestamps="us", allow_truncated_timestamps=True)
        os.utime(path, (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(spark, df, tmp_path, name="q"):
    out, checkpoint = str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-ckpt")
    G.run_to_files(df, out, checkpoint)
    return spark.read.schema(df.schema).parquet(out)


def forecast_rows(n_cal=60, n_test=170):
    frames = []
    for name, seed in (("a", 1), ("b", 2)):
        rng = np.random.default_rng(seed)
        n = n_cal + n_test
        p = rng.uniform(0, 20, n)
        noise = rng.normal(0, 2, n)
        noise[n_cal + 80:] *= 3
        pdf = pd.DataFrame({"k": name, "seq": range(n), "y": np.maximum(0, p + noise), "y_pred": p})
        pdf["ts"] = [START + dt.timedelta(minutes=30 * i) for i in range(n)]
        pdf["is_calibration"] = [True] * n_cal + [False] * n_test
        frames.append(pdf)
    return pd.concat(frames, ignore_index=True)


SETTINGS = BacktestSettings(block=10, rolling_window=48, detector_window=40, reference_length=50,
                            sa_acp=ShiftAwareVariant(threshold=0.4))


def test_online_calibrators_replay_the_batch_backtest(spark, tmp_path):
    pdf = forecast_rows()
    # rows arrive up to five hours out of order, within the watermark delay of one day
    jitter = np.random.default_rng(0).uniform(0, 10, len(pdf))
    arriving = pdf.assign(order=pdf["seq"] + jitter).sort_values("order").drop(columns="order")
    # a far later row of each series moves the watermark past everything else
    last = arriving.groupby("k").tail(1).assign(ts=START + dt.timedelta(days=60), is_calibration=False)
    arriving = pd.concat([arriving, last], ignore_index=True)
    schema = "k string, seq long, y double, y_pred double, ts timestamp_ntz, is_calibration boolean"
    stream = feed(spark, arriving, str(tmp_path / "in"), 5, schema)
    out = K.online_intervals(stream, ["k"], "1 day", AciVariant(), SETTINGS.sa_acp, 0.1, 48, 40, 50, 10)
    got = drain(spark, out, tmp_path).toPandas()

    split = np.where(pdf["is_calibration"], "calibration", "test")
    batch_in = spark.createDataFrame(pdf.assign(split=split)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    want = backtest.run_backtest(batch_in, ["k"], SETTINGS, ["rolling", "aci", "sa_acp"]).toPandas()
    key = ["k", "method", "ts"]
    both = got.merge(want, on=key, suffixes=("", "_batch"))
    assert len(got) == len(want) == len(both) == 2 * 3 * 170
    for c in ("lower", "upper", "conformal_quantile"):
        np.testing.assert_allclose(both[c], both[f"{c}_batch"])
    sa = both[both["method"] == "sa_acp"]
    assert (sa["shift_flag"].astype(bool) == sa["shift_flag_batch"].astype(bool)).all() and sa["shift_flag"].sum() > 0
    np.testing.assert_allclose(sa["gamma_t"], sa["gamma_t_batch"])


class Held:
    """The state handle of one series, in memory; ``writes`` counts what is put per part."""

    def __init__(self):
        self.parts, self.writes, self.timers, self.watermark = {}, {}, [], 0

    def _part(self, name):
        class Part:
            def __init__(part):
                part.items = {}

            def put(part, key, value):
                self.writes[name] = self.writes.get(name, 0) + 1
                part.items[key] = value

            exists = lambda part: bool(part.items)
            update = lambda part, value: part.put("value", value)
            updateValue = put
            iterator = lambda part: iter(list(part.items.items()))
            removeKey = lambda part, key: part.items.pop(key)

            def appendList(part, values):
                for v in values:
                    part.put(len(part.items), v)

            def get(part):
                return part.items["value"] if "value" in part.items else iter(list(part.items.values()))

        return self.parts.setdefault(name, Part())

    def getValueState(self, name, *_):
        return self._part(name)

    getListState = getMapState = getValueState

    def registerTimer(self, ms):
        self.timers.append(ms)

    def getCurrentWatermarkInMs(self):
        return self.watermark


def calibrator(methods, *sizes):
    held = Held()
    series = K.SeriesCalibrator(["k"], methods, *sizes)
    series.init(held)

    def feed_rows(times, y, pred, is_cal):
        rows = pd.DataFrame({"micros": [t * 1000 for t in times], "y": y, "y_pred": pred, "calibrates": is_cal})
        list(series.handleInputRows(("x",), iter([rows]), held))

    def pass_watermark(ms):
        held.watermark = ms
        return [f for f in series.handleExpiredTimer(("x",), held, None)]

    return held, feed_rows, pass_watermark


def test_alpha_moves_only_after_the_outcome():
    held, feed_rows, pass_watermark = calibrator([("sa_acp", ShiftAwareVariant())], 50, 50, 100, 1)
    feed_rows(range(1, 101), [2.0] * 100, [0.0] * 100, [True] * 100)
    assert held.timers == [1] and pass_watermark(100) == []
    feed_rows([101], [50.0], [10.0], [False])
    row = pass_watermark(101)[0].iloc[0]
    assert row["alpha_t"] == 0.1 and held.parts["numbers"].get()[4][0] < 0.1


def test_rolling_state_is_a_ring_and_waiting_rows_are_timed():
    held, feed_rows, pass_watermark = calibrator([("rolling", AciVariant("rolling", 0.1, 0.0))], 10, 8, 100, 1)
    feed_rows(range(99, -1, -1), [float(i) for i in range(99, -1, -1)], [0.0] * 100, [True] * 100)
    pass_watermark(49)
    assert held.timers[-1] == 50  # the first of those that still wait
    pass_watermark(99)
    assert sorted(v for (v,) in held.parts["ring"].items.values()) == [float(i) for i in range(90, 100)]
    assert not held.parts["waiting"].items
    held.writes.clear()
    feed_rows([100], [None], [1.0], [False])
    feed_rows([101], [7.0], [1.0], [False])
    rows = pass_watermark(200)[0]
    assert len(rows) == 2 and rows["y"].isna().tolist() == [True, False]
    # one score more: one slot of the ring is written, and nothing of the calibration sample
    assert held.writes["ring"] == 1 and "calibration" not in held.writes


@pytest.mark.parametrize("missing", [False, True])
def test_joined_streams_replay_the_batch_backtest(spark, tmp_path, missing):
    pdf = forecast_rows()
    if missing:
        gone = (pdf["seq"] % 7 == 3) | pdf["seq"].between(100, 125)
        pdf = pdf.assign(y=pdf["y"].mask(gone))
    last = START + dt.timedelta(days=90)
    ends = pdf.groupby("k").tail(1).assign(ts=last)
    jitter = np.random.default_rng(1).uniform(0, 10, len(pdf))
    early = pdf.assign(order=pdf["seq"] + jitter).sort_values("order")
    late = pdf[pdf["y"].notna()].assign(order=lambda d: d["seq"] + 20).sort_values("order")
    names = "k string, ts timestamp_ntz, "
    f = feed(spark, pd.concat([early, ends])[["k", "ts", "y_pred", "is_calibration"]], str(tmp_path / "f"), 4, names + "y_pred double, is_calibration boolean")
    o = feed(spark, pd.concat([late, ends.assign(y=0.0)])[["k", "ts", "y"]], str(tmp_path / "o"), 4, names + "y double")
    out = K.online_intervals_of(
        f, o, ["k"], "1 day", aci=AciVariant(), sa_acp=SETTINGS.sa_acp, window=48, detector_window=40, reference_length=50, block=10
    )
    got = drain(spark, out, tmp_path).toPandas()
    split = np.where(pdf["is_calibration"], "calibration", "test")
    batch_in = spark.createDataFrame(pdf.assign(split=split)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    want = backtest.run_backtest(batch_in, ["k"], SETTINGS, ["rolling", "aci", "sa_acp"]).toPandas()
    both = got.merge(want, on=["k", "method", "ts"], suffixes=("", "_batch"))
    assert len(got) == len(want) == len(both) == 2 * 3 * 170
    for c in ("lower", "upper", "conformal_quantile"):
        np.testing.assert_allclose(both[c], both[f"{c}_batch"])
    assert both["y"].isna().sum() == both["y_batch"].isna().sum() == 3 * pdf["y"].isna()[~pdf["is_calibration"]].sum()


def test_forecasts_meet_their_outcomes(spark, tmp_path):
    pdf = forecast_rows(10, 40)
    f = feed(spark, pdf[["k", "ts", "y_pred"]], str(tmp_path / "f"), 2, "k string, ts timestamp_ntz, y_pred double")
    o = feed(spark, pdf[["k", "ts", "y"]].iloc[::-1], str(tmp_path / "o"), 2, "k string, ts timestamp_ntz, y double")
    joined = drain(spark, G.join_outcomes(f, o, ["k"], "3 days"), tmp_path).toPandas()
    assert len(joined) == len(pdf) and np.isclose(joined["y"].sum(), pdf["y"].sum())


def readings(n=900):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"household_id": rng.integers(0, 20, n).astype(str), "energy_kwh": rng.uniform(0, 2, n)})
    pdf["timestamp"] = [START + dt.timedelta(minutes=float(m)) for m in np.sort(rng.uniform(0, 60 * 24, n))]
    pdf["tariff_group"] = np.where(pdf["household_id"].astype(int) % 3 == 0, "dToU", "Std")
    return pdf


SCHEMA = "household_id string, energy_kwh double, timestamp timestamp_ntz, tariff_group string"


def test_stream_cohort_load_equals_batch(spark, tmp_path):
    pdf = readings()
    end = pdf.iloc[[-1]].assign(timestamp=START + dt.timedelta(days=9), energy_kwh=0.0)
    stream = feed(spark, pd.concat([pdf, end]), str(tmp_path / "in"), 4, SCHEMA)
    got = drain(spark, G.cohort_load_stream(stream, "1 hour"), tmp_path).toPandas()
    batch = spark.createDataFrame(pdf).select(
        "household_id", "energy_kwh", "tariff_group",
        F.window(F.col("timestamp").cast("timestamp_ntz"), "30 minutes")["start"].alias("timestamp"),
    )
    want = cohorts.cohort_load(batch, household="household_id").toPandas()
    both = got.merge(want, on=["cohort", "ts"], suffixes=("", "_w"))
    assert len(both) == len(want)
    for c in ("load_kwh", "load_mean_kwh", "load_std_kwh"):
        np.testing.assert_allclose(both[c], both[f"{c}_w"])
    assert (both["active_households"] - both["active_households_w"]).abs().max() <= 1


def test_late_rows_are_dropped(spark, tmp_path):
    pdf = readings(50)
    end = pdf.iloc[[-1]].assign(timestamp=START + dt.timedelta(days=9), energy_kwh=0.0)
    late = pdf.iloc[[0]].assign(energy_kwh=1000.0)
    arriving = pd.concat([pdf, end, end, late], ignore_index=True)
    folder = str(tmp_path / "in")
    os.makedirs(folder)
    for i, part in enumerate((arriving.iloc[:51], arriving.iloc[51:52], arriving.iloc[52:])):
        path = f"{folder}/p{i}.parquet"
        part.to_parquet(path, index=False, coerce_timestamps="us", allow_truncated_timestamps=True)
        os.utime(path, (1_700_000_000 + i * 10,) * 2)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    got = drain(spark, G.cohort_load_stream(stream, "1 hour"), tmp_path)
    total = got.where("cohort = 'total_population'").agg(F.sum("load_kwh")).first()[0]
    assert total == pytest.approx(pdf["energy_kwh"].sum())


def test_stream_dedup(spark, tmp_path):
    pdf = readings(100)
    arriving = pd.concat([pdf, pdf.iloc[:30].assign(energy_kwh=9.0)]).sort_values("timestamp", kind="stable")
    stream = feed(spark, arriving, str(tmp_path / "in"), 3, SCHEMA)
    got = drain(spark, G.dedup_stream(stream, "2 days"), tmp_path)
    assert got.count() == 100


def test_zone_free_times_are_utc_in_any_session_zone(spark, tmp_path):
    before = spark.conf.get("spark.sql.session.timeZone")
    at = [dt.datetime(2013, 3, 31, 0, 30), dt.datetime(2013, 3, 31, 1, 30), dt.datetime(2013, 3, 31, 2, 30)]
    spark.conf.set("spark.sql.session.timeZone", "Europe/London")
    try:
        path = str(tmp_path / "in")
        spark.createDataFrame([("h", t) for t in at + at], "household_id string, timestamp timestamp_ntz").write.parquet(path)
        rows = spark.readStream.schema("household_id string, timestamp timestamp_ntz").parquet(path)
        kept = drain(spark, G.dedup_stream(rows, "1 day").withColumn("timestamp", G.zone_free(F.unix_micros("timestamp"))), tmp_path)
        assert sorted(r.timestamp for r in kept.collect()) == at
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
