import datetime as dt
from dataclasses import replace

import brute
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadshape.functions import columns as C
from loadshape.operators import adaptive, conformal, drift
from loadshape.plans import ablation, backtest
from loadshape.plans.backtest import BacktestSettings

START = dt.datetime(2024, 1, 1)
BLOCK = 10
SETTINGS = BacktestSettings(
    block=BLOCK, rolling_window=64, detector_window=40, reference_length=90,
    sa_acp=adaptive.ShiftAwareVariant(threshold=0.4),
)


def one_series(name, seed, n_cal, n_test):
    rng = np.random.default_rng(seed)
    n = n_cal + n_test
    p = rng.uniform(0, 20, n)
    noise = rng.normal(0, 2, n)
    noise[n_cal + n_test // 2:] *= 3  # a shift half way through the test
    y = np.maximum(0.0, p + noise)
    pdf = pd.DataFrame({"k": name, "seq": range(100, 100 + n), "y": y, "y_pred": p})
    pdf["q_lo"], pdf["q_hi"] = p - 1.0, p + 1.5
    pdf["split"] = ["calibration"] * n_cal + ["test"] * n_test
    pdf["ts"] = [START + dt.timedelta(minutes=30 * i) for i in range(n)]
    return pdf


@pytest.fixture(scope="module")
def frame():
    return pd.concat([one_series("a", 1, 120, 203), one_series("b", 2, 33, 95)], ignore_index=True)


@pytest.fixture(scope="module")
def forecasts(spark, frame):
    return spark.createDataFrame(frame).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@pytest.fixture(scope="module")
def result(forecasts):
    return backtest.run_backtest(forecasts, ["k"], SETTINGS).toPandas().sort_values(["k", "method", "ts"])


def parts(frame, k):
    own = frame[frame["k"] == k]
    cal, test = own[own["split"] == "calibration"], own[own["split"] == "test"]
    return np.abs(cal["y"] - cal["y_pred"]).to_numpy(), cal, test["y"].to_numpy(), test["y_pred"].to_numpy(), test


def bounds(result, k, method):
    own = result[(result["k"] == k) & (result["method"] == method)]
    return own[["lower", "upper"]].to_numpy(), own


@pytest.mark.parametrize("k", ["a", "b"])
def test_static_cqr_and_raw_bands(frame, result, k):
    scores, cal, y, p, test = parts(frame, k)
    q = brute.quantile(scores, 0.1)
    np.testing.assert_allclose(bounds(result, k, "static")[0], np.column_stack([np.maximum(0, p - q), p + q]))
    lo, hi = test["q_lo"].to_numpy(), test["q_hi"].to_numpy()
    lower = np.maximum(0, lo)
    np.testing.assert_allclose(bounds(result, k, "uncalibrated")[0], np.column_stack([lower, np.maximum(lower, hi)]))
    q = brute.quantile(np.maximum(cal["q_lo"] - cal["y"], cal["y"] - cal["q_hi"]), 0.1)
    lower = np.maximum(0, lo - q)
    np.testing.assert_allclose(bounds(result, k, "cqr")[0], np.column_stack([lower, np.maximum(lower, hi + q)]))


@pytest.mark.parametrize("k", ["a", "b"])
def test_rolling(frame, result, k):
    scores, _, y, p, _ = parts(frame, k)
    np.testing.assert_allclose(bounds(result, k, "rolling")[0], brute.rolling(scores, y, p, 0.1, 64, BLOCK))


@pytest.mark.parametrize("chunk", [10, 64, 4096])
def test_rolling_windows_of_any_length(frame, forecasts, chunk):
    cal, test = backtest.place_rows(forecasts, ["k"])
    windows = [1, 7, 10, 25, 500]
    q = conformal.rolling_quantiles(cal, test, ["k"], windows, BLOCK, chunk=chunk)
    got = conformal.rolling_bands(test, q, ["k"], BLOCK, "y_pred", "pos").toPandas().sort_values(["k", "ts"])
    for k in "ab":
        scores, _, y, p, _ = parts(frame, k)
        for w in windows:
            own = got[(got["k"] == k) & (got["window"] == w)][["lower", "upper"]].to_numpy()
            np.testing.assert_allclose(own, brute.rolling(scores, y, p, 0.1, w, BLOCK))


@pytest.mark.parametrize("k", ["a", "b"])
def test_aci(frame, result, k):
    scores, _, y, p, _ = parts(frame, k)
    got, own = bounds(result, k, "aci")
    want, alphas = brute.aci(scores, y, p, 0.1, 0.01, BLOCK)
    np.testing.assert_allclose(got, want)
    np.testing.assert_allclose(own["alpha_t"], alphas)


@pytest.mark.parametrize("k", ["a", "b"])
def test_shift_aware(frame, result, k):
    scores, _, y, p, _ = parts(frame, k)
    shifts = brute.detector(np.abs(y - p), scores, 40, 90)
    want, alphas, gammas = brute.shift_aware(scores, y, p, shifts, 0.1, 0.005, 0.035, 0.02, 0.4, BLOCK)
    got, own = bounds(result, k, "sa_acp")
    np.testing.assert_allclose(got, want)
    np.testing.assert_allclose(own["gamma_t"].astype(float), gammas)
    np.testing.assert_allclose(own["alpha_t"], [alphas[i // BLOCK * BLOCK] for i in range(len(alphas))])
    np.testing.assert_allclose(own["shift_score"].astype(float), [s or 0.0 for s in shifts])
    assert own["shift_flag"].sum() > 0


def test_detector_in_small_chunks(frame, forecasts):
    cal, test = backtest.place_rows(forecasts, ["k"])
    packed = conformal.pack_calibration(cal, ["k"], {"ref": C.absolute_residual("y", "y_pred")})
    scored = test.withColumn("score", C.absolute_residual("y", "y_pred"))
    for window in (24, 40, 120):
        got = drift.wasserstein_scores(
            scored, packed, ["k"], window=window, reference_length=50, ref_scores="ref", chunk=17
        ).toPandas().sort_values(["k", "ts"])
        for k in "ab":
            scores, _, y, p, _ = parts(frame, k)
            want = [np.nan if s is None else s for s in brute.detector(np.abs(y - p), scores, window, 50)]
            np.testing.assert_allclose(got[got["k"] == k]["shift_score"].astype(float), want)


def test_detector_off_stays_slow(frame, forecasts):
    off = replace(SETTINGS, sa_acp=replace(SETTINGS.sa_acp, enable_detector=False))
    got = backtest.run_backtest(forecasts, ["k"], off, ["sa_acp"]).toPandas()
    assert set(got["gamma_t"]) == {0.005} and not got["shift_flag"].any() and (got["shift_score"] == 0).all()


def test_future_outcomes_do_not_change_past_bounds(frame, forecasts, result):
    cut = 100 + 120 + 100  # after 100 test steps of series a
    bumped = forecasts.withColumn("y", F.when(F.col("seq") >= cut, F.col("y") + 500).otherwise(F.col("y")))
    again = backtest.run_backtest(bumped, ["k"], SETTINGS).toPandas().sort_values(["k", "method", "ts"])
    early = lambda df: df[(df["k"] == "a") & (df["seq"] < cut)][["method", "seq", "lower", "upper"]].reset_index(drop=True)
    pd.testing.assert_frame_equal(early(result), early(again))


def test_partitioning_does_not_change_results(forecasts, result):
    for n in (1, 9):
        again = backtest.run_backtest(forecasts.repartition(n), ["k"], SETTINGS).toPandas()
        again = again.sort_values(["k", "method", "ts"])
        np.testing.assert_array_equal(again["lower"], result["lower"])


def test_no_row_at_a_time_python(forecasts):
    plan = backtest.run_backtest(forecasts, ["k"], SETTINGS)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_many_variants_in_one_walk(frame, forecasts):
    table = ablation.gamma_rates(forecasts, ["k"], (0.005, 0.05, 0.2), SETTINGS).toPandas()
    for k in "ab":
        scores, _, y, p, _ = parts(frame, k)
        for g in (0.005, 0.05, 0.2):
            b, _ = brute.aci(scores, y, p, 0.1, g, BLOCK)
            want = round(float(np.mean((y >= b[:, 0]) & (y <= b[:, 1]))), 4)
            got = table[(table["k"] == k) & (table["gamma"] == g)]["empirical_coverage"].item()
            assert got == pytest.approx(want, abs=1.01e-4)


def test_grids_cover_all_variants(forecasts):
    core = ablation.core_methods(forecasts, ["k"], SETTINGS)
    assert core.count() == 2 * 5
    levels = ablation.coverage_levels(forecasts, ["k"], settings=SETTINGS).toPandas()
    assert len(levels) == 2 * 2 * 3 and set(levels["target_coverage"]) == {0.8, 0.9, 0.95}
    assert ablation.window_lengths(forecasts, ["k"], (1, 2), 10, SETTINGS).count() == 4
    assert ablation.shift_aware_variations(forecasts, ["k"], settings=SETTINGS).count() == 6


def test_small_walk_batches_change_nothing(spark, forecasts, result):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "2")
    try:
        again = backtest.run_backtest(forecasts, ["k"], SETTINGS, ["aci"]).toPandas().sort_values(["k", "ts"])
    finally:
        spark.conf.set(key, before)
    np.testing.assert_array_equal(again["lower"], result[result["method"] == "aci"]["lower"])


def test_calibration_in_many_pieces_changes_nothing(forecasts, result, monkeypatch):
    monkeypatch.setattr(conformal.calibration_pieces, "__defaults__", ("seq", "_cal", 7))
    again = backtest.run_backtest(forecasts, ["k"], SETTINGS, ["aci"]).toPandas().sort_values(["k", "ts"])
    np.testing.assert_array_equal(again["lower"], result[result["method"] == "aci"]["lower"])


def test_reference_is_the_end_of_the_sample(forecasts):
    cal, _ = backtest.place_rows(forecasts, ["k"])
    score = {"s": C.absolute_residual("y", "y_pred")}
    whole = {r.k: r.s for r in conformal.pack_calibration(cal, ["k"], score).collect()}
    ends = {r.k: r.s for r in conformal.pack_calibration(cal, ["k"], score, last=9).collect()}
    assert ends == {k: v[-9:] for k, v in whole.items()}


def walk_one_by_one(scores, y, p, shifts, v, block):
    """(bounds, alphas, quantiles per step) of shift-aware calibration, steps without an outcome left out of the updates."""
    a, out = v.alpha, []
    for t in range(len(y)):
        if t % block == 0:
            q = brute.quantile(scores, a)
        out.append((max(0.0, p[t] - q), p[t] + q, a, brute.quantile(scores, a)))
        if np.isnan(y[t]):
            continue
        miss = 0.0 if out[-1][0] <= y[t] <= out[-1][1] else 1.0
        delta = 0.0 if shifts[t] is None else shifts[t]
        flag = shifts[t] is not None and delta >= v.threshold
        loss = v.eta * delta * miss if flag or v.penalty == "always" else 0.0
        a = float(np.clip(a + (v.gamma_fast if flag else v.gamma_slow) * (v.alpha - miss) - loss, v.alpha_min, v.alpha_max))
    return np.array(out)


def with_gaps(frame):
    """Missing outcomes here and there, and for more than a block on end."""
    gone = (frame["seq"] % 6 == 1) | frame["seq"].between(260, 285)
    return frame.assign(y=frame["y"].mask(gone))


@pytest.mark.parametrize("penalty", ["flagged", "always"])
@pytest.mark.parametrize("k", ["a", "b"])
def test_missing_outcomes_move_nothing(spark, frame, k, penalty):
    own = with_gaps(frame)[lambda d: d["k"] == k]
    v = replace(SETTINGS.sa_acp, penalty=penalty)
    s = replace(SETTINGS, sa_acp=v)
    df = spark.createDataFrame(own).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df = df.withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    got = backtest.run_backtest(df, ["k"], s).toPandas().sort_values(["method", "ts"])
    cal, test = own[own["split"] == "calibration"], own[own["split"] == "test"]
    scores = np.abs(cal["y"] - cal["y_pred"]).dropna().to_numpy()
    y, p = test["y"].to_numpy(), test["y_pred"].to_numpy()
    there = ~np.isnan(y)
    bounds = lambda m: got[got["method"] == m][["lower", "upper"]].to_numpy()
    # rolling: the last scores before the block
    new, want = np.abs(y - p), []
    for t in range(len(y)):
        seen = np.concatenate([scores, new[: t // BLOCK * BLOCK][there[: t // BLOCK * BLOCK]]])
        q = brute.quantile(seen[-s.rolling_window :], 0.1)
        want.append((max(0.0, p[t] - q), p[t] + q))
    np.testing.assert_allclose(bounds("rolling"), want)
    # one alpha per block, by the mean over the outcomes there are
    a, want = 0.1, []
    for at in range(0, len(y), BLOCK):
        q, part = brute.quantile(scores, a), slice(at, at + BLOCK)
        lo, hi = np.maximum(0.0, p[part] - q), p[part] + q
        want += list(zip(lo, hi))
        inside = ((y[part] >= lo) & (y[part] <= hi))[there[part]]
        a = float(np.clip(a + 0.01 * (0.1 - (1 - inside.mean())), 0.01, 0.5)) if len(inside) else a
    np.testing.assert_allclose(bounds("aci"), want)
    shifts = [None] * len(y)
    for t, d in zip(np.nonzero(there)[0], brute.detector(new[there], scores, 40, 90)):
        shifts[t] = d
    want = walk_one_by_one(scores, y, p, shifts, v, BLOCK)
    np.testing.assert_allclose(bounds("sa_acp"), want[:, :2])


def test_trace_has_the_quantile_of_every_step(forecasts, frame):
    cal, test = backtest.place_rows(forecasts, ["k"])
    packed = conformal.pack_calibration(cal, ["k"], {"_abs": C.absolute_residual("y", "y_pred")})
    scored = backtest.with_shift_scores(cal, test, ["k"], packed, SETTINGS)
    got = adaptive.shift_aware_intervals(cal, scored, ["k"], [SETTINGS.sa_acp], block=BLOCK, rows=test).toPandas().sort_values(["k", "ts"])
    for k in "ab":
        scores, _, y, p, _ = parts(frame, k)
        shifts = brute.detector(np.abs(y - p), scores, 40, 90)
        want = walk_one_by_one(scores, y, p, shifts, SETTINGS.sa_acp, BLOCK)
        own = got[got["k"] == k]
        np.testing.assert_allclose(own[["lower", "upper", "alpha_t", "quantile_t"]].to_numpy(), want)
    assert (got["quantile_t"] != got["conformal_quantile"]).sum() > 50


def test_alpha_path_is_one_step_after_the_other():
    draw = np.random.default_rng(3)
    for scale in (0.001, 0.05, 1.0):
        gains, losses = draw.normal(size=400) * scale, np.abs(draw.normal(size=400)) * scale * (draw.random(400) < 0.3)
        before, after = adaptive.alpha_path(0.1, gains, losses, 0.01, 0.5)
        a = 0.1
        for i in range(400):
            assert before[i] == a
            a = adaptive.clip(a + gains[i] - losses[i], 0.01, 0.5)
        assert after == a
    assert adaptive.alpha_path(0.2, np.empty(0), np.empty(0), 0.0, 1.0)[1] == 0.2


def test_missing_outcomes_have_no_score_in_either_form(spark):
    rows = [("a", i, float(i % 7) if i % 5 else None, 1.0, "calibration" if i < 60 else "test") for i in range(90)]
    df = spark.createDataFrame(rows, "k string, seq long, y double, y_pred double, split string")
    df = df.withColumns({"ts": F.timestamp_add("HOUR", F.col("seq").cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")), "q_lo": F.lit(0.0), "q_hi": F.lit(2.0)})
    cal, test = df.where("split = 'calibration'"), df.where("split = 'test'")
    alone = conformal.static_intervals(cal, test, ["k"]).first()["conformal_quantile"]
    backtested = backtest.run_backtest(df, ["k"], methods=["static", "aci"]).where("seq = 60").collect()
    assert {r["conformal_quantile"] for r in backtested} == {alone}


def test_aci_directions_and_clipping():
    v = adaptive.AciVariant(alpha=0.1, gamma=0.05, alpha_min=0.02, alpha_max=0.40)
    assert adaptive.aci_next(0.1, 1.0, v) < 0.1 < adaptive.aci_next(0.1, 0.0, v)
    low = high = 0.1
    for _ in range(100):
        low, high = adaptive.aci_next(low, 1.0, v), adaptive.aci_next(high, 0.0, v)
    assert (low, high) == (0.02, 0.40)


def test_shift_aware_rates():
    v = adaptive.ShiftAwareVariant(threshold=1.25)
    miss, known = np.array([True]), np.array([True])
    moves = lambda shift, v: tuple(x[0] for x in adaptive.shift_aware_moves(miss, np.array([shift]), known, v))
    assert moves(float("nan"), v)[2:] == (0.005, False)
    assert moves(2.0, v)[2:] == (0.035, True)
    assert moves(2.0, v)[:2] == (pytest.approx(0.035 * -0.9), pytest.approx(0.02 * 2.0))
    assert moves(1.0, v)[1] == 0.0
    assert moves(1.0, replace(v, penalty="always"))[:2] == (pytest.approx(0.005 * -0.9), pytest.approx(0.02))


def test_static_hand_case(spark):
    rows = [("a", i, y, p) for i, (y, p) in enumerate(zip((10.0, 20.0, 30.0, 40.0, 50.0), (11.0, 19.0, 32.0, 38.0, 53.0), strict=True))]
    df = spark.createDataFrame(rows, "k string, ts long, y double, y_pred double")
    got = conformal.static_intervals(df, df, ["k"], 0.2).toPandas()
    assert got["conformal_quantile"].iloc[0] == pytest.approx(np.quantile([1, 1, 2, 2, 3], 1.0))
    assert got["lower"].min() == 8.0


def test_series_without_calibration_has_zero_width(spark):
    test = spark.createDataFrame([("x", 1, 2.0, 3.0)], "k string, ts long, y double, y_pred double")
    cal = test.where("false")
    row = conformal.static_intervals(cal, test, ["k"]).first()
    assert (row["lower"], row["upper"]) == (3.0, 3.0)
