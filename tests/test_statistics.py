import datetime as dt

import brute
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadshape.operators import bootstrap, drift, metrics, reliability

START = dt.datetime(2024, 1, 1)


def frame(spark, columns, **extra):
    pdf = pd.DataFrame(columns)
    for c, v in extra.items():
        pdf[c] = v
    return spark.createDataFrame(pdf)


# metrics

def test_point_metrics_hand_case(spark):
    df = frame(spark, {"k": "a", "y": [10.0, 20, 30, 40], "y_pred": [12.0, 18, 30, 44]})
    m = metrics.point_metrics(df, ["k"]).first()
    assert (m["mae"], m["rmse"], m["nmae"]) == (2.0, round(6**0.5, 4), 0.08)


def test_interval_metrics_hand_case(spark):
    df = frame(spark, {"k": "a", "y": [10.0, 20, 30, 40], "lower": [8.0, 15, 25, 45], "upper": [12.0, 25, 35, 50]})
    m = metrics.interval_metrics(df, ["k"], 0.1).first()
    assert (m["empirical_coverage"], m["ace"], m["mpiw"], m["target_coverage"]) == (0.75, 0.15, 7.25, 0.9)


def test_interval_score_hand_case(spark):
    df = frame(spark, {"k": "a", "y": [10.0, 5, 15], "lower": 8.0, "upper": 12.0})
    assert metrics.interval_metrics(df, ["k"], 0.1, digits=None).first()["interval_score"] == pytest.approx(132 / 3)


def test_daily_sums_add_up(spark):
    rng = np.random.default_rng(0)
    n = 480
    df = frame(spark, {"k": "a", "method": "m", "y": rng.normal(size=n), "lower": -1.0, "upper": 1.0,
                       "ts": [START + dt.timedelta(minutes=30 * i) for i in range(n)]})
    days = metrics.daily_sums(df, ["k", "method"])
    assert days.count() == 10
    whole = metrics.interval_sums(df, ["k"]).first()
    again = days.agg(*[F.sum(c).alias(c) for c in ("n_obs", "n_covered", "sum_width", "sum_score")]).first()
    for c in ("n_obs", "n_covered", "sum_width", "sum_score"):
        assert again[c] == pytest.approx(whole[c])


def test_worst_days_limits_before_the_shuffle(spark):
    df = frame(spark, {"k": "a", "day": pd.date_range("2024-01-01", periods=50), "e": np.arange(50.0)})
    worst = metrics.worst_days(df, ["k"], "e", 20)
    assert [r["e"] for r in worst.orderBy("rank").collect()] == list(np.arange(49.0, 29, -1))
    assert "WindowGroupLimit" in worst._jdf.queryExecution().executedPlan().toString()


# drift

@pytest.fixture(scope="module")
def samples():
    rng = np.random.default_rng(5)
    return np.round(rng.normal(10, 2, 700), 1), np.round(rng.normal(11, 3, 450), 1)


@pytest.mark.parametrize("hot_min", [50_000, 20])
def test_two_sample_statistics(spark, samples, hot_min):
    a, b = samples
    df = frame(spark, {"k": "x", "v": np.concatenate([a, b]), "period": ["pre"] * len(a) + ["post"] * len(b)})
    got = drift.two_sample_statistics(df, ["k"], "v", "period", "pre", "post", hot_min).first()
    assert got["wasserstein_1d"] == pytest.approx(brute.wasserstein(a, b))
    grid = np.unique(np.concatenate([a, b]))
    f = np.searchsorted(np.sort(a), grid, side="right") / len(a)
    g = np.searchsorted(np.sort(b), grid, side="right") / len(b)
    assert got["ks_statistic"] == pytest.approx(np.abs(f - g).max())
    ranks = pd.Series(np.concatenate([a, b])).rank().to_numpy()
    u = ranks[: len(a)].sum() - len(a) * (len(a) + 1) / 2
    assert got["u_statistic"] == pytest.approx(u)
    pairs = (a[:, None] > b[None, :]).sum() + 0.5 * (a[:, None] == b[None, :]).sum()
    assert u == pytest.approx(pairs)
    assert got["significant_shift"] and got["ks_p_value"] < 1e-4 and got["mann_whitney_p_value"] < 1e-4


def test_equal_samples_show_no_shift(spark, samples):
    a, _ = samples
    df = frame(spark, {"k": "x", "v": np.concatenate([a, a]), "period": ["pre"] * len(a) + ["post"] * len(a)})
    got = drift.two_sample_statistics(df, ["k"], "v", "period", "pre", "post").first()
    assert (got["wasserstein_1d"], got["ks_statistic"], got["ks_p_value"]) == (0.0, 0.0, 1.0)
    assert got["mann_whitney_p_value"] == 1.0 and not got["significant_shift"]


def test_normal_tail_of_the_rank_test(spark):
    """|z| of 1.959964 is p = 0.05."""
    df = frame(spark, {"k": "x", "v": np.arange(200.0), "period": ["pre", "post"] * 100})
    got = drift.two_sample_statistics(df, ["k"], "v", "period", "pre", "post").first()
    n1 = n2 = 100
    z = (max(got["u_statistic"], n1 * n2 - got["u_statistic"]) - 5000 - 0.5) / np.sqrt(n1 * n2 * 201 / 12)
    assert got["mann_whitney_z"] == pytest.approx(z)


def test_moments_ramps_and_autocorrelation(spark, samples):
    a, b = samples
    pdf = pd.DataFrame({"k": "x", "v": np.concatenate([a, b]), "period": ["pre"] * len(a) + ["post"] * len(b)})
    pdf["ts"] = [START + dt.timedelta(minutes=30 * i) for i in range(len(pdf))]
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = drift.characterise_shift(df, ["k"], "v", "period", "pre", "post", digits=None).first()
    for s, x in (("pre", a), ("post", b)):
        assert got[f"mean_{s}"] == pytest.approx(x.mean()) and got[f"std_{s}"] == pytest.approx(x.std())
        assert got[f"p99_{s}"] == pytest.approx(np.percentile(x, 99))
        assert got[f"mean_absolute_ramp_{s}"] == pytest.approx(np.abs(np.diff(x)).mean())
        d = x - x.mean()
        assert got[f"acf_48_{s}"] == pytest.approx((d[48:] * d[:-48]).sum() / (d * d).sum())
        assert got[f"acf_336_{s}"] is None  # min(350, 450 // 2 - 1) < 336
    assert got["mean_pct_change"] == round((b.mean() - a.mean()) / a.mean() * 100, 2)


def test_sliding_distances_against_cdf_form():
    rng = np.random.default_rng(8)
    for n, m in ((24, 5), (31, 240), (96, 31)):
        scores = np.round(rng.normal(size=260), 1)  # ties
        ref = np.round(rng.normal(size=m), 1)
        want = [np.nan if t < 23 else brute.wasserstein(scores[max(0, t + 1 - n) : t + 1], ref) for t in range(260)]
        np.testing.assert_allclose(drift.trailing_distances(scores, 0, n, 24, ref), want)
        for halo in (1, 10, n - 1):
            got = drift.trailing_distances(scores[100 - halo :], halo, n, 1, ref)
            full = drift.trailing_distances(scores, 0, n, 1, ref)[100:]
            np.testing.assert_allclose(got[n:], full[n:])
    assert np.isnan(drift.trailing_distances(np.ones(30), 0, 24, 24, np.empty(0))).all()


def detector_rows(spark, values):
    return frame(spark, {"k": "x", "pos": range(len(values)), "score": values})


def test_wasserstein_detector_flags_only_the_shift(spark):
    rng = np.random.default_rng(42)
    ref = spark.createDataFrame([("x", rng.normal(10, 2, 500).tolist())], "k string, ref_scores array<double>")
    values = np.concatenate([rng.normal(10, 2, 100), rng.normal(20, 4, 100)])
    out = drift.flag_shift(drift.wasserstein_scores(detector_rows(spark, values), ref, ["k"], window=100), 1.5)
    flags = out.toPandas().sort_values("pos")["shift_flag"].to_numpy()
    assert not flags[:100].any() and flags[-1]


def test_mean_detector(spark):
    rng = np.random.default_rng(1)
    cal = detector_rows(spark, rng.normal(0, 1, 200))
    out = drift.flag_shift(drift.mean_shift_scores(detector_rows(spark, np.full(50, 5.0)), cal, ["k"], window=50), 2.0)
    got = out.toPandas().sort_values("pos")
    assert not got["shift_flag"][:23].any() and got["shift_flag"][23:].all()
    assert (got["shift_score"][:23] == 0).all() and got["shift_score"].iloc[-1] > 2.0


# reliability

def test_subgroups_match_a_loop(spark):
    rng = np.random.default_rng(3)
    n = 700
    pdf = pd.DataFrame({"k": "a", "seq": range(n), "y": rng.uniform(0, 10, n)})
    pdf["ts"] = [START + dt.timedelta(minutes=30 * i) for i in range(n)]
    pdf["lower"], pdf["upper"] = pdf["y"] - rng.uniform(-1, 3, n), pdf["y"] + rng.uniform(-1, 3, n)
    pdf["shift_flag"] = rng.random(n) < 0.3
    pdf["horizon"] = pdf["seq"] % 48 + 1
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = reliability.conditional_reliability(df, ["k"], digits=None, chunk=64).toPandas()
    hour = pdf["ts"].dt.hour
    ramp = pdf["y"].diff().abs().fillna(0.0)
    q1, q2 = np.quantile(pdf["y"], [0.333, 0.667])
    r1, r2 = np.quantile(ramp, [0.333, 0.667])
    labels = {
        "by_hour": hour.astype(str),
        "by_peak_status": np.where(hour.between(17, 21), "Peak (17-21h)", "Off-Peak"),
        "by_day_type": np.where(pdf["ts"].dt.dayofweek >= 5, "Weekend", "Weekday"),
        "by_season": "Winter",
        "by_load_regime": pd.cut(pdf["y"], [-np.inf, q1, q2, np.inf], labels=["Low Demand", "Medium Demand", "High Demand"]),
        "by_ramp_regime": pd.cut(ramp, [-np.inf, r1, r2, np.inf], labels=["Low Ramp", "Medium Ramp", "High Ramp"]),
        "by_horizon": pdf["horizon"].astype(str),
        "by_shift_status": np.where(pdf["shift_flag"], "Shift Detected", "Normal / Low Shift"),
    }
    covered = (pdf["y"] >= pdf["lower"]) & (pdf["y"] <= pdf["upper"])
    for dimension, label in labels.items():
        want = covered.groupby(pd.Series(label, index=pdf.index).astype(str)).agg(["mean", "size"])
        own = got[got["dimension"] == dimension].set_index("subgroup")
        assert set(own.index) == set(want.index)
        np.testing.assert_allclose(own.loc[want.index, "empirical_coverage"], want["mean"])
        assert own.loc[want.index, "n_obs"].tolist() == want["size"].tolist()


# bootstrap

def daily(spark, n_days=12, keys=("a", "b")):
    rng = np.random.default_rng(4)
    rows = []
    for k in keys:
        for m in ("x", "z"):
            for d in range(n_days):
                w = rng.uniform(40, 60)
                rows.append((k, m, dt.date(2024, 1, 1 + d), 48, int(rng.integers(38, 49)), w, w + rng.uniform(0, 30)))
    return spark.createDataFrame(
        rows, "k string, method string, day date, n_obs long, n_covered long, sum_width double, sum_score double"
    )


def test_bootstrap_draws_whole_days_evenly(spark):
    counts = spark.createDataFrame([(30,)], "n_days long")
    draws = bootstrap.unpack_draws(bootstrap.day_draws(counts, 500, 42), "day_idx")
    per_b = draws.groupBy("b").agg(F.sum("times").alias("n"), F.count("*").alias("distinct")).toPandas()
    assert (per_b["n"] == 30).all() and len(per_b) == 500
    assert per_b["distinct"].mean() == pytest.approx(30 * (1 - (29 / 30) ** 30), abs=0.4)


def test_bootstrap_statistics_match_a_loop(spark):
    df = daily(spark)
    n, seed = 200, 7
    got = bootstrap.paired_bootstrap(df, ["k"], "x", "z", 0.1, n, seed, round_before_diff=False, digits=None).toPandas()
    draws = bootstrap.day_draws(spark.createDataFrame([(12,)], "n_days long"), n, seed)
    times = np.zeros((n, 12))
    for r in bootstrap.unpack_draws(draws, "day_idx").collect():
        times[r["b"], r["day_idx"]] = r["times"]
    pdf = df.toPandas().sort_values("day")
    for k in "ab":
        m = {}
        for name in "xz":
            own = pdf[(pdf["k"] == k) & (pdf["method"] == name)]
            s = {c: times @ own[c].to_numpy(float) for c in ("n_obs", "n_covered", "sum_width", "sum_score")}
            cov = s["n_covered"] / s["n_obs"]
            m[name] = {"ace": np.abs(cov - 0.9), "interval_score": s["sum_score"] / s["n_obs"],
                       "mpiw": s["sum_width"] / s["n_obs"], "empirical_coverage": cov}
        for metric in m["x"]:
            d = m["x"][metric] - m["z"][metric]
            row = got[(got["k"] == k) & (got["metric"] == metric)].iloc[0]
            lo, hi = np.percentile(d, [2.5, 97.5])
            np.testing.assert_allclose([row["mean_diff"], row["ci_lower"], row["ci_upper"]], [d.mean(), lo, hi], atol=1e-12)
            assert row["p_value"] == pytest.approx(min(1.0, 2 * min((d <= 0).mean(), (d >= 0).mean())))
            assert row["is_significant_05"] == bool(lo > 0 or hi < 0)


def test_too_few_days(spark):
    short = daily(spark, 4)
    assert bootstrap.paired_bootstrap(short, ["k"], "x", "z", n_resamples=10).first()["mean_diff"] is None
    with pytest.raises(Exception, match="Insufficient daily blocks"):
        bootstrap.paired_bootstrap(short, ["k"], "x", "z", n_resamples=10, too_short="error").collect()


def test_formatted_bootstrap(spark):
    out = bootstrap.formatted_bootstrap(bootstrap.paired_bootstrap(daily(spark), ["k"], "x", "z", n_resamples=50), ["k"])
    row = out.first()
    assert row["ci_95"].startswith("[") and row["significant"] in ("Yes", "No")


def test_degenerate_samples_give_nulls(spark):
    rows = [("one", "pre", 1.0), ("one", "pre", 2.0), ("flat", "pre", 0.0), ("flat", "post", 0.0), ("flat", "post", 0.0)]
    pdf = pd.DataFrame(rows, columns=["k", "period", "v"])
    pdf["ts"] = [START + dt.timedelta(minutes=30 * i) for i in range(len(pdf))]
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r["k"]: r for r in drift.two_sample_statistics(df, ["k"], "v", "period", "pre", "post").collect()}
    assert got["one"]["wasserstein_1d"] is None and got["one"]["mann_whitney_p_value"] is None
    assert got["flat"]["ks_statistic"] == 0.0 and got["flat"]["mann_whitney_z"] is None
    flat = {r["k"]: r for r in drift.characterise_shift(df, ["k"], "v", "period", "pre", "post").collect()}["flat"]
    assert flat["mean_pct_change"] is None and flat["acf_48_pre"] is None
