import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadshape.operators import models as M


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    n = 600
    x = rng.normal(size=(n, 5))
    pdf = pd.DataFrame(x, columns=[f"f_{i}" for i in range(5)])
    pdf["k"] = np.where(rng.random(n) < 0.7, "a", "b")
    pdf["y"] = 20 + 2 * pdf["f_0"] - pdf["f_3"] + rng.normal(0, 0.5, n) + np.where(pdf["k"] == "a", 0, 5)
    pdf["ts"] = range(n)
    return pdf, spark.createDataFrame(pdf).repartition(5)


FEATURES = [f"f_{i}" for i in range(5)]


def test_seasonal_naive(spark):
    df = spark.createDataFrame([(5.0, 7.0), (None, -1.0), (float("nan"), 2.0)], "load_lag_48 double, load_lag_336 double")
    out = df.select(M.seasonal_naive(df.columns).alias("d"), M.seasonal_naive(df.columns, 336).alias("w")).collect()
    assert [tuple(r) for r in out] == [(5.0, 7.0), (0.0, 0.0), (0.0, 2.0)]
    assert "load_lag_48" in str(M.seasonal_naive(["load_lag_48"], 336))
    with pytest.raises(ValueError):
        M.seasonal_naive(["x"])


def test_ridge_matches_closed_form_per_series(rows):
    pdf, df = rows
    got = {r["k"]: r for r in M.ridge_fit(df, ["k"], FEATURES, "y", 3.0).collect()}
    for k, part in pdf.groupby("k"):
        x, y = part[FEATURES].to_numpy(), part["y"].to_numpy()
        xc, yc = x - x.mean(0), y - y.mean()
        beta = np.linalg.solve(xc.T @ xc + 3.0 * np.eye(5), xc.T @ yc)
        np.testing.assert_allclose(got[k]["coefficients"], beta)
        assert got[k]["intercept"] == pytest.approx(y.mean() - x.mean(0) @ beta)
        assert got[k]["n_rows"] == len(part)


def test_ridge_predictions_are_clamped(rows):
    pdf, df = rows
    fitted = M.ridge_fit(df, ["k"], FEATURES, "y")
    out = M.ridge_predict(df.withColumn("f_0", F.col("f_0") * 100), fitted, ["k"], FEATURES)
    assert out.count() == len(pdf) and out.agg(F.min("y_pred")).first()[0] == 0.0


def test_boosted_trees_beat_the_mean(rows):
    _, df = rows
    model = M.boosted_trees_fit(df, FEATURES, "y", max_iter=5, max_depth=4)
    out = M.boosted_trees_predict(df, model, FEATURES).agg(
        F.avg(F.pow(F.col("y") - F.col("y_pred"), 2)).alias("mse"), F.var_pop("y").alias("var"), F.min("y_pred").alias("lo")
    ).first()
    assert out["mse"] < 0.6 * out["var"] and out["lo"] >= 0


def test_quantile_forest_is_ordered_and_covers(rows):
    _, df = rows
    fitted = M.quantile_forest_fit(df, FEATURES, "y", num_trees=5, max_depth=3)
    out = M.quantile_forest_predict(df, fitted, FEATURES).toPandas()
    assert (out["q_lo"] <= out["q_mid"]).all() and (out["q_mid"] <= out["q_hi"]).all()
    assert ((out["y"] >= out["q_lo"]) & (out["y"] <= out["q_hi"])).mean() > 0.8


def test_levels():
    assert M.nearest_levels(M.QUANTILES, 0.12) == ("q_lo", "q_mid", "q_hi")
    assert M.outer_levels({"m": 0.5, "h": 0.95, "l": 0.05}) == ("l", "h")
    assert M.primary_model(["ridge", "hist_gradient_boosting"]) == "hist_gradient_boosting"
    assert M.primary_model(["ridge"]) == "ridge"


def test_rows_without_a_feature_are_kept_without_a_prediction(spark):
    rows = [(float(i), float(i % 3), 2.0 * i) for i in range(80)] + [(None, 1.0, 1.0), (3.0, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    trees = M.boosted_trees_predict(df, M.boosted_trees_fit(df, ["a", "b"], "y", max_iter=2, min_leaf=1), ["a", "b"])
    assert trees.count() == 82 and trees.where("y_pred IS NULL").count() == 2
    forest = M.quantile_forest_predict(df, M.quantile_forest_fit(df, ["a", "b"], "y", num_trees=2, min_leaf=1), ["a", "b"])
    assert forest.count() == 82 and forest.where("q_mid IS NULL").count() == 2


def test_ridge_far_from_zero_and_with_missing_values(spark):
    rng = np.random.default_rng(5)
    x = 1e8 + rng.normal(size=(400, 2)) * [3.0, 0.5]
    y = 3 * (x[:, 0] - 1e8) - 2 * (x[:, 1] - 1e8) + rng.normal(size=400)
    rows = [("a", float(a), float(b), float(c)) for (a, b), c in zip(x, y)]
    odd = [("a", None, 1.0, 1.0), ("a", 1.0, float("nan"), 1.0), ("a", 1.0, 1.0, None), ("none", None, 1.0, 1.0), (None, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows + odd, "k string, u double, v double, y double").repartition(7)
    got = {r["k"]: r for r in M.ridge_fit(df, ["k"], ["u", "v"], "y", 2.0).collect()}
    xc, yc = x - x.mean(0), y - y.mean()
    np.testing.assert_allclose(got["a"]["coefficients"], np.linalg.solve(xc.T @ xc + 2 * np.eye(2), xc.T @ yc), rtol=1e-6)
    assert got["a"]["n_rows"] == 400 and set(got) == {"a", None} and got[None]["coefficients"] == [0.0, 0.0]
    out = M.ridge_predict(df, M.ridge_fit(df, ["k"], ["u", "v"], "y", 2.0), ["k"], ["u", "v"]).collect()
    assert len(out) == 405
    assert [r["y_pred"] for r in out if r["u"] is None or np.isnan(r["v"])] == [None] * 3


def test_moments_merge_in_any_order():
    rng = np.random.default_rng(2)
    z = rng.normal(size=(90, 3)) + 1e6
    a, b, c = (M.moments_of(p) for p in (z[:1], z[1:40], z[40:]))
    n, mean, cross = M.merge_moments(M.merge_moments(a, b), c)
    np.testing.assert_allclose(mean, z.mean(0))
    np.testing.assert_allclose(cross, (z - z.mean(0)).T @ (z - z.mean(0)), atol=1e-6)
    assert n == 90
