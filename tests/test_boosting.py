import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadshape.operators import boosting as B

FEATURES = ["a", "b", "c"]
SHAPE = {"max_depth": 3, "min_leaf": 5}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    n = 500
    pdf = pd.DataFrame(rng.uniform(-2, 2, (n, 3)), columns=FEATURES)
    pdf["k"] = np.where(rng.random(n) < 0.6, "x", "y")
    pdf["t"] = 10 + np.where(pdf["k"] == "x", 4.0, -2.0) * (pdf["a"] > 0.3) + pdf["b"] ** 2 + rng.normal(0, 0.3, n)
    return pdf, spark.createDataFrame(pdf).repartition(6)


def best_split(x, g, min_leaf):
    """The least squared error over all features and cuts between neighbouring values."""
    best = (np.inf, None, None)
    for j in range(x.shape[1]):
        for v in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= v
            if min_leaf <= left.sum() <= len(g) - min_leaf:
                error = ((g[left] - g[left].mean()) ** 2).sum() + ((g[~left] - g[~left].mean()) ** 2).sum()
                best = min(best, (error, j, v))
    return best


def test_splits_are_the_best_of_all(rows):
    pdf, _ = rows
    x, y = pdf[FEATURES].to_numpy()[:120], pdf["t"].to_numpy()[:120]
    start, features, thresholds, values = B.boost(x, y, None, 1, 2, 1.0, 8)
    assert start == pytest.approx(y.mean())
    _, j, v = best_split(x, y - y.mean(), 8)
    assert features[0][0] == j and v <= thresholds[0][0] < x[x[:, j] > v, j].min()
    right = x[:, j] > thresholds[0][0]
    for side, node, leaves in ((~right, 1, (0, 1)), (right, 2, (2, 3))):
        _, j2, v2 = best_split(x[side], (y - y.mean())[side], 8)
        assert features[0][node] == j2
        under = x[:, j2] > thresholds[0][node]
        for leaf, part in zip(leaves, (side & ~under, side & under)):
            assert part.sum() >= 8 and values[0][leaf] == pytest.approx((y - y.mean())[part].mean())


def test_constant_features_and_few_rows_make_no_split():
    start, features, thresholds, values = B.boost(np.ones((30, 2)), np.arange(30.0), None, 2, 3, 0.5, 5)
    assert (features == -1).all() and np.isinf(thresholds).all()
    np.testing.assert_allclose(B.evaluate(np.zeros((4, 2)), start, features, thresholds, values), 14.5)
    assert (B.boost(np.arange(6.0)[:, None], np.arange(6.0), None, 1, 2, 1.0, 4)[1] == -1).all()


def test_many_values_are_cut_at_quantiles():
    x = np.random.default_rng(0).normal(size=5000)
    edges = B.bin_edges(x)
    assert len(edges) == B.MAX_BINS - 1 and (np.diff(edges) > 0).all()
    assert np.bincount(np.searchsorted(edges, x)).max() < 40


def test_leaf_quantiles_are_exact():
    rng = np.random.default_rng(4)
    leaf, r = rng.integers(0, 5, 200), rng.normal(size=200)
    leaf[leaf == 3] = 4
    got = B.leaf_quantiles(r, leaf, 6, 0.3)
    np.testing.assert_allclose(got, [np.quantile(r[leaf == k], 0.3) if (leaf == k).any() else 0.0 for k in range(6)])


def test_a_model_per_series_and_its_predictions(rows, spark):
    pdf, df = rows
    fitted = B.boosted_fit(df, ["k"], FEATURES, "t", rounds=40, **SHAPE)
    assert {r["k"]: r["n_rows"] for r in fitted.collect()} == pdf.groupby("k").size().to_dict()
    extra = spark.createDataFrame([(None, 1.0, 1.0, "x", 0.0), (1.0, 1.0, 1.0, "new", 0.0)], "a double, b double, c double, k string, t double")
    got = B.boosted_predict(df.unionByName(extra), fitted, ["k"], FEATURES, max_depth=3).toPandas()
    assert len(got) == len(pdf) + 2 and got["y_pred"].isna().sum() == 2
    ok = got[got["y_pred"].notna()]
    for k, own in ok.groupby("k"):
        assert ((own["t"] - own["y_pred"]) ** 2).mean() < 0.15 * own["t"].var()
        # what the table holds is the model that the rows of the series alone give
        part = pdf[pdf["k"] == k]
        order = np.lexsort((*part[FEATURES].to_numpy().T, part["t"]))
        model = B.boost(part[FEATURES].to_numpy()[order], part["t"].to_numpy()[order], None, 40, 3, 0.05, 5)
        want = np.maximum(0.0, B.evaluate(own[FEATURES].to_numpy(), *model))
        np.testing.assert_allclose(own["y_pred"], want)


def test_partitioning_and_pieces_change_nothing(rows, monkeypatch):
    _, df = rows
    want = B.boosted_predict(df, B.boosted_fit(df, ["k"], FEATURES, "t", rounds=5, **SHAPE), ["k"], FEATURES, max_depth=3)
    want = sorted(tuple(r) for r in want.collect())
    monkeypatch.setattr(B, "ROWS", 20)
    again = df.repartition(2)
    got = B.boosted_predict(again, B.boosted_fit(again, ["k"], FEATURES, "t", rounds=5, **SHAPE), ["k"], FEATURES, max_depth=3)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_quantile_levels_are_ordered_and_hold_their_shares(rows):
    _, df = rows
    levels = {"lo": 0.1, "mid": 0.5, "hi": 0.9}
    fitted = B.boosted_fit(df, ["k"], FEATURES, "t", levels, rounds=60, **SHAPE)
    out = B.boosted_predict(df, fitted, ["k"], FEATURES, list(levels), max_depth=3)
    share = out.agg(*[F.avg((F.col("t") <= F.col(n)).cast("double")).alias(n) for n in levels]).first()
    assert out.where("lo > mid OR mid > hi OR lo < 0").count() == 0
    for n, level in levels.items():
        assert share[n] == pytest.approx(level, abs=0.07)
    flat = df.agg(*[F.percentile("t", level).alias(n) for n, level in levels.items()]).first()
    for n, level in levels.items():
        loss = lambda q: F.avg(F.greatest(level * (F.col("t") - q), (level - 1) * (F.col("t") - q)))
        both = out.agg(loss(F.col(n)).alias("own"), loss(F.lit(flat[n])).alias("flat")).first()
        assert both["own"] < 0.7 * both["flat"]
