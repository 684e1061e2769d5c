import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadshape.operators import conformal, reliability
from loadshape.operators import ordering as O

START = dt.datetime(2024, 1, 20)


def irregular(spark, n=3000, seed=0):
    rng = np.random.default_rng(seed)
    steps = np.sort(rng.choice(10 * n, size=n, replace=False))
    pdf = pd.DataFrame(
        {"k": np.where(rng.random(n) < 0.6, "hot", "cold"), "step": steps, "v": rng.integers(0, 400, n) / 7.0}
    )
    pdf["ts"] = [START + dt.timedelta(minutes=30 * int(s)) for s in steps]
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return pdf, df


def test_positions_across_months(spark):
    pdf, df = irregular(spark)
    got = O.positions(df, ["k"]).toPandas().sort_values(["k", "ts"])
    want = pdf.sort_values(["k", "ts"]).groupby("k").cumcount()
    assert got["seq"].tolist() == want.tolist()


def test_grid_positions(spark):
    _, df = irregular(spark, 200)
    got = O.grid_positions(df, "2024-01-20", 30)
    assert got.where("seq != step").count() == 0


@pytest.mark.parametrize("chunk", [1, 50, 512, 100_000])
def test_chunked_lag_equals_plain_lag(spark, chunk):
    pdf, df = irregular(spark)
    numbered = O.positions(df, ["k"])
    w = O.chunk_window(["k"])
    got = O.unchunk(
        O.chunked(numbered, 30, "seq", chunk)
        .withColumn("lag", F.lag("v", 30).over(w))
        .withColumn("mean", F.avg("v").over(w.rowsBetween(-30, 0)))
    )
    got = got.toPandas().sort_values(["k", "ts"]).reset_index(drop=True)
    ordered = pdf.sort_values(["k", "ts"]).reset_index(drop=True)
    want = ordered.groupby("k")["v"].shift(30)
    mean = ordered.groupby("k")["v"].rolling(31, min_periods=1).mean().reset_index(drop=True)
    assert len(got) == len(pdf)
    np.testing.assert_allclose(got["lag"], want)
    np.testing.assert_allclose(got["mean"], mean)


def test_chunk_windows_stay_small(spark):
    _, df = irregular(spark)
    parts = O.chunked(O.positions(df, ["k"]), 30, "seq", 100)
    assert parts.groupBy("k", "_chunk").count().agg(F.max("count")).first()[0] <= 130


def test_lookup_keeps_every_row_once(spark):
    _, df = irregular(spark)
    sizes = df.groupBy("k").count()
    joined = O.lookup(df, sizes, ["k"])
    assert joined.count() == 3000
    assert joined.where("count is null").count() == 0


@pytest.mark.parametrize("accuracy", [O.ACCURACY, 100])
def test_quantiles_match_numpy(spark, accuracy, monkeypatch):
    monkeypatch.setattr(O, "ACCURACY", accuracy)
    monkeypatch.setattr(O, "MARGIN", 4 / accuracy)
    pdf, df = irregular(spark)
    levels = {"a": 0.0, "b": 0.333, "c": 0.5, "d": 0.99, "e": 1.0}
    got = O.exact_quantiles(df, ["k"], "v", levels).toPandas().set_index("k")
    for k, part in pdf.groupby("k"):
        np.testing.assert_allclose(got.loc[k, list(levels)].astype(float), np.quantile(part["v"], list(levels.values())))


def test_sliced_groups_really_are_sliced(spark):
    """Continuous values, so that a hot group has far more values than slices."""
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=20_000), 1000 + rng.normal(size=5)])
    df = spark.createDataFrame(pd.DataFrame({"k": "x", "v": values}))
    ranked = O.ranked_values(df, ["k"], "v", hot_min=100).toPandas().sort_values("value")
    assert ranked["cum_n"].tolist() == list(range(1, len(values) + 1))
    assert (ranked["total_n"] == len(values)).all()
    np.testing.assert_array_equal(ranked["next_value"].to_numpy()[:-1], ranked["value"].to_numpy()[1:])
    assert np.isnan(ranked["next_value"].iloc[-1])


def test_levels_may_depend_on_the_size(spark, monkeypatch):
    pdf, df = irregular(spark)
    levels = {"a": 0.25, "b": lambda n: F.least(F.lit(1.0), F.ceil((n + 1) * 0.9) / n)}
    for accuracy in (O.ACCURACY, 100):
        monkeypatch.setattr(O, "ACCURACY", accuracy)
        monkeypatch.setattr(O, "MARGIN", 4 / accuracy)
        for row in O.exact_quantiles(df, ["k"], "v", levels).collect():
            v = pdf[pdf["k"] == row["k"]]["v"]
            assert row["a"] == pytest.approx(np.quantile(v, 0.25))
            assert row["b"] == pytest.approx(np.quantile(v, min(1.0, np.ceil((len(v) + 1) * 0.9) / len(v))))


def test_quantiles_of_a_large_group(spark):
    df = spark.range(200_000).select(F.lit(None).cast("string").alias("k"), (F.col("id") * 7919 % 200_003).alias("v"))
    want = np.quantile(np.arange(200_000) * 7919 % 200_003, [0.5, 0.99])
    row = O.exact_quantiles(df, ["k"], "v", {"m": 0.5, "t": 0.99}).first()
    assert [row["m"], row["t"]] == pytest.approx(list(want))


def test_quantiles_ignore_nulls_and_merge_ties(spark):
    df = spark.createDataFrame([("a", None), ("a", 1.0), ("a", 1.0), ("a", 3.0)], "k string, v double")
    got = O.exact_quantiles(df, ["k"], "v", {"m": 0.5}, count="n").first()
    assert (got["m"], got["n"]) == (1.0, 3)


def test_partition_count_does_not_matter(spark):
    _, df = irregular(spark)
    results = [
        O.exact_quantiles(df.repartition(n), ["k"], "v", {"m": 0.37}).orderBy("k").collect() for n in (1, 8)
    ]
    assert results[0] == results[1]


@pytest.fixture
def small_broadcasts(spark):
    """A megabyte of rows counts as large, a table of a few groups as small; far more partitions than groups."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "100KB", "spark.sql.shuffle.partitions": "64"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_rows_of_few_large_groups_are_not_sorted_to_meet_their_brackets(spark, small_broadcasts):
    size = 300_000
    df = spark.range(size).select((F.col("id") % 2).alias("k"), (F.col("id") * 7919 % 300_007).cast("double").alias("v"))
    levels = {"m": 0.5, "c": lambda n: F.least(F.lit(1.0), F.ceil((n + 1) * 0.9) / n)}
    got = O.exact_quantiles(df, ["k"], "v", levels)
    assert "SortMergeJoin" not in final_plan(got)
    values = np.arange(size) * 7919 % 300_007
    for row in got.collect():
        v = values[row["k"]::2]
        assert [row["m"], row["c"]] == pytest.approx([np.quantile(v, 0.5), np.quantile(v, np.ceil((len(v) + 1) * 0.9) / len(v))])


def test_quantiles_of_no_rows(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert O.exact_quantiles(empty, ["k"], "v", {"m": 0.5, "c": lambda n: F.lit(0.3)}).collect() == []


def test_rows_of_few_large_groups_get_their_quantiles_where_they_are(spark, small_broadcasts):
    """Neither sorted nor shuffled: a shuffle by a key of two values would make two tasks of all rows."""
    df = spark.range(300_000).select(
        "id", (F.col("id") % 2).alias("k"), (F.col("id") * 7919 % 300_007).cast("double").alias("y"), F.lit(0.0).alias("y_pred")
    )
    labelled = reliability.add_regime(df, ["k"], "y", "regime", ("Low", "Medium", "High"))
    assert "hashpartitioning" not in final_plan(labelled)
    got, pdf = labelled.toPandas().sort_values("id"), df.toPandas()
    cuts = pdf.groupby("k")["y"].quantile([0.333, 0.667]).unstack()
    low, high = (pdf["k"].map(cuts[x]) for x in (0.333, 0.667))
    want = np.where(pdf["y"] <= low, "Low", np.where(pdf["y"] <= high, "Medium", "High"))
    assert got["regime"].tolist() == want.tolist()
    assert "hashpartitioning" not in final_plan(conformal.static_intervals(df, df, ["k"]))
