import datetime as dt

import pytest
from pyspark.sql import functions as F

from loadshape.operators import audit, cleaning, cohorts
from loadshape.sources import readings as source
from loadshape.sources import sinks

T0 = dt.datetime(2012, 1, 1)


@pytest.fixture(scope="module")
def raw(spark):
    rows = [
        ("A", T0, 1.0, "ToU"),
        ("A", T0, 2.0, "ToU"),
        ("A", T0 + dt.timedelta(days=100), None, "ToU"),
        ("B", T0, -5.0, "Std"),
        ("B", T0 + dt.timedelta(days=91), 99.0, "Std"),
        ("C", T0, 3.0, "Std"),
        (None, T0, 1.0, None),
        ("C", None, 1.0, "Std"),
    ]
    return spark.createDataFrame(rows, "household_id string, timestamp timestamp_ntz, energy_kwh double, tariff_group string")


def test_first_per_key_prefers_values_over_nulls(spark):
    df = spark.createDataFrame(
        [("A", T0, None), ("A", T0, 4.0), ("A", T0, 2.0)], "household_id string, timestamp timestamp_ntz, energy_kwh double"
    )
    assert cleaning.first_per_key(df).first()["energy_kwh"] == 2.0


def test_hot_duplicate_key_is_reduced_before_the_shuffle(spark):
    df = spark.range(50_000).select(
        F.lit("A").alias("household_id"), F.lit(T0).alias("timestamp"), F.col("id").cast("double").alias("energy_kwh")
    )
    out = cleaning.first_per_key(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan
    assert out.collect()[0]["energy_kwh"] == 0.0


def test_clean_readings(raw):
    got = {(r["household_id"], r["timestamp"]): r["energy_kwh"] for r in cleaning.clean_readings(raw).collect()}
    later = T0 + dt.timedelta(days=100)
    assert got == {("A", T0): 1.0, ("A", later): 0.0, ("B", T0): 0.0, ("B", T0 + dt.timedelta(days=91)): 50.0}


def test_missing_ratio_can_be_enforced(raw):
    ids = {r[0] for r in cleaning.clean_readings(raw, max_missing_ratio=0.1).select("household_id").collect()}
    assert ids == {"B"}


def test_nan_energy_stays_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (-1.0,)], "energy_kwh double")
    values = [r[0] for r in cleaning.fill_and_clip(df).collect()]
    assert values[0] != values[0] and values[1:] == [0.0, 0.0]


def test_sample_is_repeatable_and_bounded(spark):
    df = spark.range(1000).select(F.concat(F.lit("M"), "id").alias("household_id"))
    a = cleaning.sample_households(df, 50, 42).collect()
    b = cleaning.sample_households(df.repartition(7), 50, 42).collect()
    assert sorted(a) == sorted(b) and len(set(a)) == 50
    assert cleaning.sample_households(df.limit(10), 50).count() == 10


def test_audit(raw):
    t = audit.totals(raw).first()
    assert (t["total_records"], t["null_energy_count"], t["null_timestamp_count"]) == (8, 1, 1)
    assert (t["negative_count"], t["extreme_count"], t["customer_count"]) == (1, 1, 4)
    assert audit.duplicate_count(raw).first()[0] == 1
    assert {r["tariff_group"]: r["records"] for r in audit.tariff_counts(raw).collect()} == {"ToU": 3, "Std": 4, None: 1}
    e = audit.exclusion_summary(raw).first()
    assert (e["insufficient_history"], e["high_missingness"], e["total_excluded"], e["total_retained"]) == (1, 1, 2, 1)
    assert [r[0] for r in audit.retained_households(raw).collect()] == ["B"]


def test_cohort_load(spark):
    df = spark.createDataFrame(
        [("A", T0, 1.0, "dToU"), ("B", T0, 3.0, "STD"), ("C", T0, 5.0, None), ("D", T0, 7.0, "xDYNAMIC")],
        "household_id string, timestamp timestamp_ntz, energy_kwh double, tariff_group string",
    )
    got = {r["cohort"]: r for r in cohorts.cohort_load(df).collect()}
    assert {c: r["load_kwh"] for c, r in got.items()} == {"total_population": 16.0, "dtou": 8.0, "standard": 3.0}
    assert got["dtou"]["active_households"] == 2
    assert got["dtou"]["load_std_kwh"] == pytest.approx(18**0.5)
    assert got["standard"]["load_std_kwh"] is None


def test_histogram_density_integrates_to_one(spark):
    df = spark.range(1000).select(F.lit("x").alias("k"), F.sqrt("id").alias("load_kwh"), F.col("id").alias("ts"))
    rows = cohorts.density_histogram(df, ["k"], bins=35).orderBy("bin").collect()
    width = rows[1]["bin_start"] - rows[0]["bin_start"]
    assert len(rows) == 35 and sum(r["n"] for r in rows) == 1000
    assert sum(r["density"] for r in rows) * width == pytest.approx(1.0)


def test_column_mapping(spark):
    df = spark.createDataFrame([("1", "2012-01-01 00:30:00", "Null"), ("2", "bad", "0.5")],
                               ["LCLid", "DateTime", "KWH/hh (per half hour)"])
    out = source.map_columns(df)
    assert out.columns == ["household_id", "timestamp", "energy_kwh"]
    assert [tuple(r) for r in out.collect()] == [("1", dt.datetime(2012, 1, 1, 0, 30), None), ("2", None, 0.5)]
    with pytest.raises(ValueError, match="timestamp"):
        source.map_columns(df.drop("DateTime"))


def test_first_alias_wins(spark):
    df = spark.createDataFrame([("new", "old", "2012-01-01", 1.0)], ["LCLid", "household_id_2", "timestamp", "kwh"])
    assert source.map_columns(df).first()["household_id"] == "new"


def test_csv_round_trip_with_ragged_rows(spark, tmp_path):
    path = tmp_path / "block.csv"
    path.write_text("LCLid,DateTime,energy(kWh/hh)\nA,2012-01-01 00:00:00,0.1\nB,2012-01-01 00:30:00\nC,x,Null,extra\n")
    rows = [tuple(r) for r in source.read_readings(spark, str(path)).orderBy("household_id").collect()]
    assert rows == [("A", T0, 0.1), ("B", dt.datetime(2012, 1, 1, 0, 30), None), ("C", None, None)]
    with pytest.raises(ValueError, match="unsupported"):
        source.read_readings(spark, str(tmp_path / "x.xls"))


def test_series_sink_writes_only_present_cohorts(spark, tmp_path):
    df = spark.createDataFrame([("dtou", T0, 1.0)], "cohort string, ts timestamp_ntz, load_kwh double")
    sinks.write_series(df, str(tmp_path / "out"))
    assert [p.name for p in (tmp_path / "out").glob("cohort=*")] == ["cohort=dtou"]


def test_null_keys_are_kept(spark):
    from loadshape.operators.ordering import lookup

    df = spark.createDataFrame([(None, 1.0), ("a", 2.0), ("a", None)], "k string, v double")
    table = spark.createDataFrame([(None, 10.0), ("a", 20.0)], "k string, w double")
    assert sorted((r.k or "", r.w) for r in lookup(df, table, ["k"]).collect()) == [("", 10.0), ("a", 20.0), ("a", 20.0)]
    households = spark.createDataFrame([(None,)], "household_id string")
    readings = spark.createDataFrame([(None, 1), ("h", 2)], "household_id string, timestamp int")
    assert [r.timestamp for r in cleaning.keep_households(readings, households).collect()] == [1]
