"""The given tables seen as meter readings, cohort series and forecasts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadshape.operators.adaptive import ShiftAwareVariant
from loadshape.operators.cohorts import cohort_load, tariff_cohorts
from loadshape.operators.features import lag_features, regularise
from loadshape.operators.models import add_seasonal_naive, seasonal_quantile_fit, seasonal_quantile_predict
from loadshape.operators.splits import tag_splits
from loadshape.plans.backtest import BacktestSettings
from loadshape.session import cut_lineage

#: Splits as thirtieths of the days that the readings span: with 30 days, train is days 7 to 16.
CUTS = {"train": (7, 17), "calibration": (17, 22), "validation": (22, 24), "test": (24, 30)}
PER_SPLIT_CUTS = {"train": (0, 13), "calibration": (13, 19), "validation": (19, 23), "test": (23, 30)}
KEYS = ["cohort"]
SETTINGS = BacktestSettings(
    rolling_window=240, detector_window=96, reference_length=240, sa_acp=ShiftAwareVariant(threshold=0.15)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def household() -> F.Column:
    return F.concat(F.lit("MAC"), F.lpad(F.col("user_id").cast("string"), 6, "0"))


def tariff() -> F.Column:
    return F.when(F.col("user_id") % 3 == 0, "dToU").otherwise("Std")


def acorn() -> F.Column:
    kind = F.col("user_id") % 3
    return F.when(kind == 0, "Affluent").when(kind == 1, "Comfortable").otherwise("Adversity")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean readings at their raw times."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        household().alias("household_id"),
        F.col("ts").alias("timestamp"),
        (F.col("value") / 100).alias("energy_kwh"),
        tariff().alias("tariff_group"),
        acorn().alias("acorn_group"),
    )


def dirty_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with NULLs, negatives, spikes, missing times and duplicate keys."""
    e = table(spark, sf_dir, "events")
    value = F.col("value") / 100
    energy = (
        F.when(F.col("event_type") == "error", F.lit(None))
        .when(F.col("event_id") % 97 == 0, -value)
        .when(F.col("event_id") % 89 == 0, value * 1000)
        .otherwise(value)
    )
    base = e.select(
        "event_id",
        household().alias("household_id"),
        F.when(F.col("event_id") % 101 != 0, F.col("ts")).alias("timestamp"),
        energy.alias("energy_kwh"),
        tariff().alias("tariff_group"),
    )
    copies = base.where("event_id % 50 = 0").withColumn("energy_kwh", F.col("energy_kwh") + 1)
    return base.unionByName(copies)


def halfhour_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reading per household and half-hour."""
    r = readings(spark, sf_dir)
    slot = F.window("timestamp", "30 minutes")["start"]
    return r.groupBy("household_id", "tariff_group", "acorn_group", slot.alias("timestamp")).agg(
        F.sum("energy_kwh").alias("energy_kwh")
    )


def series_and_ranges(spark: SparkSession, sf_dir: str, cuts=CUTS) -> tuple[DataFrame, dict[str, tuple[str, str]]]:
    """(cohort, ts, load_kwh, seq) on the half-hour grid of all days there are, 0 where nothing was metered; and splits.

    The readings are read once, for the load per cohort and half-hour; days and splits come from that small table.
    """
    r = readings(spark, sf_dir).withColumn("slot", F.window("timestamp", "30 minutes")["start"])
    load = cut_lineage(cohort_load(r, ts="slot").select("cohort", "ts", "load_kwh"), "load")
    begin, end = load.agg(F.min("ts"), F.max("ts")).first()
    first, days = begin.date(), (end.date() - begin.date()).days + 1
    day = lambda k: first + dt.timedelta(days * k // 30)
    ranges = {name: (str(day(a)), str(day(b) - dt.timedelta(1))) for name, (a, b) in cuts.items()}
    grid = f"{first} 00:00:00", f"{day(30) - dt.timedelta(1)} 23:30:00"
    names = spark.createDataFrame([(c,) for c in tariff_cohorts()], "cohort string")
    return regularise(load, KEYS, 30, fill="zero", start=grid[0], end=grid[1], series=names), ranges


def cohort_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_and_ranges(spark, sf_dir)[0]


def typed_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-hourly value per event type, only the occupied half-hours."""
    e = table(spark, sf_dir, "events")
    slot = F.window("ts", "30 minutes")["start"]
    return e.groupBy("event_type", slot.alias("slot")).agg(F.sum("value").alias("load_kwh")).select(
        "event_type", F.col("slot").alias("ts"), "load_kwh"
    )


def split_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_splits(*series_and_ranges(spark, sf_dir))


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasonal naive points and seasonal empirical quantiles for every split row."""
    series, ranges = series_and_ranges(spark, sf_dir)
    lagged = lag_features(series, KEYS, lags=(48, 336), rolling=False)
    rows = tag_splits(lagged.dropna(subset=["load_lag_336"]), ranges)
    points = add_seasonal_naive(rows).select(
        "cohort", "ts", "seq", "split", F.col("load_kwh").alias("y"), "y_pred"
    )
    points = cut_lineage(points, "points")  # read by the quantile fit, and by all that use the forecasts
    fitted = seasonal_quantile_fit(points.where("split = 'train'"), KEYS, "y")
    return seasonal_quantile_predict(points, fitted, KEYS)


def unsettled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forecasts of calibration and test, of which every fifth hour has no outcome yet, nor the third test day."""
    hours = F.dayofmonth("ts") * 24 + F.hour("ts")
    rows = forecasts(spark, sf_dir).where("split in ('calibration', 'test')")
    third = rows.where("split = 'test'").agg(F.date_add(F.min(F.to_date("ts")), 2)).first()[0]
    missing = (F.pmod(hours, F.lit(5)) == 0) | (F.to_date("ts") == F.lit(str(third)).cast("date"))
    return rows.withColumn("y", F.when(~missing, F.col("y")))


def daily_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long series: quantity shipped per day by four groups of suppliers, the day before as forecast, a band around it.

    The first six tenths of a series are calibration, the rest is test.
    """
    li = table(spark, sf_dir, "lineitem")
    shipped = li.groupBy(
        F.concat(F.lit("g"), (F.col("l_suppkey") % 4).cast("string")).alias("cohort"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts")
    ).agg(F.sum("l_quantity").cast("double").alias("y"))
    series = cut_lineage(regularise(shipped, KEYS, 1440, value="y", fill="zero"), "daily")
    lagged = lag_features(series, KEYS, "y", horizon=1, lags=(1,), rolling=False).withColumnRenamed("load_lag_1", "y_pred")
    length = series.groupBy(*KEYS).agg(F.count("*").alias("n"))
    rows = lagged.join(length, KEYS).where("y_pred IS NOT NULL")
    split = F.when(F.col("seq") * 10 < F.col("n") * 6, "calibration").otherwise("test")
    return rows.select(
        "cohort", "ts", "seq", split.alias("split"), "y", "y_pred", (F.col("y_pred") * 0.75).alias("q_lo"), (F.col("y_pred") * 1.25).alias("q_hi")
    )
