"""Registered queries: name -> (spark, sf_dir) -> DataFrame, over whole tables."""

from __future__ import annotations

import itertools
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.views import (
    KEYS,
    PER_SPLIT_CUTS,
    SETTINGS,
    cohort_series,
    daily_forecasts,
    dirty_readings,
    forecasts,
    halfhour_readings,
    readings,
    series_and_ranges,
    split_series,
    table,
    typed_series,
    unsettled,
)
from loadshape.functions import columns as C
from loadshape.operators import adaptive, audit, boosting, bootstrap, cleaning, cohorts, conformal, drift, features
from loadshape.operators import metrics, models, ordering, reliability, splits
from loadshape.plans import ablation, backtest, experiment
from loadshape.session import cut_lineage, fresh_path
from loadshape.sources import readings as source
from loadshape.sources import sinks
from loadshape.streaming import calibrator
from loadshape.streaming import ingest as stream

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def r(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) for n in names})


def single(df: DataFrame, *names: str) -> DataFrame:
    """To single precision: unlike decimal rounding it has no ties at means of decimal values."""
    return df.withColumns({n: F.round(F.col(n).cast("double"), 12).cast("float").cast("double") for n in names})


# sources and sinks ------------------------------------------------------------

RAW_NAMES = {
    "household_id": "LCLid",
    "timestamp": "DateTime",
    "energy_kwh": "KWH/hh (per half hour)",
    "tariff_group": "stdorToU",
}


def raw_text(spark, sf) -> DataFrame:
    """Dirty readings as the raw files have them: text, 'Null' for missing energy."""
    d = dirty_readings(spark, sf)
    return d.select(
        F.col("household_id").alias("LCLid"),
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("DateTime"),
        F.coalesce(F.col("energy_kwh").cast("string"), F.lit("Null")).alias("KWH/hh (per half hour)"),
        F.col("tariff_group").alias("stdorToU"),
    )


def per_household(df: DataFrame) -> DataFrame:
    return r(
        df.groupBy("household_id", "tariff_group").agg(
            F.count("*").alias("n_rows"),
            F.count("timestamp").alias("n_times"),
            F.min("timestamp").alias("first_ts"),
            F.max("timestamp").alias("last_ts"),
            F.count("energy_kwh").alias("n_energy"),
            F.sum("energy_kwh").alias("total_kwh"),
        ),
        4, "total_kwh",
    )


@query
def source_csv_mapped(spark, sf):
    path = fresh_path(spark, "raw-csv")
    sinks.write_csv(raw_text(spark, sf), path)
    return per_household(source.read_readings(spark, path, "csv"))


@query
def source_parquet_mapped(spark, sf):
    aliases = {"household_id": ["LCLid", "user_id"], "timestamp": ["DateTime", "ts"], "energy_kwh": ["kwh", "value"]}
    df = source.read_readings(spark, f"{sf}/events.parquet", aliases=aliases)
    return r(
        df.groupBy("household_id").agg(
            F.count("*").alias("n_rows"), F.min("timestamp").alias("first_ts"), F.sum("energy_kwh").alias("total")
        ),
        4, "total",
    )


@query
def source_tolerant_casts(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("LCLid"),
        F.when(F.col("event_id") % 11 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("DateTime"),
        F.when(F.col("event_id") % 7 == 0, "Null").otherwise(F.col("value").cast("string")).alias("energy(kWh/hh)"),
    )
    return r(
        source.map_columns(e).groupBy("household_id").agg(
            F.count("*").alias("n_rows"),
            F.count("timestamp").alias("n_times"),
            F.max("timestamp").alias("last_ts"),
            F.count("energy_kwh").alias("n_energy"),
            F.sum("energy_kwh").alias("total"),
        ),
        4, "total",
    )


@query
def source_preview(spark, sf):
    return source.preview(readings(spark, sf), 100, ["timestamp", "event_id"])


@query
def sink_series_parquet(spark, sf):
    path = fresh_path(spark, "series")
    sinks.write_series(cohort_series(spark, sf).select("cohort", "ts", "load_kwh"), path)
    back = spark.read.parquet(path)
    return r(
        back.groupBy(F.col("cohort").cast("string").alias("cohort")).agg(
            F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
            F.sum("load_kwh").alias("total"),
        ),
        4, "total",
    )


@query
def sink_readings_sorted(spark, sf):
    path = fresh_path(spark, "readings")
    sinks.write_readings(readings(spark, sf), path, ["household_id"], "timestamp")
    return r(spark.read.parquet(path).select("event_id", "household_id", "timestamp", "energy_kwh"), 4, "energy_kwh")


@query
def sink_result_tables(spark, sf):
    f = forecasts(spark, sf).where("split = 'test'")
    folder = fresh_path(spark, "results")
    table_ = metrics.point_metrics(f, KEYS)
    sinks.write_tables({"as_csv": table_}, folder, "csv")
    sinks.write_tables({"as_json": table_}, folder, "json")
    schema = "cohort string, mae double, rmse double, nmae double, smape double"
    a = spark.read.schema(schema).option("header", True).csv(f"{folder}/as_csv")
    b = spark.read.schema(schema).json(f"{folder}/as_json")
    return a.withColumn("fmt", F.lit("csv")).unionByName(b.withColumn("fmt", F.lit("json")))


# cleaning -----------------------------------------------------------------------

@query
def clean_drop_null_keys(spark, sf):
    df = cleaning.drop_null_keys(dirty_readings(spark, sf))
    return r(df.select("event_id", "household_id", "timestamp", "energy_kwh"), 4, "energy_kwh")


@query
def clean_first_per_key(spark, sf):
    df = cleaning.first_per_key(dirty_readings(spark, sf), order_by=["event_id", "energy_kwh"])
    return r(df.select("event_id", "household_id", "timestamp", "energy_kwh"), 4, "energy_kwh")


@query
def clean_fill_and_clip(spark, sf):
    df = cleaning.fill_and_clip(dirty_readings(spark, sf), 0.0, 50.0)
    return r(
        df.groupBy("household_id").agg(
            F.count("energy_kwh").alias("n"), F.sum("energy_kwh").alias("total"),
            F.min("energy_kwh").alias("lo"), F.max("energy_kwh").alias("hi"),
        ),
        4, "total", "lo", "hi",
    )


@query
def clean_household_history(spark, sf):
    return r(cleaning.household_history(cleaning.drop_null_keys(dirty_readings(spark, sf))), 6, "duration_days")


@query
def clean_keep_households(spark, sf):
    df = cleaning.drop_null_keys(readings(spark, sf))
    kept = cleaning.keep_households(df, cleaning.households_with_history(df, 29.0))
    return r(kept.select("event_id", "household_id", "timestamp", "energy_kwh"), 4, "energy_kwh")


@query
def clean_readings_full(spark, sf):
    df = cleaning.clean_readings(dirty_readings(spark, sf), 28, (0.0, 50.0), ["event_id", "energy_kwh"])
    return r(df.select("event_id", "household_id", "timestamp", "energy_kwh", "tariff_group"), 4, "energy_kwh")


@query
def clean_enforce_missing_ratio(spark, sf):
    df = cleaning.clean_readings(dirty_readings(spark, sf), 20, (0.0, 50.0), ["event_id", "energy_kwh"], 0.20)
    return r(
        df.groupBy("household_id").agg(F.count("*").alias("n"), F.sum("energy_kwh").alias("total")), 4, "total"
    )


@query
def sample_households(spark, sf):
    return cleaning.sample_households(readings(spark, sf), 50, 42)


@query
def sample_readings(spark, sf):
    df = cleaning.sample_readings(readings(spark, sf), 50, 42)
    return r(df.select("event_id", "household_id", "timestamp", "energy_kwh"), 4, "energy_kwh")


# audit ----------------------------------------------------------------------------

@query
def audit_totals(spark, sf):
    return audit.totals(dirty_readings(spark, sf))


@query
def audit_tariff_counts(spark, sf):
    df = dirty_readings(spark, sf).withColumn(
        "tariff_group", F.when(F.col("event_id") % 10 != 0, F.col("tariff_group"))
    )
    return audit.tariff_counts(df)


@query
def audit_duplicates(spark, sf):
    return audit.duplicate_count(dirty_readings(spark, sf))


@query
def audit_household_quality(spark, sf):
    return r(audit.household_quality(dirty_readings(spark, sf)), 6, "duration_days", "missing_ratio")


@query
def audit_exclusions(spark, sf):
    return audit.exclusion_summary(dirty_readings(spark, sf), 28, 0.20)


@query
def audit_retained(spark, sf):
    return audit.retained_households(dirty_readings(spark, sf), 28, 0.20)


@query
def audit_consumption(spark, sf):
    df = audit.consumption_summary(dirty_readings(spark, sf))
    return r(df, 6, "mean", "std", "min", "p25", "median", "p75", "p99", "max")


# cohorts ---------------------------------------------------------------------------

@query
def cohort_membership(spark, sf):
    members = cohorts.tariff_cohorts()
    labels = F.array(*[F.when(c, F.lit(n)) for n, c in members.items()])
    exploded = readings(spark, sf).select("household_id", F.explode(labels).alias("cohort"))
    return exploded.where("cohort is not null").groupBy("cohort").agg(
        F.count("*").alias("n_rows"), F.count_distinct("household_id").alias("households")
    )


@query
def cohort_halfhour_load(spark, sf):
    df = cohorts.cohort_load(halfhour_readings(spark, sf))
    return single(df, "load_kwh", "load_mean_kwh", "load_std_kwh")


@query
def cohort_load_distinct(spark, sf):
    raw = readings(spark, sf).withColumn("timestamp", F.window("timestamp", "30 minutes")["start"])
    df = cohorts.cohort_load(raw, household="household_id")
    return r(df.select("cohort", "ts", "load_kwh", "active_households"), 6, "load_kwh")


@query
def cohort_acorn_load(spark, sf):
    kinds = {a: F.col("acorn_group") == a for a in ("Affluent", "Comfortable", "Adversity")}
    df = cohorts.cohort_load(halfhour_readings(spark, sf), kinds)
    return r(df.select("cohort", "ts", "load_kwh", "active_households"), 6, "load_kwh")


@query
def cohort_hourly_profile(spark, sf):
    return r(cohorts.hourly_profile(cohort_series(spark, sf)), 6, "mean_load")


@query
def cohort_step_profile(spark, sf):
    df = cohorts.step_profile(
        cohort_series(spark, sf)
    )
    return r(df, 6, "mean", "std", "p10", "p90")


@query
def cohort_histogram(spark, sf):
    df = split_series(spark, sf).where("split in ('train', 'test')")
    return r(cohorts.density_histogram(df, ["cohort", "split"], bins=35), 6, "bin_start", "density")


# splits -------------------------------------------------------------------------------

@query
def split_tags(spark, sf):
    return r(split_series(spark, sf).select("cohort", "ts", "split", "load_kwh"), 6, "load_kwh")


@query
def split_counts(spark, sf):
    return splits.split_summary(split_series(spark, sf))


@query
def split_disjoint(spark, sf):
    df = split_series(spark, sf)
    out = None
    for a, b in itertools.combinations(("train", "calibration", "validation", "test"), 2):
        left = df.where(F.col("split") == a).select("cohort", "ts")
        shared = left.join(df.where(F.col("split") == b).select("cohort", "ts"), ["cohort", "ts"])
        one = shared.agg(F.count("*").alias("shared")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "shared")
        out = one if out is None else out.unionByName(one)
    return out


@query
def slice_thirds(spark, sf):
    df = split_series(spark, sf).where("split = 'test'")
    early = splits.series_slice(df, KEYS, part=(0, 3)).withColumn("period", F.lit("early"))
    late = splits.series_slice(df, KEYS, part=(2, 3)).withColumn("period", F.lit("late"))
    return r(early.unionByName(late).select("cohort", "period", "ts", "load_kwh"), 6, "load_kwh")


@query
def slice_zoom_week(spark, sf):
    df = splits.series_slice(cohort_series(spark, sf), KEYS, rows=(48 * 7, 48 * 14))
    return r(df.select("cohort", "ts", "load_kwh"), 6, "load_kwh")


# features -----------------------------------------------------------------------------

@query
def feature_regular_grid(spark, sf):
    return r(features.regularise(typed_series(spark, sf), ["event_type"]), 4, "load_kwh")


@query
def feature_positions(spark, sf):
    df = ordering.positions(typed_series(spark, sf), ["event_type"])
    return r(df, 4, "load_kwh")


@query
def feature_row_lags(spark, sf):
    numbered = ordering.positions(typed_series(spark, sf), ["event_type"])
    df = features.lag_features(numbered, ["event_type"], rolling=False, chunk=500)
    cols = ["load_lag_48", "load_lag_96", "load_lag_144", "load_lag_336", "origin_load_h48", "origin_ramp_h48"]
    return r(df.select("event_type", "ts", *cols), 4, *cols)


@query
def feature_origin_statistics(spark, sf):
    df = features.lag_features(cohort_series(spark, sf), KEYS, chunk=512)
    cols = [c for c in features.load_feature_names() if "24h" in c or "7d" in c]
    return single(df.select("cohort", "ts", *cols), *cols)


@query
def feature_calendar(spark, sf):
    df = features.calendar_features(
        cohort_series(spark, sf).select("cohort", "ts"), holidays=("2024-01-01", "2024-01-26")
    )
    return r(df, 6, "sin_hh", "cos_hh", "sin_dow", "cos_dow", "sin_doy", "cos_doy")


@query
def feature_holiday_table(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts"))
    days = orders.select(F.to_date("ts").alias("date")).where(F.dayofmonth("date") == 25).distinct()
    df = features.calendar_features(orders, holidays=days)
    return df.select("o_orderkey", "half_hour_idx", "day_of_week", "is_weekend", "month", "day_of_year", "is_bank_holiday")


@query
def feature_table(spark, sf):
    df = features.forecasting_table(cohort_series(spark, sf), KEYS)
    cols = features.feature_names()
    real = [c for c in cols if c not in ("half_hour_idx", "hour", "day_of_week", "month", "day_of_year")]
    return single(df.select("cohort", "ts", "load_kwh", *cols), "load_kwh", *real)


@query
def feature_table_per_split(spark, sf):
    tagged = splits.tag_splits(*series_and_ranges(spark, sf, PER_SPLIT_CUTS))
    df = features.forecasting_table(tagged, KEYS, lags=(48, 96), warmup="per_split")
    cols = features.load_feature_names((48, 96))
    return single(df.select("cohort", "split", "ts", *cols), *cols)


@query
def feature_scaled(spark, sf):
    tagged, names = feature_rows(spark, sf), features.feature_names()
    scaler = features.fit_scaler(tagged.where("split = 'train'"), KEYS, names)
    df = features.scale(tagged.select("cohort", "ts", "split", *names), scaler, KEYS, names)
    return r(df, 6, *names)


@query
def feature_rolling_coverage(spark, sf):
    f = forecasts(spark, sf)
    cal, test = f.where("split = 'calibration'"), f.where("split = 'test'")
    bounds = conformal.static_intervals(cal, test, KEYS)
    covered = bounds.withColumn("covered", C.covers("y", "lower", "upper"))
    df = features.rolling_coverage(covered, KEYS, window=96, chunk=128)
    return r(df.select("cohort", "ts", "rolling_coverage"), 6, "rolling_coverage")


@query
def feature_day_blocks(spark, sf):
    tested = split_series(spark, sf).where("split = 'test'")
    df = splits.day_blocks(splits.relative_position(tested, KEYS))
    return df.groupBy("cohort", "block").agg(F.min("ts").alias("first_ts"), F.count("*").alias("n"))


# scalar functions ------------------------------------------------------------------------

@query
def scalar_labels(spark, sf):
    li = table(spark, sf, "lineitem")
    hour = (F.col("l_orderkey") % 24).cast("int")
    df = li.select(
        C.season(F.month("l_shipdate")).alias("season"),
        C.peak_status(hour).alias("peak"),
        C.day_type("l_shipdate").alias("day_type"),
        F.to_date("l_shipdate").alias("day"),
        C.band_violation("l_quantity", F.lit(10.0), F.lit(40.0)).alias("violation"),
        (F.col("l_extendedprice") / 7).alias("x"),
    )
    return df.groupBy("season", "peak", "day_type").agg(
        F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("violation").alias("worst"),
        C.rounded(F.max("x"), 4).alias("x4"), C.rounded(F.min("x"), 2).alias("x2"),
    )


@query
def scalar_tertiles(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    df = reliability.add_regime(
        li, ["l_returnflag"], "l_extendedprice", "regime", ("Low", "Medium", "High")
    )
    return df.select("l_orderkey", "l_linenumber", "l_returnflag", "regime")


# point forecasts --------------------------------------------------------------------------

@query
def model_seasonal_naive(spark, sf):
    lagged = features.lag_features(cohort_series(spark, sf), KEYS, lags=(48, 336), rolling=False)
    df = lagged.withColumns(
        {
            "day": models.seasonal_naive(lagged.columns, 48),
            "week": models.seasonal_naive(lagged.columns, 336),
            "fallback": models.seasonal_naive(lagged.columns, 96),
        }
    )
    return r(df.select("cohort", "ts", "day", "week", "fallback"), 6, "day", "week", "fallback")


@query
def model_ridge_one_feature(spark, sf):
    series, ranges = series_and_ranges(spark, sf)
    rows = features.lag_features(series, KEYS, lags=(48, 336), rolling=False)
    tagged = splits.tag_splits(rows.dropna(subset=["load_lag_336"]), ranges)
    fitted = models.ridge_fit(tagged.where("split = 'train'"), KEYS, ["load_lag_48"], "load_kwh", 1.0)
    df = models.ridge_predict(tagged.where("split = 'test'"), fitted, KEYS, ["load_lag_48"])
    return r(df.select("cohort", "ts", "y_pred"), 6, "y_pred")


@query
def model_ridge_two_features(spark, sf):
    li = table(spark, sf, "lineitem")
    fitted = models.ridge_fit(li, ["l_returnflag"], ["l_quantity", "l_discount"], "l_extendedprice", 10.0)
    df = fitted.select(
        "l_returnflag", "n_rows", "intercept",
        F.get("coefficients", F.lit(0)).alias("b_quantity"), F.get("coefficients", F.lit(1)).alias("b_discount"),
    )
    return r(df, 4, "intercept", "b_quantity", "b_discount")


@query
def model_ridge_large_means(spark, sf):
    """A feature far from 0, missing in some rows."""
    li = table(spark, sf, "lineitem").select(
        "l_returnflag", F.when(F.col("l_orderkey") % 11 != 0, F.col("l_quantity") + 1e8).alias("x"), "l_extendedprice"
    )
    fitted = models.ridge_fit(li, ["l_returnflag"], ["x"], "l_extendedprice", 10.0)
    df = fitted.select("l_returnflag", "n_rows", F.get("coefficients", F.lit(0)).alias("b"))
    return r(df, 3, "b")


def feature_rows(spark, sf) -> DataFrame:
    series, ranges = series_and_ranges(spark, sf)
    tagged = splits.tag_splits(features.forecasting_table(series, KEYS), ranges)
    return cut_lineage(tagged, "features")


def scaled_rows(spark, sf) -> tuple[DataFrame, list[str]]:
    tagged = feature_rows(spark, sf)
    names = features.feature_names()
    scaler = features.fit_scaler(tagged.where("split = 'train'"), KEYS, names)
    return features.scale(tagged, scaler, KEYS, names), names


@query
def model_ridge_all_features(spark, sf):
    rows, names = scaled_rows(spark, sf)
    fitted = models.ridge_fit(rows.where("split = 'train'"), KEYS, names, "load_kwh", 1.0)
    df = models.ridge_predict(rows.where("split = 'test'"), fitted, KEYS, names)
    return r(df.select("cohort", "ts", "load_kwh", "y_pred"), 4, "load_kwh", "y_pred")


def boosted_points(spark, sf) -> DataFrame:
    """Test rows with the boosted forecast of their cohort's own model, default rounds."""
    rows, names = feature_rows(spark, sf), features.feature_names()
    fitted = boosting.boosted_fit(rows.where("split = 'train'"), KEYS, names, "load_kwh")
    return boosting.boosted_predict(rows.where("split = 'test'"), fitted, KEYS, names)


@query
def model_boosted_trees(spark, sf):
    df = boosted_points(spark, sf)
    return r(df.select("cohort", "ts", "load_kwh", "y_pred"), 4, "load_kwh", "y_pred")


def boosted_quantiles(spark, sf) -> DataFrame:
    """Test rows with the levels of their cohort's own pinball-loss model, default rounds."""
    rows, names = feature_rows(spark, sf), features.feature_names()
    fitted = boosting.boosted_fit(rows.where("split = 'train'"), KEYS, names, "load_kwh", models.QUANTILES)
    return boosting.boosted_predict(rows.where("split = 'test'"), fitted, KEYS, names, list(models.QUANTILES))


@query
def model_boosted_quantiles(spark, sf):
    out = boosted_quantiles(spark, sf).select("cohort", "ts", "load_kwh", *models.QUANTILES)
    return r(out, 4, "load_kwh", *models.QUANTILES)


@query
def model_quantile_forest(spark, sf):
    rows, names = feature_rows(spark, sf), features.feature_names()
    fitted = models.quantile_forest_fit(rows.where("split = 'train'"), names, "load_kwh", num_trees=10)
    df = models.quantile_forest_predict(rows.where("split = 'test'"), fitted, names)
    out = df.select("cohort", "ts", "load_kwh", "q_lo", "q_mid", "q_hi")
    return r(out, 4, "load_kwh", "q_lo", "q_mid", "q_hi")


@query
def model_ridge_normal_equations(spark, sf):
    """What is left of the normal equations per feature: nothing, if the fit is the ridge solution."""
    rows, names = scaled_rows(spark, sf)
    train = rows.where("split = 'train'")
    fitted = models.ridge_fit(train, KEYS, names, "load_kwh", 1.0)
    error = F.col("load_kwh") - F.col("intercept")
    for i, name in enumerate(names):
        error = error - F.get("coefficients", F.lit(i)) * F.col(name)
    each = F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("x"), F.get("coefficients", F.lit(i)).alias("b"))
        for i, n in enumerate(names)
    ])
    left = train.join(fitted.drop("n_rows"), KEYS).withColumn("e", error).select("cohort", "e", F.inline(each))
    sums = left.groupBy("cohort", "feature").agg((F.sum(F.col("x") * F.col("e")) - F.first("b")).alias("rest"))
    return sums.select("cohort", "feature", (F.round("rest", 4) + F.lit(0.0)).alias("rest"))


@query
def model_boosted_trees_facts(spark, sf):
    """Every test row has a prediction that is a load, and the error is below that of the seasonal naive forecast."""
    df = boosted_points(spark, sf)
    naive = F.avg(F.abs(F.col("load_kwh") - models.seasonal_naive(df.columns, 48)))
    return df.groupBy("cohort").agg(
        F.count("*").alias("n"), F.count_if(F.col("y_pred").isNull()).alias("n_missing"),
        F.count_if(F.col("y_pred") < 0).alias("n_negative"), F.round(naive, 4).alias("naive_mae"),
        (F.avg(F.abs(F.col("load_kwh") - F.col("y_pred"))) < naive).alias("below_naive"),
    )


@query
def model_boosted_quantiles_facts(spark, sf):
    """Levels in order, and a pinball loss below that of the seasonal quantiles, summed over the levels."""
    df = boosted_quantiles(spark, sf)
    seasonal = forecasts(spark, sf).where("split = 'test'").select("cohort", "ts", *[F.col(q).alias(f"s_{q}") for q in models.QUANTILES])
    both = df.join(seasonal, ["cohort", "ts"])
    loss = lambda prefix: sum(F.avg(C.pinball("load_kwh", f"{prefix}{q}", tau)) for q, tau in models.QUANTILES.items())
    ordered = (F.col("q_lo") <= F.col("q_mid")) & (F.col("q_mid") <= F.col("q_hi"))
    return both.groupBy("cohort").agg(
        F.count("*").alias("n"), F.count_if(~F.coalesce(ordered, F.lit(False))).alias("n_disordered"),
        F.round(loss("s_"), 4).alias("seasonal_pinball"), (loss("") < loss("s_")).alias("below_seasonal"),
    )


@query
def model_quantile_forest_facts(spark, sf):
    """Quantiles are in order and within the loads of the training rows."""
    train = split_series(spark, sf).where("split = 'train'").agg(
        F.min("load_kwh").alias("least"), F.max("load_kwh").alias("most")
    )
    df = model_quantile_forest(spark, sf).withColumns({
        "least": train.select("least").scalar(), "most": train.select("most").scalar(),
    })
    ordered = (F.col("q_lo") <= F.col("q_mid")) & (F.col("q_mid") <= F.col("q_hi"))
    inside = (F.col("q_lo") >= F.round("least", 4)) & (F.col("q_hi") <= F.round("most", 4))
    return df.groupBy("cohort").agg(
        F.count("*").alias("n"), F.count_if(~F.coalesce(ordered, F.lit(False))).alias("n_disordered"),
        F.count_if(~F.coalesce(inside, F.lit(False))).alias("n_outside"),
    )


@query
def model_seasonal_quantiles(spark, sf):
    f = forecasts(spark, sf).where("split = 'test'")
    return r(f.select("cohort", "ts", "q_lo", "q_mid", "q_hi"), 6, "q_lo", "q_mid", "q_hi")


@query
def model_quantile_interval(spark, sf):
    f = forecasts(spark, sf).where("split = 'test'")
    df = models.quantile_interval(f, models.QUANTILES, 0.12)
    return r(df.select("cohort", "ts", "lower", "median", "upper"), 6, "lower", "median", "upper")


def model_table(spark, sf) -> DataFrame:
    series, ranges = series_and_ranges(spark, sf)
    lagged = features.lag_features(series, KEYS, rolling=False)
    rows = splits.tag_splits(lagged.dropna(subset=["load_lag_336"]), ranges)
    fitted = models.ridge_fit(
        rows.where("split = 'train'"), KEYS, ["load_lag_48"], "load_kwh", 1.0
    )
    test = models.ridge_predict(rows.where("split = 'test'"), fitted, KEYS, ["load_lag_48"], "ridge")
    test = models.add_seasonal_naive(test, 48, "day")
    test = models.add_seasonal_naive(test, 336, "week")
    return models.stack_models(
        test, KEYS, {"seasonal_naive_day": "day", "seasonal_naive_week": "week", "ridge": "ridge"}, "load_kwh"
    )


@query
def point_model_comparison(spark, sf):
    return metrics.point_metrics(model_table(spark, sf), ["cohort", "model"])


def experiment_forecasts(spark, sf) -> DataFrame:
    series, ranges = series_and_ranges(spark, sf)
    return experiment.model_forecasts(series, KEYS, ranges)


@query
def point_four_models(spark, sf):
    """All point models side by side: two seasonal naives, ridge on all features, boosted trees."""
    return experiment.point_table(experiment_forecasts(spark, sf), KEYS)


@query
def point_four_models_facts(spark, sf):
    """A row per cohort and model, the errors of the naive models, and whether the trees stay below the day's."""
    df = point_four_models(spark, sf)
    day = df.where(F.col("model") == experiment.SEASONAL_DAY).select("cohort", F.col("mae").alias("day_mae"))
    naive = F.col("model").isin(experiment.SEASONAL_DAY, experiment.SEASONAL_WEEK)
    return df.join(day, "cohort").select(
        "cohort", "model", F.when(naive, F.col("mae")).alias("naive_mae"),
        F.when(F.col("model") == experiment.BOOSTED, F.col("mae") < F.col("day_mae")).alias("below_day"),
    )


@query
def backtest_boosted(spark, sf):
    """The whole run: the boosted point model and pinball quantiles under all six interval methods."""
    forecast = cut_lineage(experiment_forecasts(spark, sf), "forecasts")
    return metrics.interval_metrics(
        backtest.labelled(experiment.backtest_forecasts(forecast, KEYS, SETTINGS)), ["cohort", "method"], 0.10
    )


@query
def backtest_boosted_facts(spark, sf):
    """What holds of the run whatever the fits: rows per method, bounds in order and not negative, misses near alpha."""
    forecast = cut_lineage(experiment_forecasts(spark, sf), "forecasts")
    df = experiment.backtest_forecasts(forecast, KEYS, SETTINGS)
    covered = F.avg(C.covers("y", "lower", "upper").cast("double"))
    return df.groupBy("cohort", "method").agg(
        F.count("*").alias("n"), F.count_if((F.col("lower") > F.col("upper")) | (F.col("lower") < 0)).alias("n_disordered"),
        F.count_if(F.col("lower").isNull() | F.col("upper").isNull()).alias("n_missing"),
        (covered > 0.6).alias("covers"),
    )


@query
def point_primary_model(spark, sf):
    chosen = models.primary_model(["seasonal_naive_day", "seasonal_naive_week", "ridge"], "ridge")
    rows = model_table(spark, sf).where(F.col("model") == chosen)
    return metrics.point_metrics(rows, ["cohort"])


@query
def point_metrics_by_supplier(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_suppkey", F.col("l_quantity").alias("y"), (F.col("l_extendedprice") / 1500).alias("y_pred")
    )
    return metrics.point_metrics(li, ["l_suppkey"])


@query
def forecast_outcome_join(spark, sf):
    f = forecasts(spark, sf).select("cohort", "ts", "y_pred")
    outcomes = cohort_series(spark, sf).select("cohort", "ts", F.col("load_kwh").alias("y"))
    return metrics.point_metrics(f.join(outcomes, ["cohort", "ts"]), KEYS)


# conformal calibrators ----------------------------------------------------------------------

@query
def conformal_quantile_by_alpha(spark, sf):
    cal = forecasts(spark, sf).where("split = 'calibration'")
    alphas = {"q05": 0.05, "q10": 0.10, "q20": 0.20, "q50": 0.50}
    df = conformal.calibration_quantiles(
        cal, KEYS, C.absolute_residual("y", "y_pred"), alphas
    )
    return r(df, 6, *alphas)


@query
def conformal_quantile_large_groups(spark, sf):
    """Scores of unbounded groups, ranked in value slices."""
    li = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_extendedprice"), F.lit(30000.0).alias("p"))
    df = conformal.calibration_quantiles(
        li, ["l_returnflag"], C.absolute_residual("l_extendedprice", "p"), {"q10": 0.10, "q30": 0.30}
    )
    return r(df, 4, "q10", "q30")


def interval_rows(df: DataFrame) -> DataFrame:
    return single(df.select("cohort", "ts", "lower", "upper"), "lower", "upper")


@query
def conformal_uncalibrated(spark, sf):
    return interval_rows(conformal.uncalibrated_intervals(forecasts(spark, sf).where("split = 'test'")))


@query
def conformal_static(spark, sf):
    f = forecasts(spark, sf)
    return interval_rows(
        conformal.static_intervals(
            f.where("split = 'calibration'"), f.where("split = 'test'"), KEYS
        )
    )


@query
def conformal_cqr(spark, sf):
    f = forecasts(spark, sf)
    return interval_rows(
        conformal.cqr_intervals(
            f.where("split = 'calibration'"), f.where("split = 'test'"), KEYS
        )
    )


@query
def conformal_rolling(spark, sf):
    cal, test = backtest.place_rows(forecasts(spark, sf), KEYS)
    return interval_rows(conformal.rolling_intervals(cal, test, KEYS, window=240))


@query
def conformal_rolling_uneven_window(spark, sf):
    cal, test = backtest.place_rows(forecasts(spark, sf), KEYS)
    return interval_rows(conformal.rolling_intervals(cal, test, KEYS, window=130))


@query
def conformal_aci(spark, sf):
    cal, test = backtest.place_rows(forecasts(spark, sf), KEYS)
    df = adaptive.aci_intervals(cal, test, KEYS)
    return single(
        df.select("cohort", "ts", "alpha_block", "conformal_quantile", "lower", "upper"), "alpha_block", "conformal_quantile", "lower", "upper",
    )


@query
def conformal_aci_band(spark, sf):
    cal, test = backtest.place_rows(forecasts(spark, sf), KEYS)
    df = adaptive.aci_intervals(
        cal, test, KEYS, band=("q_lo", "q_hi"), cal_score=C.band_violation("y", "q_lo", "q_hi")
    )
    return interval_rows(df)


@query
def conformal_aci_trace(spark, sf):
    cal, test = backtest.place_rows(forecasts(spark, sf), KEYS)
    df = adaptive.block_trace(adaptive.aci_intervals(cal, test, KEYS), KEYS)
    return r(
        df.select("cohort", "block", "alpha_t", "conformal_quantile", "err_t", "covered", "width"),
        6, "alpha_t", "conformal_quantile", "err_t", "covered", "width",
    )


def sa_rows(spark, sf, variant=SETTINGS.sa_acp) -> DataFrame:
    settings = replace(SETTINGS, sa_acp=variant)
    return backtest.run_backtest(forecasts(spark, sf), KEYS, settings, ["sa_acp"])


@query
def conformal_shift_aware(spark, sf):
    df = sa_rows(spark, sf).select(
        "cohort", "ts", "alpha_t", "gamma_t", "shift_score", "shift_flag", "lower", "upper"
    )
    return single(df, "alpha_t", "gamma_t", "shift_score", "lower", "upper")


@query
def conformal_shift_aware_trace(spark, sf):
    cal, test = backtest.place_rows(forecasts(spark, sf), KEYS)
    packed = conformal.pack_calibration(cal, KEYS, {"_abs": C.absolute_residual("y", "y_pred")})
    scored = backtest.with_shift_scores(cal, test, KEYS, packed, SETTINGS)
    df = adaptive.step_trace(adaptive.shift_aware_intervals(cal, scored, KEYS, [SETTINGS.sa_acp], rows=test))
    shown = ["alpha_t", "conformal_quantile", "err_t", "covered", "interval_width"]
    # the quantile of the trace is that of the step's own alpha
    return single(df.withColumn("conformal_quantile", F.col("quantile_t")).select("cohort", "ts", *shown), *shown)


@query
def conformal_detector_off(spark, sf):
    df = sa_rows(spark, sf, replace(SETTINGS.sa_acp, enable_detector=False))
    out = df.select("cohort", "ts", "alpha_t", "gamma_t", "shift_score", "shift_flag", "lower", "upper")
    return single(out, "alpha_t", "gamma_t", "shift_score", "lower", "upper")


def sa_shown(df: DataFrame) -> DataFrame:
    out = df.select("cohort", "ts", "alpha_t", "gamma_t", "shift_score", "shift_flag", "lower", "upper")
    return single(out, "alpha_t", "gamma_t", "shift_score", "lower", "upper")


@query
def conformal_shift_aware_mean_detector(spark, sf):
    """The detector of standardised means at its threshold of 2."""
    settings = replace(SETTINGS, detector="standardized_residual", sa_acp=replace(SETTINGS.sa_acp, threshold=2.0))
    return sa_shown(backtest.run_backtest(forecasts(spark, sf), KEYS, settings, ["sa_acp"]))


@query
def conformal_shift_aware_always_penalised(spark, sf):
    """A miss costs in proportion to the shift score, flagged or not."""
    return sa_shown(sa_rows(spark, sf, replace(SETTINGS.sa_acp, penalty="always")))


@query
def conformal_shift_aware_band(spark, sf):
    """Adjusts the quantile band instead of the point forecast."""
    cal, test = backtest.place_rows(forecasts(spark, sf), KEYS)
    packed = conformal.pack_calibration(cal, KEYS, {"_abs": C.absolute_residual("y", "y_pred")})
    scored = backtest.with_shift_scores(cal, test, KEYS, packed, SETTINGS, also=("q_lo", "q_hi"))
    df = adaptive.shift_aware_intervals(
        cal, scored, KEYS, [SETTINGS.sa_acp], band=("q_lo", "q_hi"), cal_score=C.band_violation("y", "q_lo", "q_hi"), rows=test
    )
    return sa_shown(df.withColumn("alpha_t", F.col("alpha_block")))


@query
def rolling_with_missing_outcomes(spark, sf):
    """Windows of the last scores; an outcome that is not there takes up no place."""
    cal, test = backtest.place_rows(unsettled(spark, sf), KEYS)
    return interval_rows(conformal.rolling_intervals(cal, test, KEYS, window=130))


@query
def adaptive_with_missing_outcomes(spark, sf):
    """Steps without an outcome move neither alpha nor the detector, and whole days of them leave alpha as it was."""
    df = backtest.run_backtest(unsettled(spark, sf), KEYS, SETTINGS, ["rolling", "aci", "sa_acp"])
    return single(df.select("cohort", "ts", "method", "alpha_t", "lower", "upper"), "alpha_t", "lower", "upper")


# shift detection ---------------------------------------------------------------------------

@query
def shift_wasserstein_detector(spark, sf):
    cal, test = backtest.place_rows(forecasts(spark, sf), KEYS)
    packed = conformal.pack_calibration(cal, KEYS, {"_abs": C.absolute_residual("y", "y_pred")})
    scored = test.select("cohort", "ts", "pos", C.absolute_residual("y", "y_pred").alias("score"))
    df = drift.wasserstein_scores(scored, packed, KEYS, window=96, reference_length=200, ref_scores="_abs", chunk=128)
    flagged = drift.flag_shift(df, 0.12)
    return r(flagged.select("cohort", "ts", "shift_score", "shift_flag"), 6, "shift_score")


@query
def shift_mean_detector(spark, sf):
    f = forecasts(spark, sf).withColumn("score", C.absolute_residual("y", "y_pred"))
    cal, test = backtest.place_rows(f, KEYS)
    df = drift.mean_shift_scores(test.select("cohort", "ts", "pos", "score"), cal, KEYS, window=96, chunk=128)
    flagged = drift.flag_shift(df, 2.0)
    return r(flagged.select("cohort", "ts", "shift_score", "shift_flag"), 6, "shift_score")


@query
def shift_two_sample(spark, sf):
    df = drift.two_sample_statistics(
        split_series(spark, sf), KEYS, "load_kwh", "split", "train", "test"
    )
    cols = ["wasserstein_1d", "ks_statistic", "ks_p_value", "u_statistic", "mann_whitney_z", "mann_whitney_p_value"]
    out = df.select("cohort", "n_pre", "n_post", "tie_term", *cols, "significant_shift")
    return r(out, 6, "tie_term", *cols)


@query
def shift_two_sample_large_groups(spark, sf):
    """Two samples of unbounded size, ranked in value slices."""
    li = table(spark, sf, "lineitem").select("l_linestatus", "l_extendedprice", "l_returnflag")
    df = drift.two_sample_statistics(
        li, ["l_linestatus"], "l_extendedprice", "l_returnflag", "A", "N", hot_min=1000
    )
    cols = ["wasserstein_1d", "ks_statistic", "u_statistic", "mann_whitney_z"]
    return r(df.select("l_linestatus", "n_pre", "n_post", *cols), 4, *cols)


@query
def shift_moments(spark, sf):
    df = drift.period_moments(
        split_series(spark, sf), KEYS, "load_kwh", "split"
    )
    return r(df, 6, "mean", "std", "median", "p95", "p99")


@query
def shift_ramps_autocorrelation(spark, sf):
    df = drift.ramps_and_autocorrelation(
        cohort_series(spark, sf).withColumn("period", F.lit("all")), KEYS, "load_kwh", "period", (48, 336), chunk=400
    )
    return r(df.select("cohort", "mean_absolute_ramp", "acf_48", "acf_336"), 6, "mean_absolute_ramp", "acf_48", "acf_336")


@query
def shift_characterisation(spark, sf):
    df = drift.characterise_shift(
        split_series(spark, sf), KEYS, "load_kwh", "split", "train", "test", digits=4,
    )
    return r(df, 4, "ks_p_value", "mann_whitney_p_value")


# backtest -----------------------------------------------------------------------------------

@query
def backtest_intervals(spark, sf):
    methods = ["uncalibrated", "static", "cqr", "rolling", "aci"]
    df = backtest.run_backtest(forecasts(spark, sf), KEYS, SETTINGS, methods)
    return single(df.select("cohort", "ts", "method", "y", "y_pred", "lower", "upper"), "y", "y_pred", "lower", "upper")


@query
def backtest_wide(spark, sf):
    df = backtest.wide_trajectory(backtest.run_backtest(forecasts(spark, sf), KEYS, SETTINGS), KEYS)
    real = [c for c in df.columns if c not in ("cohort", "ts", "shift_flag")]
    return single(df, *real)


@query
def backtest_method_table(spark, sf):
    df = backtest.labelled(backtest.run_backtest(forecasts(spark, sf), KEYS, SETTINGS))
    return metrics.interval_metrics(df, ["cohort", "method"], 0.10)


@query
def backtest_default_windows(spark, sf):
    """All methods at their default windows (1344, 336, 1344) and threshold on series of some 2,500 steps."""
    df = backtest.run_backtest(daily_forecasts(spark, sf), KEYS)
    return metrics.interval_metrics(df, ["cohort", "method"], 0.10)


@query
def shift_detector_default_windows(spark, sf):
    df = backtest.run_backtest(daily_forecasts(spark, sf), KEYS, methods=["sa_acp"])
    return single(df.select("cohort", "ts", "shift_score", "shift_flag", "alpha_t", "lower", "upper"), "shift_score", "alpha_t", "lower", "upper")


# evaluation ---------------------------------------------------------------------------------

def all_intervals(spark, sf) -> DataFrame:
    return backtest.run_backtest(
        forecasts(spark, sf), KEYS, SETTINGS, ["uncalibrated", "static", "cqr", "rolling", "aci"]
    )


def supplier_bands(spark, sf) -> DataFrame:
    """Many series: line quantities with a band, per supplier."""
    return table(spark, sf, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("y"),
        (F.col("l_extendedprice") / 2500).alias("lower"), (F.col("l_extendedprice") / 1000).alias("upper"),
    )


@query
def interval_metrics_by_supplier(spark, sf):
    return metrics.interval_metrics(supplier_bands(spark, sf), ["l_suppkey"], 0.20)


@query
def interval_pinball(spark, sf):
    f = forecasts(spark, sf).where("split = 'test'")
    return r(metrics.pinball_loss(f, KEYS, "y", {0.05: "q_lo", 0.5: "q_mid", 0.95: "q_hi"}), 6, "pinball")


@query
def interval_method_table(spark, sf):
    return metrics.interval_metrics(all_intervals(spark, sf), ["cohort", "method"], 0.10)


@query
def interval_daily_sums(spark, sf):
    df = metrics.daily_sums(supplier_bands(spark, sf), ["l_suppkey"], 0.10)
    return r(df, 7, "sum_width", "sum_score")


@query
def interval_daily_diagnostics(spark, sf):
    df = backtest.run_backtest(forecasts(spark, sf), KEYS, SETTINGS, ["static", "rolling", "sa_acp"])
    days = metrics.daily_diagnostics(df, KEYS, {"sa": "sa_acp", "static": "static"})
    return single(days, "day_mae", "day_sa_cov", "day_static_cov", "day_sa_ace")


@query
def conditional_reliability(spark, sf):
    f = forecasts(spark, sf)
    df = conformal.static_intervals(
        f.where("split = 'calibration'"), f.where("split = 'test'"), KEYS
    )
    df = cut_lineage(df.withColumn("shift_flag", F.hour("ts") < 6))
    return reliability.conditional_reliability(df, KEYS)


@query
def conditional_reliability_by_shift(spark, sf):
    """The shift-aware intervals by the flag of their own detector, next to all other dimensions."""
    df = backtest.run_backtest(forecasts(spark, sf), KEYS, SETTINGS, ["sa_acp"])
    return reliability.conditional_reliability(cut_lineage(df), KEYS)


@query
def conditional_reliability_suppliers(spark, sf):
    """Many irregular series; tertiles of groups without a known size bound."""
    bands = supplier_bands(spark, sf).withColumn("ts", F.col("ts") + F.make_dt_interval(
        F.lit(0), (F.col("l_orderkey") % 24).cast("int")))
    keyed = bands.withColumn("region", (F.col("l_suppkey") % 5).cast("int"))
    df = reliability.add_regime(keyed, ["region"], "y", "load_regime", ("Low Demand", "Medium Demand", "High Demand"))
    return metrics.interval_metrics(df, ["region", "load_regime"], 0.10)


@query
def interval_ramps(spark, sf):
    f = forecasts(spark, sf).where("split = 'test'")
    return r(reliability.add_ramps(f, KEYS, chunk=100).select("cohort", "ts", "ramp"), 6, "ramp")


@query
def hourly_coverage(spark, sf):
    df = backtest.run_backtest(forecasts(spark, sf), KEYS, SETTINGS, ["static", "cqr"])
    return r(reliability.hourly_coverage(df, KEYS, ["static", "cqr"]), 4, "static_pct", "cqr_pct")


@query
def coverage_width(spark, sf):
    m = metrics.interval_metrics(all_intervals(spark, sf), ["cohort", "method"], 0.10)
    return r(metrics.coverage_width(m, ["cohort", "method"]), 2, "coverage_pct")


@query
def shift_against_residual(spark, sf):
    df = reliability.shift_against_residual(sa_rows(spark, sf), KEYS)
    return r(df, 6, "shift_score", "abs_residual")


@query
def formatted_results(spark, sf):
    m = metrics.interval_metrics(all_intervals(spark, sf), ["cohort", "method"], 0.10)
    return metrics.formatted_results(m, ["cohort", "method"])


@query
def worst_days_by_error(spark, sf):
    f = forecasts(spark, sf)
    days = f.groupBy("cohort", F.to_date("ts").alias("day")).agg(
        F.avg(F.abs(F.col("y") - F.col("y_pred"))).alias("day_mae")
    )
    return r(metrics.worst_days(days, KEYS, "day_mae", 20), 6, "day_mae")


@query
def worst_days_by_coverage(spark, sf):
    df = all_intervals(spark, sf)
    days = metrics.daily_diagnostics(df, KEYS, {"static": "static", "cqr": "cqr"})
    worst = metrics.worst_days(days.withColumn("day_static_ace", F.round("day_static_ace", 6)), KEYS, "day_static_ace", 3)
    return worst.select("cohort", "day", "rank", "day_static_ace")


@query
def methods_stacked(spark, sf):
    f = forecasts(spark, sf)
    cal, test = f.where("split = 'calibration'"), f.where("split = 'test'")
    static = conformal.static_intervals(cal, test, KEYS).withColumn("method", F.lit("static"))
    cqr = conformal.cqr_intervals(cal, test, KEYS).withColumn("method", F.lit("cqr"))
    return metrics.interval_metrics(static.unionByName(cqr), ["cohort", "method"], 0.10)


# bootstrap ----------------------------------------------------------------------------------

BOOT = ("mean_a", "mean_b", "mean_diff", "ci_lower", "ci_upper", "p_value")


def static_and_cqr_days(spark, sf) -> DataFrame:
    df = backtest.run_backtest(forecasts(spark, sf), KEYS, SETTINGS, ["static", "cqr"])
    return metrics.daily_sums(df, ["cohort", "method"], 0.10)


@query
def bootstrap_draws(spark, sf):
    counts = split_series(spark, sf).groupBy("split").agg(F.count_distinct(F.to_date("ts")).alias("n_days"))
    draws = bootstrap.unpack_draws(bootstrap.day_draws(counts, 200, 42), "n_days", "day_idx")
    return draws.withColumns({c: F.col(c).cast("bigint") for c in ("b", "times")})


@query
def bootstrap_samples(spark, sf):
    daily = static_and_cqr_days(spark, sf)
    df = bootstrap.resampled_metrics(daily, KEYS, "cqr", "static", 0.10, 300, 42)
    return df.withColumn("b", F.col("b").cast("bigint"))


@query
def bootstrap_comparison(spark, sf):
    daily = static_and_cqr_days(spark, sf)
    return single(bootstrap.paired_bootstrap(daily, KEYS, "cqr", "static", 0.10, 2000, 42, digits=None), *BOOT)


@query
def bootstrap_table(spark, sf):
    """The result table of the paired bootstrap, intervals and verdicts in writing."""
    results = bootstrap.paired_bootstrap(static_and_cqr_days(spark, sf), KEYS, "cqr", "static", 0.10, 499, 42)
    return bootstrap.formatted_bootstrap(results, KEYS)


@query
def bootstrap_few_days(spark, sf):
    """Fewer than five days: every statistic is NULL."""
    days = static_and_cqr_days(spark, sf)
    few = days.join(days.groupBy("cohort").agg(F.min("day").alias("first")), "cohort").where(F.date_diff("day", "first") < 4)
    return single(bootstrap.paired_bootstrap(few.drop("first"), KEYS, "cqr", "static", 0.10, 50, 42, digits=None), *BOOT)


@query
def bootstrap_unrounded(spark, sf):
    daily = static_and_cqr_days(spark, sf)
    df = bootstrap.paired_bootstrap(
        daily, KEYS, "cqr", "static", 0.10, 500, 7, round_before_diff=False, digits=None
    )
    return single(df, *BOOT)


@query
def bootstrap_suppliers(spark, sf):
    """Many series: two bands per supplier, resampled by month."""
    bands = supplier_bands(spark, sf).withColumn("ts", F.trunc("ts", "month"))
    wide = bands.withColumn("method", F.lit("wide")).withColumn("upper", F.col("upper") * 1.1)
    both = bands.withColumn("method", F.lit("narrow")).unionByName(wide)
    daily = metrics.daily_sums(both, ["l_suppkey", "method"], 0.10)
    df = bootstrap.paired_bootstrap(daily, ["l_suppkey"], "narrow", "wide", 0.10, 100, 1, digits=None)
    return single(df, *BOOT)


# ablations ----------------------------------------------------------------------------------

@query
def ablation_core_methods(spark, sf):
    return ablation.core_methods(forecasts(spark, sf), KEYS, SETTINGS)


@query
def ablation_gamma_rates(spark, sf):
    return ablation.gamma_rates(forecasts(spark, sf), KEYS, settings=SETTINGS)


@query
def ablation_window_lengths(spark, sf):
    return ablation.window_lengths(forecasts(spark, sf), KEYS, (1, 3, 14), settings=SETTINGS)


@query
def ablation_window_lengths_default(spark, sf):
    """Windows of 14, 28 and 56 days of 48 steps."""
    return ablation.window_lengths(daily_forecasts(spark, sf), KEYS)


@query
def ablation_coverage_levels(spark, sf):
    return ablation.coverage_levels(
        forecasts(spark, sf), KEYS, settings=SETTINGS
    )


@query
def ablation_shift_aware_variations(spark, sf):
    return ablation.shift_aware_variations(forecasts(spark, sf), KEYS, settings=SETTINGS)


@query
def ablation_lag_choice(spark, sf):
    lagged = features.lag_features(cohort_series(spark, sf), KEYS, lags=(48, 336), rolling=False)
    df = ablation.lag_choice(lagged.dropna(subset=["load_lag_336"]), KEYS, "load_kwh")
    return r(df, 6, "residual_variance", "mae", "rmse")


# streams ------------------------------------------------------------------------------------

def replayed(spark: SparkSession, rows: DataFrame, ts: str, keys=()) -> DataFrame:
    """Rows as a bounded stream, with the closing row that lets all of them out."""
    path = fresh_path(spark, "replay")
    stream.with_closing_row(rows, ts, keys).write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def drained(spark, df: DataFrame, name: str) -> DataFrame:
    path = fresh_path(spark, name)
    stream.run_to_files(df, f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema(df.schema).parquet(f"{path}/out")


@query
def stream_cohort_load(spark, sf):
    e = replayed(spark, table(spark, sf, "events").select("user_id", "ts", "value"), "ts").select(
        F.col("user_id").cast("string").alias("household_id"), F.col("ts").alias("timestamp"),
        (F.col("value") / 100).alias("energy_kwh"),
        F.when(F.col("user_id") % 3 == 0, "dToU").otherwise("Std").alias("tariff_group"),
    )
    df = drained(spark, stream.cohort_load_stream(e, "2 hours"), "stream-load")
    return single(df.select("cohort", "ts", "load_kwh", "load_mean_kwh"), "load_kwh", "load_mean_kwh")


@query
def stream_dedup(spark, sf):
    schema = table(spark, sf, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).select(
        F.col("user_id").alias("household_id"), F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("timestamp"),
    )
    return drained(spark, stream.dedup_stream(e, "40 days"), "stream-dedup").select(
        "household_id", stream.zone_free(F.unix_micros("timestamp")).alias("timestamp")
    )


@query
def stream_online_intervals(spark, sf):
    f = forecasts(spark, sf).where("split in ('calibration', 'test')").select(
        "cohort", "ts", "y", "y_pred", (F.col("split") == "calibration").alias("is_calibration")
    )
    out = calibrator.online_intervals(
        replayed(spark, f, "ts"), KEYS, "1 day", sa_acp=SETTINGS.sa_acp, window=240, detector_window=96, reference_length=240
    )
    df = drained(spark, out, "stream-online")
    return single(df.select("cohort", "ts", "method", "lower", "upper"), "lower", "upper")


def two_streams(spark, sf, rows: DataFrame) -> DataFrame:
    """Forecasts and outcomes as streams of their own, joined and calibrated in one query."""
    f = rows.select("cohort", "ts", "y_pred", (F.col("split") == "calibration").alias("is_calibration"))
    outcomes = rows.where("y IS NOT NULL").select("cohort", "ts", "y")
    out = calibrator.online_intervals_of(
        replayed(spark, f, "ts", KEYS), replayed(spark, outcomes, "ts", KEYS), KEYS, "1 day", sa_acp=SETTINGS.sa_acp, window=240,
        detector_window=96, reference_length=240,
    )
    return drained(spark, out, "stream-joined")


@query
def stream_joined_intervals(spark, sf):
    df = two_streams(spark, sf, forecasts(spark, sf).where("split in ('calibration', 'test')"))
    return single(df.select("cohort", "ts", "method", "lower", "upper"), "lower", "upper")


@query
def stream_with_missing_outcomes(spark, sf):
    """Outcomes that never come: the forecasts still get their bounds, in the order of time."""
    df = two_streams(spark, sf, unsettled(spark, sf))
    return single(df.select("cohort", "ts", "method", "lower", "upper"), "lower", "upper")
