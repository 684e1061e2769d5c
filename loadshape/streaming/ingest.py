"""Readings as a stream: deduplication and half-hourly cohort load."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import TimestampNTZType

from loadshape.operators.cohorts import LOAD_COLUMNS, cohort_aggregates, tariff_cohorts


def event_time(df: DataFrame, ts: str) -> DataFrame:
    """Event-time columns are instants; zone-free times are taken as UTC, whatever the session zone."""
    if isinstance(df.schema[ts].dataType, TimestampNTZType):
        return df.withColumn(ts, F.concat(F.col(ts).cast("string"), F.lit("Z")).cast("timestamp"))
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def zone_free(micros: Column) -> Column:
    """Zone-free UTC time of microseconds since 1970; the inverse of ``event_time``."""
    return F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def with_closing_row(rows: DataFrame, ts: str, keys: Sequence[str] = (), ahead_days: int = 3650) -> DataFrame:
    """A bounded replay with one row more, NULL but for a far later ``ts`` and the ``keys`` of the last row.

    It moves the watermark past every other row, so that all of them come out; it stays in state itself.  Streams that are
    joined need ``keys``: Spark drops rows whose join key is NULL before it looks at their time.  For replays
    only: on a live stream it would put the watermark years ahead, and every row after it would count as late.
    """
    last = rows.agg(F.max(ts).alias(ts), *[F.max_by(k, ts).alias(k) for k in keys])
    last = last.withColumn(ts, F.col(ts) + F.expr(f"interval {int(ahead_days)} days"))
    return rows.unionByName(last, allowMissingColumns=True)


def dedup_stream(
    df: DataFrame, delay: str, keys: Sequence[str] = ("household_id", "timestamp"), ts: str = "timestamp"
) -> DataFrame:
    """First arrival per key; keys are forgotten once the watermark passes them."""
    timed = event_time(df, ts).withWatermark(ts, delay)
    return timed.dropDuplicatesWithinWatermark(list(keys))


def cohort_load_stream(
    df: DataFrame,
    delay: str,
    slot: str = "30 minutes",
    cohorts: Mapping[str, Column] | None = None,
    ts: str = "timestamp",
    value: str = "energy_kwh",
    household: str = "household_id",
) -> DataFrame:
    """Cohort load per slot, emitted when the watermark closes the slot; later rows are dropped.

    Households are counted approximately: exact distinct counts need all ids in
    state.
    """
    def active(member):
        return F.approx_count_distinct(F.when(member, F.col(household)))

    entries = cohort_aggregates(cohorts or tariff_cohorts(), value, active)
    timed = event_time(df, ts).withWatermark(ts, delay)
    wide = timed.groupBy(F.window(ts, slot).alias("_slot")).agg(entries.alias("_cohorts"))
    return (
        wide.select(zone_free(F.unix_micros("_slot.start")).alias("ts"), F.inline("_cohorts"))
        .where("_rows > 0")
        .select("cohort", "ts", *LOAD_COLUMNS)
    )


def join_outcomes(
    forecasts: DataFrame, outcomes: DataFrame, keys: Sequence[str], delay: str, ts: str = "ts", how: str = "inner"
) -> DataFrame:
    """Forecasts with their outcomes as both arrive; state is dropped past the watermark.

    ``how='left'`` keeps forecasts whose outcome never comes: they come out with a NULL outcome once the watermark is past.
    """
    f = event_time(forecasts, ts).withWatermark(ts, delay)
    o = event_time(outcomes, ts).withWatermark(ts, delay)
    return f.join(o, [*keys, ts], how)


#: State on the executors' disks, which ``transformWithState`` asks for; files as large as what is in them.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


def run_to_files(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process everything available now into Parquet files (append, exactly once), with state in RocksDB."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in STATE_STORE}
    try:
        for k, v in STATE_STORE.items():
            conf.set(k, v)
        query = (
            df.writeStream.format("parquet")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
    finally:  # a query keeps the settings it was started with
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    query.awaitTermination()
    return query
