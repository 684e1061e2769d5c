"""Exact duplicates by streaming deduplication with disk-backed keyed state."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadshape.llm.common import cut, shared_path

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # one bound for all state partitions of an executor, however many there are
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # files as large as what is in them: a store of a few rows would take some 4 MB otherwise
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Bytes of input per state partition, about; a document's state is some hundred bytes.
STATE_BYTES = 8 << 30
#: Digests with copies are broadcast up to this number (44 bytes each), and joined by shuffle beyond.
BROADCAST_DIGESTS = 500_000


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def content(text: str | Column) -> Column:
    """What is compared: the text unchanged; NULL counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def digests(text: str | Column) -> list[Column]:
    """SHA-256, and a second, independent hash that keeps texts apart should two ever share the first."""
    return [F.unhex(F.sha2(content(text), 256)).alias("digest"), F.xxhash64(content(text)).alias("second")]


def locator() -> Column:
    """Where a row's content lies: file, and row in the file."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def keep_state(stream: DataFrame, key: str, text: str, folder: str, input_bytes: int = 0) -> DataFrame:
    """Run ``stream`` (a streaming read of files) through the keyed state in ``folder`` and return the state.

    Per digest the state holds the number of texts met, the largest ``key`` and that row's locator, never
    content.  It is RocksDB on the executors' disks with its change files in ``folder``, has no expiry, and is
    taken up again by the next call with the same folder: only files that have come since are read then.
    The state has a partition per ``STATE_BYTES`` of ``input_bytes``, and one per core at least; the first call decides.
    """
    spark = stream.sparkSession
    partitions = max(spark.sparkContext.defaultParallelism, -(-input_bytes // STATE_BYTES))
    met = (
        stream.select(*digests(text), F.col(key).alias("key"), locator().alias("at"))
        .groupBy("digest", "second")
        .agg(F.max(F.struct("key", "at")).alias("keep"), F.count(F.lit(1)).alias("n"))
    )
    with _settings(spark, STATE | {"spark.sql.shuffle.partitions": str(partitions)}):
        run = (
            met.writeStream.format("noop").outputMode("update").trigger(availableNow=True)
            .option("checkpointLocation", folder).start()
        )
        run.awaitTermination()
        held = spark.read.format("statestore").load(folder)
        keep, n = (f"value.`{f.name}`" for f in held.schema["value"].dataType.fields)
        # read here, while the settings name the store that the state is in
        return cut(held.select("key.digest", "key.second", F.col(keep).alias("keep"), F.col(n).alias("n")))


def exact_duplicates(docs: DataFrame, stream: DataFrame, key: str, text: str, folder: str) -> DataFrame:
    """(key, keep, group_size, kept, digest) for every row of ``docs``, of which ``stream`` is the streaming read.

    Equal texts are one group, of which the row with the largest ``key`` stays; of rows that tie in it, the one
    whose locator is largest.  NULL texts count as empty; a NULL key is smaller than any other.  Hits - rows
    whose digest has copies - are compared by their full bytes: grouped by the text itself, with copies merged
    before the shuffle.  Should two texts share SHA-256, the second hash keeps them apart; should they share both,
    an error is raised rather than a text lost.  Texts of any length are hashed and compared whole.  Other columns of
    ``docs`` play no part, whatever their names.  An empty table gives an empty result.
    """
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    groups = keep_state(stream, key, text, folder, size)
    copied = groups.where("n > 1").select("digest", "second")
    rows = docs.select(*digests(text), F.col(key).alias("key"), content(text).alias("text"), locator().alias("at"))
    if copied.count() <= BROADCAST_DIGESTS:
        hits = rows.join(F.broadcast(copied), ["digest", "second"], "left_semi").groupBy("digest", "second", "text")
        texts = hits.agg(F.count(F.lit(1)).alias("n"))
    else:
        texts = rows.groupBy("digest", "second", "text").agg(F.count(F.lit(1)).alias("n"))
        texts = texts.join(copied, ["digest", "second"], "left_semi")
    checked = texts.groupBy("digest", "second").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n_checked"))
    groups = groups.join(checked, ["digest", "second"], "left")
    sound = F.coalesce((F.col("texts") == 1) & (F.col("n_checked") == F.col("n")), F.col("n") == 1)
    size = F.when(sound, F.col("n")).otherwise(F.raise_error(F.lit("different texts share both hashes")))
    verdicts = groups.select("digest", "second", "keep", size.cast("long").alias("group_size"))
    return rows.drop("text").join(verdicts, ["digest", "second"]).select(
        F.col("key").alias(key),
        F.col("keep.key").alias("keep"),
        "group_size",
        (F.col("at") == F.col("keep.at")).alias("kept"),
        "digest",
    )


def deduplicate_files(spark: SparkSession, path: str, key: str, text: str, folder: str | None = None) -> DataFrame:
    """``exact_duplicates`` of a Parquet table; ``folder`` keeps the state for later runs."""
    docs, path = spark.read.parquet(path), path.rstrip("/")
    # a stream reads folders; as a pattern, the path may be a single file as well
    stream = spark.readStream.schema(docs.schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return exact_duplicates(docs, stream, key, text, folder or shared_path(spark, "exact-state"))
