"""Sharding by sampled splitters: ranges of near equal size, overfull ones subdivided."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadshape.llm.common import cut, without

#: Rows that one range holds, about: bounds what a task numbers, and with the input sets the number of ranges.
RANGE_ROWS = 250_000
#: Ranges per shard at least, and sample rows per range.
PER_SHARD, PER_RANGE = 64, 16


def _range_of(key: Column, splitters: list[int]) -> Column:
    """How many splitters are at or below ``key``: a binary search without branches over a literal array."""
    steps = max(1, len(splitters).bit_length())
    padded = F.lit(splitters + [(1 << 63) - 1] * ((1 << steps) - 1 - len(splitters)))
    at = F.lit(0)
    halves = F.array(*[F.lit(1 << s) for s in reversed(range(steps))])
    return F.aggregate(halves, at, lambda low, half: F.when(F.get(padded, low + half - 1) <= key, low + half).otherwise(low))


def assign_shards(
    df: DataFrame, size: Column, group: Column, tie: Column, shards: int = 24, overfull: float = 1.5
) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (0, 1, ... within the shard), all shards of near equal size.

    ``size`` is a row's size, above 0.  Rows are laid out by a 64-bit hash of ``group``, so rows of one group
    are neighbours; splitters are quantiles of a sample in which a row's chance grows with its size.  The
    exact sizes of the ranges between splitters are then measured, ranges above ``overfull`` times the mean size, or times
    ``RANGE_ROWS`` rows (a group with very many rows, however small) are subdivided by a hash of ``tie``, and the pieces in order are dealt to shards
    by their exact running total.  A shard so differs from the mean by a piece at most.  Rows are numbered within a
    piece, whose number of rows is bounded, and pieces are numbered by their exact counts.

    NULL is a value like any other in ``group`` and ``tie``; rows equal in both can't be told apart and stay in one
    piece, in an order of no meaning.  An empty table gives an empty result; with fewer rows than shards some shards
    are empty.  Columns named ``shard`` or ``slot`` are replaced, all others kept, whatever their names.
    """
    kept = without(df, "shard", "slot").columns
    # packed, so that no column of ``df`` meets one of those below
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), size.cast("long").alias("_size"), F.xxhash64(group).alias("_key"),
        F.xxhash64(tie, F.lit(1)).alias("_tie"),
    )
    keys = cut(rows.select("_size", "_key", "_tie"))
    n, total = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(0))).first()
    ranges = max(shards * PER_SHARD, math.ceil(n / RANGE_ROWS))

    draw = F.shiftrightunsigned(F.xxhash64("_key", "_tie", F.lit(2)), 11) / float(1 << 53)
    sampled = keys.where(draw * float(max(total, 1)) < F.col("_size") * float(ranges * PER_RANGE))
    quantiles = [i / ranges for i in range(1, ranges)]
    found = sampled.agg(F.percentile_approx("_key", quantiles, 20 * ranges)).first()[0] or []
    splitters = sorted(set(found))

    keys = keys.withColumn("_range", _range_of(F.col("_key"), splitters))
    share = total / ranges
    row_share = max(n / ranges, RANGE_ROWS)
    sizes = keys.groupBy("_range").agg(F.sum("_size").alias("s"), F.count(F.lit(1)).alias("n"))
    pieces_of = {
        r: max(math.ceil(s / share), math.ceil(k / row_share))
        for r, s, k in sizes.where((F.col("s") > overfull * share) | (F.col("n") > overfull * row_share)).collect()
    }

    def piece(r: Column, t: Column) -> Column:
        if not pieces_of:
            return F.lit(0).cast("long")
        many = F.create_map(*[F.lit(x) for pair in pieces_of.items() for x in pair])
        return F.pmod(t, F.coalesce(F.get(F.array(F.try_element_at(many, r)), F.lit(0)), F.lit(1)).cast("long"))

    measured = (
        keys.groupBy("_range", piece(F.col("_range"), F.col("_tie")).alias("_piece"))
        .agg(F.sum("_size").alias("size"), F.count(F.lit(1)).alias("rows"))
        .orderBy("_range", "_piece")
        .collect()
    )
    plan, before, slots = [], 0, [0] * shards
    for m in measured:
        shard = min(shards - 1, (2 * before + m["size"]) * shards // (2 * max(total, 1)))
        plan.append((m["_range"], m["_piece"], shard, slots[shard]))
        slots[shard] += m["rows"]
        before += m["size"]
    spark = df.sparkSession
    plan = spark.createDataFrame(plan, "_range int, _piece long, shard int, _at long").coalesce(1)

    rows = rows.withColumn("_range", _range_of(F.col("_key"), splitters))
    rows = rows.withColumn("_piece", piece(F.col("_range"), F.col("_tie")))
    within = F.row_number().over(Window.partitionBy("_range", "_piece").orderBy("_key", "_tie"))
    # the plan has a row per piece: at most twice the number of ranges, and ranges hold a quarter million rows
    placed = rows.withColumn("_place", within).join(F.broadcast(plan) if len(measured) <= 1 << 20 else plan, ["_range", "_piece"])
    return placed.select("_row.*", "shard", (F.col("_at") + F.col("_place") - 1).alias("slot"))


def write_shards(df: DataFrame, path: str, shard: str = "shard", slot: str = "slot", rows_per_file: int = 1_000_000) -> None:
    """One folder per shard, each of files in slot order.

    Rows are dealt to tasks by shard and by stretches of slots, so a shard of any size is written by many tasks.
    """
    stretch = F.floor(F.col(slot) / rows_per_file)
    (
        df.repartition(shard, stretch)
        .sortWithinPartitions(shard, slot)
        .write.option("maxRecordsPerFile", rows_per_file)
        .partitionBy(shard)
        .parquet(path)
    )
