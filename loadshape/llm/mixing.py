"""Mixing sources to target weights: temperature, and budgets realised as permutations of blocks."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadshape.llm.common import cut, without

#: Sources are weighed on the driver, with one number each.
MAX_SOURCES = 1_000_000
#: Blocks (some 60 bytes each) that are broadcast at most.
BROADCAST_BLOCKS = 300_000


@dataclass(frozen=True)
class Mix:
    """An exponent, and per source its tokens and normalised weight, in the order of the tokens given."""

    exponent: float
    weights: tuple[float, ...]


def weights_at(tokens: Sequence[float], exponent: float) -> list[float]:
    """Token shares to the power ``exponent``, normalised; sources without tokens weigh nothing."""
    total = sum(tokens)
    powers = [(t / total) ** exponent if t > 0 else 0.0 for t in tokens]
    scale = sum(powers)
    return [p / scale for p in powers]


def entropy(weights: Sequence[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def repetition(tokens: Sequence[float], weights: Sequence[float]) -> float:
    """How often the most repeated source is read while the least repeated one is read once."""
    rates = [w / t for t, w in zip(tokens, weights) if t > 0]
    return max(rates) / min(rates)


def solve(
    tokens: Sequence[float], target_entropy: float | None = None, max_repetition: float | None = None, steps: int = 60
) -> Mix:
    """The exponent from 0 (all sources alike) to 1 (as they are) that meets the target, by bisection.

    Entropy falls and repetition falls as the exponent grows.  The largest exponent with at least
    ``target_entropy`` nats is taken, or the smallest with at most ``max_repetition``; a target that no exponent meets
    gives the nearest end.
    """
    if (target_entropy is None) == (max_repetition is None):
        raise ValueError("give a target entropy or a repetition limit")
    if sum(tokens) <= 0:
        return Mix(1.0, tuple(0.0 for _ in tokens))
    low, high = 0.0, 1.0
    if target_entropy is not None:
        met = lambda a: entropy(weights_at(tokens, a)) >= target_entropy
        if met(high):
            low = high
    else:
        met = lambda a: repetition(tokens, weights_at(tokens, a)) > max_repetition
        if not met(low):
            high = low
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if met(middle) else (low, middle)
    exponent = low if target_entropy is not None else high
    return Mix(exponent, tuple(weights_at(tokens, exponent)))


def count_tokens(text: str | Column) -> Column:
    """Words of a text; NULL has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(
    df: DataFrame,
    source: str,
    tokens: Column,
    identity: Column,
    target_entropy: float | None = None,
    max_repetition: float | None = None,
    budget: int | None = None,
    block_tokens: int = 1 << 20,
    seed: int = 7,
) -> DataFrame:
    """The rows to read, in blocks: ``df`` with ``epoch``, ``block``, ``block_rank`` and ``tokens``, a row per reading.

    Sources get weights by temperature (``solve``).  ``budget`` tokens are shared out by weight; without one, the
    budget is the least that reads every source at least once, so no row is lost.  The rows of a source
    are dealt to blocks of about ``block_tokens`` by a hash of ``identity``; an epoch is a permutation of the source's
    blocks.  A source whose budget is e times its tokens is read floor(e) times whole, and of the next epoch as many
    blocks as fit, in that epoch's order; the block at the edge is read up to the row that passes the budget.
    ``block_rank`` orders all blocks of all sources: evenly by the part of the source's budget that lies before them.

    A NULL source is a source.  Rows without tokens go with the first block of each epoch they hash to.  Ties and
    repeated rows are read like others (equal rows stay in one block).  An empty table gives an empty result.
    Columns of the names added are replaced, all others kept, whatever their names.
    """
    names = "epoch", "block", "block_rank", "tokens"
    kept = without(df, *names).columns
    # packed, so that no column of ``df`` meets one of those below
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), tokens.alias("tokens"), F.col(source).alias("_source"),
        F.xxhash64(identity, F.lit(seed)).alias("_id"),
    )
    sums = rows.groupBy("_source").agg(F.sum("tokens").alias("t")).orderBy("_source").limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    have = [s["t"] for s in sums]
    found = solve(have, target_entropy, max_repetition)
    if budget is None:
        budget = max((t / w for t, w in zip(have, found.weights) if w > 0), default=0)
    spark = df.sparkSession
    plan = spark.createDataFrame(
        [
            (s["_source"], float(t), max(1, round(t / block_tokens)), w * budget if t else 0.0)
            for s, t, w in zip(sums, have, found.weights)
        ],
        "_name string, _have double, _blocks long, _budget double",
    ).coalesce(1)
    same = F.col("_source").cast("string").eqNullSafe(F.col("_name"))

    # one row per block: what it holds, and how often it is read
    dealt = rows.join(F.broadcast(plan) if len(sums) <= 100_000 else plan, same).withColumn("block", F.pmod("_id", "_blocks"))
    blocks = dealt.groupBy("_name", "block").agg(
        F.sum("tokens").alias("_held"), F.first("_have").alias("_have"), F.first("_budget").alias("_budget")
    )
    # a few millionths of a token are rounding, not an epoch
    whole = F.when(F.col("_have") > 0, F.floor(F.col("_budget") / F.col("_have") + 1e-9)).otherwise(1)
    epochs = F.when(F.col("_have") > 0, F.ceil(F.col("_budget") / F.col("_have") - 1e-9)).otherwise(1)
    turn = blocks.withColumns({"_whole": whole, "epoch": F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(epochs, F.lit(1)) - 1))})
    order = Window.partitionBy("_name", "epoch").orderBy(F.xxhash64("_name", "epoch", "block", F.lit(seed)), "block")
    turn = turn.withColumn("_before", F.sum("_held").over(order) - F.col("_held") + F.col("epoch") * F.col("_have"))
    turn = turn.withColumn(
        "_left", F.when(F.col("epoch") < F.col("_whole"), F.lit(math.inf)).otherwise(F.col("_budget") - F.col("_before"))
    ).where(F.col("_left") > 0)
    turn = turn.withColumn("block_rank", F.col("_before") / F.greatest(F.col("_budget"), F.lit(1.0)))
    turn = turn.select(F.col("_name").alias("_n"), F.col("block").alias("_b"), F.col("epoch").cast("int").alias("epoch"), "_left", "block_rank", "_held")

    # a row per block and epoch: some millions for 100 TB; broadcast while they are few
    turn = cut(turn)
    turn = F.broadcast(turn) if turn.count() <= BROADCAST_BLOCKS else turn
    read = dealt.join(turn, F.col("_name").eqNullSafe(F.col("_n")) & (F.col("block") == F.col("_b")))
    # only a block at the edge of a budget needs the order of its rows
    edge = Window.partitionBy("_n", "block", "epoch").orderBy(F.xxhash64("_id", "epoch"), "_id").rowsBetween(
        Window.unboundedPreceding, -1
    )
    cutting = F.col("_left") < F.col("_held")
    part = read.where(cutting).withColumn("_passed", F.coalesce(F.sum("tokens").over(edge), F.lit(0))).where("_passed < _left")
    out = read.where(~cutting).unionByName(part.drop("_passed"))
    return out.select("_row.*", *names)
