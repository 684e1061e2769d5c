"""Hard negatives of anchors by slot-decomposed selection."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadshape.llm.common import cut
from loadshape.llm.vectors import doubles, finite

#: Rows and anchors that meet in one task at most, about.
ROW_BLOCK = 1 << 14
ANCHOR_BLOCK = 1 << 12
#: Anchors scored at a time inside a task: bounds its memory.
STRIP = 256
#: Scores beyond are held here, so that a hundred times a score is a long.
HELD = 1 << 56


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors, exact up to ``HELD`` and held there."""
    bound = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if bound < 1 << 53:  # sums of this size are exact in doubles, whatever their order
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    wide = a @ b.T if bound < 1 << 63 else a.astype(object) @ b.astype(object).T
    return np.clip(wide, -HELD, HELD).astype(np.int64)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.int64)


def _ordered(keys: pd.Series) -> np.ndarray:
    """Numbers in the order of the keys."""
    return keys.to_numpy() if pd.api.types.is_integer_dtype(keys) else pd.factorize(keys, sort=True)[0]


def _best(scores: np.ndarray, keys: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the positions ``at`` the first ``k`` by falling score, then rising key."""
    if len(at) > k:
        at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
    return at[np.lexsort((keys[at], -scores[at]))][:k]


class _Found:
    """What a task keeps: per anchor (and slot) a few positions of its rows."""

    def __init__(self, right: pd.DataFrame):
        self.right, self.parts = right, []

    def add(self, node: int, slot: int, best: np.ndarray, scores: np.ndarray) -> None:
        self.parts.append((np.full(len(best), node, np.int64), np.full(len(best), slot, np.int32), best, scores[best]))

    def frame(self) -> pd.DataFrame:
        node, slot, at, score = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*self.parts)) if self.parts else [np.zeros(0, np.int64)] * 4
        rows = self.right.iloc[at]
        return pd.DataFrame({"node": node, "slot": slot, "key": rows["key"].to_numpy(), "other": rows["node"].to_numpy(), "score": score})


def _blocks(df: DataFrame, on: list[str], size: int, name: str, spread: str) -> tuple[DataFrame, DataFrame]:
    """``df`` dealt into blocks of about ``size`` rows within the groups ``on``, and the number of blocks per group."""
    parts = df.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(f"{name}s"))
    return df.join(parts, on).withColumn(name, F.pmod(F.xxhash64(spread), F.col(f"{name}s")).cast("int")).drop(f"{name}s"), parts


def _meet(anchors: DataFrame, rows: DataFrame, on: list[str], compare: Callable, schema: str) -> DataFrame:
    """``compare(anchors, rows)`` for every block of anchors with every block of rows of the same group.

    Both sides are sent once per block of the other side; no task holds more than a block of each.
    """
    anchors, anchor_parts = _blocks(anchors, on, ANCHOR_BLOCK, "ab", "node")
    rows, row_parts = _blocks(rows, on, ROW_BLOCK, "rb", "node")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = anchors.join(row_parts, on).withColumn("rb", all_of("rbs")).drop("rbs")
    right = rows.join(anchor_parts, on).withColumn("ab", all_of("abs")).drop("abs")
    keys = [*on, "ab", "rb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, schema)


def _first(df: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` per group by falling score, then rising key; Spark takes them before and after the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "key", "other")
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def hard_negatives(
    df: DataFrame, key: str, label: str | Column, vector: str, is_anchor: Column, *, positives: int = 5, negatives: int = 3,
    scale: int = 256, lowest: int = 50, highest: int = 95,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Each entry of a vector, as double, becomes floor(scale * entry); a score is the integer inner product with the
    anchor, higher ones first, ties by smaller key.  Anchors are the rows where ``is_anchor`` holds.  An anchor's positives
    are its first ``positives`` other rows of its label; for each of them the first ``negatives`` rows of other labels
    return that satisfy lowest * positive_score <= 100 * negative_score <= highest * positive_score.

    An anchor's positives set upper limits of its negatives' scores; these split the scores into disjoint slots.  A task
    scores a block of anchors against a block of rows and keeps the first ``negatives`` rows of each slot; the first ones
    over all blocks are taken before and after one shuffle.  The window of a positive is the slots from its own down, so
    its rows are the first of the slots merged from there, less those under its lower limit.

    Rows whose key or label is NULL, or whose vector is NULL, empty or has a NULL or non-finite entry, take no part.
    Vectors of different lengths are never compared.  Rows equal in key, label and vector count once; of rows that share
    a key only, each is a row, and none is a partner of the others.  Entries beyond 31 bits are held there, scores at
    2^56 to either side.  Other columns of ``df`` play no part, whatever their names.  An empty table, or one without
    anchors, gives an empty result.
    """
    if not 0 <= lowest <= highest <= 100:
        raise ValueError("the limits are percentages, the lower one first")
    kind = df.schema[key].dataType.simpleString()
    low, high = -(2.0**31), 2.0**31 - 1
    whole = F.transform(
        doubles(vector),
        lambda c: F.least(F.greatest(F.floor(F.least(F.greatest(c, F.lit(low)), F.lit(high)) * scale), F.lit(int(low))), F.lit(int(high))),
    )
    of = F.col(label) if isinstance(label, str) else label
    rows = cut(
        df.where(finite(vector) & F.col(key).isNotNull())
        .select(F.col(key).alias("key"), of.cast("string").alias("label"), whole.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
        .where("label IS NOT NULL")
        .groupBy("key", "label", "v").agg(F.max("asks").alias("asks"))
        .select("*", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("node"))
    )
    anchors = rows.where("asks").select("dim", "label", "node", "key", "v")
    others = rows.select(*[F.col(c).alias(c) for c in ("dim", "label", "node", "key", "v")])  # columns of their own

    def same_label(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = _Found(right)
        if len(left) and len(right):
            names, keys, vectors = right["key"].to_numpy(), _ordered(right["key"]), _matrix(right["v"])
            for at in range(0, len(left), STRIP):
                some = left.iloc[at : at + STRIP]
                for s, own, node in zip(_scores(_matrix(some["v"]), vectors), some["key"], some["node"]):
                    found.add(node, 0, _best(s, keys, np.nonzero(names != own)[0], positives), s)
        return found.frame()

    schema = f"node long, slot int, key {kind}, other long, score long"
    near = _meet(anchors, others, ["dim", "label"], same_label, schema)
    share = lambda score, percent: F.floor((score * percent - F.pmod(score * percent, F.lit(100))) / 100)
    chosen = (
        _first(near, ["node"], positives)
        .groupBy("node")
        .agg(F.sort_array(F.collect_list(F.struct("place", "key", "score"))).alias("positives"))
    )
    chosen = cut(anchors.join(chosen, "node"))
    asking = chosen.select(
        "dim", "label", "node", "key", "v",
        F.transform("positives", lambda p: share(p["score"], highest)).alias("uppers"),
        share(F.element_at("positives", -1)["score"], lowest).alias("least"),
        share(F.element_at("positives", 1)["score"], lowest).alias("least_of_first"),
    )

    def by_slot(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = _Found(right)
        if len(left) and len(right):
            names, keys, vectors = right["key"].to_numpy(), _ordered(right["key"]), _matrix(right["v"])
            labels, label_of = pd.factorize(right["label"])
            number = {name: i for i, name in enumerate(label_of)}
            for at in range(0, len(left), STRIP):
                some = left.iloc[at : at + STRIP]
                for s, own, label, node, uppers, a, b in zip(
                    _scores(_matrix(some["v"]), vectors), some["key"], some["label"], some["node"], some["uppers"],
                    some["least"], some["least_of_first"],
                ):
                    other = (labels != number.get(label, -1)) & (names != own)
                    allowed = np.nonzero((s >= min(a, b)) & (s <= uppers[0]) & other)[0]
                    # how many of the falling limits a score keeps to: the last window that holds it
                    slots = np.searchsorted(-np.asarray(uppers), -s[allowed], side="right")
                    for slot in np.unique(slots):
                        found.add(node, slot, _best(s, keys, allowed[slots == slot], negatives), s)
        return found.frame()

    in_slots = _meet(asking, others, ["dim"], by_slot, schema)
    merged = (
        _first(in_slots, ["node", "slot"], negatives)
        .groupBy("node")
        # the slots one after another from the highest down: falling score, then rising key
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("falling"), "key", "other", "slot", "score"))).alias("merged"))
    )
    window = lambda p: F.filter(
        F.slice(F.filter("merged", lambda m: m["slot"] >= p["place"]), 1, negatives),
        lambda m: (m["score"] * 100 >= p["score"] * lowest) & (m["score"] * 100 <= p["score"] * highest),
    )
    held = chosen.join(merged, "node").select(F.col("key").alias("anchor"), "merged", F.explode("positives").alias("p"))
    held = held.select("anchor", "p", F.posexplode(window(F.col("p"))).alias("at", "m"))
    return held.select(
        F.col("anchor").alias("anchor_id"),
        F.col("p.key").alias("positive_id"),
        (F.col("at") + 1).cast("int").alias("rank"),
        F.col("m.key").alias("negative_id"),
        F.col("p.score").alias("positive_score"),
        F.col("m.score").alias("negative_score"),
    )
