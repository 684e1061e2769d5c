"""SimHash near duplicates: fingerprints, links by pigeonring filtering, classes by connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadshape.llm.common import components, cut, without

BITS = 64
SEGMENTS = 4
WIDTH = BITS // SEGMENTS
#: Shingles hashed at a time: bounds the memory a very long text takes.
CHUNK = 1 << 16


def _fingerprint(text: str | None, words_per_shingle: int) -> int:
    """64-bit SimHash of a text's word shingles, as a signed integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and ASCII space only
    if not words:
        return 0
    n = max(1, len(words) - words_per_shingle + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        part = [
            xxhash.xxh64_intdigest(b" ".join(words[i : i + words_per_shingle]), 42) for i in range(at, min(n, at + CHUNK))
        ]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, text: str = "text", words_per_shingle: int = 3, out: str = "fp") -> DataFrame:
    """``df`` with the SimHash of ``text`` as a signed 64-bit integer; an empty or NULL text has 0.

    ASCII letters are lowered, words are runs without ASCII white space, shingles are consecutive words
    joined by a space, repeats included; a text with fewer words is one shingle.  A bit is 1 if it is set in
    over half the shingles' XXH64 (seed 42).
    """

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([_fingerprint(t, words_per_shingle) for t in texts], dtype="int64")

    return without(df, out).withColumn(out, fp(F.col(text)))


def _segment(fp: str | Column, i: int) -> Column:
    fp = F.col(fp) if isinstance(fp, str) else fp
    return F.shiftrightunsigned(fp, WIDTH * (i % SEGMENTS)).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("long"))


def _key(ring: int, first: Column, second: Column) -> Column:
    """Position on the ring and two segments in one integer."""
    return F.lit(ring << (2 * WIDTH)).cast("long") + F.shiftleft(first, WIDTH) + second


def _chain_holds(x: Column, ring: int, max_distance: int) -> Column:
    """Every prefix of the chain that starts at ``ring`` keeps within its share of the distance."""
    held, total = F.lit(True), F.lit(0)
    for length in range(1, SEGMENTS + 1):
        total = total + F.bit_count(_segment(x, ring + length - 1))
        held = held & (total <= F.lit(max_distance * length // SEGMENTS))
    return held


def links(prints: DataFrame, max_distance: int = 3) -> DataFrame:
    """(a, b): links that connect the same distinct fingerprints as all pairs within ``max_distance`` bits do.

    ``prints`` has one column ``fp`` without repeats or NULLs.  First, fingerprints that differ in one bit meet
    under their value with that bit masked; such a group has two members at most, so dense clouds of near copies
    are joined into classes by a number of rows in proportion to the fingerprints.  Then the pigeonring: the 64
    bits are a ring of 4 segments, and of two fingerprints within ``d`` bits some chain of consecutive segments
    keeps, for every prefix of l segments, to at most ``d*l/4`` differing bits.  For 3 bits the first
    two segments of the chain differ in 0 and at most 1 bits: one side is filed under those 32 bits, the other
    looks under the 17 values within a bit.  Pairs met must satisfy the whole chain before the full Hamming
    distance, which the last prefix is; pairs that one class holds already are left out.  No pair is lost: a
    pair of one class is connected.
    """
    if not 0 <= max_distance <= 3:
        raise ValueError("the chain keys hold for 0 to 3 differing bits")
    # each fingerprint becomes 64 rows below: the table is small, its partitions must not be few
    prints = cut(prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp"))
    empty = prints.where("false").select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    if max_distance == 0:
        return empty
    all_but = [(1 << 63) - 1 if b == BITS - 1 else ~(1 << b) for b in range(BITS)]
    masked = prints.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in all_but])).alias("bit", "rest")
    )
    near = cut(
        masked.groupBy("bit", "rest")
        .agg(F.min("fp").alias("a"), F.max("fp").alias("b"))
        .where("a <> b")
        .select("a", "b")
    )
    if max_distance == 1:
        return near
    classes = components(near).select(F.col("node").alias("fp"), "component")
    known = cut(prints.join(classes, "fp", "left").select("fp", F.coalesce("component", "fp").alias("class")))
    one_bit = [0] + [1 << b for b in range(WIDTH)]
    filed = known.select(
        F.col("fp").alias("a"), F.col("class").alias("class_a"),
        F.explode(F.array(*[_key(i, _segment("fp", i), _segment("fp", i + 1)) for i in range(SEGMENTS)])).alias("key"),
    )
    sought = known.select(
        F.col("fp").alias("b"), F.col("class").alias("class_b"),
        F.explode(
            F.array(*[
                _key(i, _segment("fp", i), _segment("fp", i + 1).bitwiseXOR(F.lit(x).cast("long")))
                for i in range(SEGMENTS) for x in one_bit
            ])
        ).alias("key"),
    )
    differ, ring = F.col("a").bitwiseXOR(F.col("b")), F.shiftrightunsigned(F.col("key"), 2 * WIDTH)
    held = F.lit(False)
    for i in range(SEGMENTS):
        held = held | ((ring == i) & _chain_holds(differ, i, max_distance))
    far = filed.join(sought, "key").where((F.col("class_a") < F.col("class_b")) & held)
    # between two classes one link is enough
    far = far.groupBy("class_a", "class_b").agg(F.min(F.struct("a", "b")).alias("l")).select("l.a", "l.b")
    return near.unionByName(far)


def classes(prints: DataFrame, max_distance: int = 3) -> DataFrame:
    """(fp, component) for every distinct fingerprint of ``prints``: the smallest one reachable over links."""
    distinct = prints.select("fp").distinct()
    found = components(links(distinct, max_distance))
    return distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("component")
    )


def near_duplicates(
    df: DataFrame, key: str, text: str = "text", words_per_shingle: int = 3, max_distance: int = 3
) -> DataFrame:
    """(key, fp, component, n_copies): per row its fingerprint and the smallest ``key`` reachable over links.

    Rows with one fingerprint are linked; they are merged before the search, so a group of copies of any size is
    one entry.  Rows with NULL ``key`` take part; a class without any key has a NULL component.  Repeated
    rows come out as often as they come in.  An empty table gives an empty result.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = cut(fingerprints(rows, "text", words_per_shingle).select("key", "fp"))
    distinct = rows.groupBy("fp").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n"))
    linked = distinct.join(classes(distinct, max_distance), "fp")
    totals = linked.groupBy("component").agg(F.min("least").alias("first"), F.sum("n").alias("n_copies"))
    by_print = linked.join(totals, "component").select("fp", "first", "n_copies")
    return rows.join(by_print, "fp").select(F.col("key").alias(key), "fp", F.col("first").alias("component"), "n_copies")


def deduplicate(
    df: DataFrame, key: str, text: str = "text", words_per_shingle: int = 3, max_distance: int = 3
) -> DataFrame:
    """``df`` with one row of each class of copies and near copies, columns as they are, whatever their names.

    Two rows are linked if their fingerprints differ in at most ``max_distance`` bits; a class is what links connect.  Of
    each class the row with the smallest ``key`` stays (a NULL key comes last, ties by the text's hash), and of rows equal
    in key and text one.  NULL and empty texts are equal.  An empty table gives an empty result.
    """
    digest = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest")
    named = df.select(F.col(key).alias("key"), F.col(text).alias("text"), digest)
    prints = cut(fingerprints(named, "text", words_per_shingle).select("key", "digest", "fp"))
    rank = F.struct(F.col("key").isNull().alias("none"), "key", "digest")
    by_print = prints.groupBy("fp").agg(F.min(rank).alias("first"))
    kept = (
        by_print.join(classes(by_print, max_distance), "fp")
        .groupBy("component")
        .agg(F.min("first").alias("first"))
        .select(F.col("first.key").alias("kept_key"), F.col("first.digest").alias("kept_digest"))
    )
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(key).alias("key"), digest)
    rows = rows.join(kept, F.col("key").eqNullSafe(F.col("kept_key")) & (F.col("digest") == F.col("kept_digest")), "left_semi")
    return rows.dropDuplicates(["key", "digest"]).select("row.*")
