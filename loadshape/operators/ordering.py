"""Ordered work on groups of any size.

One series, or one sample, may hold a large share of all rows, so nothing here
sorts a whole group in one task:

* ``positions``      numbers the rows of a series through per-day counts;
* ``chunked``        splits a numbered series into chunks with a halo of the
                     preceding rows, so that window functions see at most
                     ``chunk + halo`` rows;
* ``lookup``         joins one row per group to many, NULL keys included;
* ``ranked_values``  running counts over the distinct values of a group, with
                     large groups cut into value slices;
* ``exact_quantiles`` linear-interpolation quantiles: a sketch brackets them, only
                     values inside the brackets are ordered.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadshape.session import cut_lineage

CHUNK = 4096
# Distinct values that one task orders, about: larger groups are cut into slices of this many.
HOT_MIN = 50_000
# Slices of one group at most (its distinct values then exceed HOT_MIN by this factor).
MAX_SLICES = 1 << 20
# Of a sample of n values the sketch knows ranks to n / ACCURACY; MARGIN allows for four times that.
ACCURACY = 10_000
MARGIN = 4 / ACCURACY
# Steps in which a level that depends on the sample's size is bracketed.
GRID = 1024


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def positions(
    df: DataFrame, keys: Sequence[str], ts: str = "ts", out: str = "seq", span: str = "day"
) -> DataFrame:
    """0-based position of each row in its series, ordered by ``ts``.

    Rows are numbered inside (series, ``span``) and shifted by the count of all
    earlier spans; only the span counts are ordered per series.  ``ts`` must be
    unique within a series, so a day holds at most 86,400 rows at one-second
    resolution; use ``span='hour'`` for finer data.
    """
    keys = list(keys)
    part = F.date_trunc(span, F.col(ts))
    counts = df.groupBy(*keys, part.alias("_span")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        *keys, "_span", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    local = F.row_number().over(Window.partitionBy(*keys, "_span").orderBy(ts))
    numbered = df.withColumn("_span", part).withColumn("_local", local)
    left, right = numbered.alias("l"), offsets.alias("r")
    on = _all([F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_span"]])
    return left.join(right, on).select(
        *[F.col(f"l.{c}") for c in df.columns if c != out],
        (F.col("r._before") + F.col("l._local") - 1).cast("long").alias(out),
    )


def grid_positions(
    df: DataFrame, start, step_minutes: int, ts: str = "ts", out: str = "seq"
) -> DataFrame:
    """Position on a regular grid: no shuffle.  Equals ``positions`` for gap-free series."""
    gap = F.timestamp_diff("MICROSECOND", F.lit(start).cast("timestamp_ntz"), F.col(ts))
    return df.withColumn(out, F.floor(gap / F.lit(step_minutes * 60_000_000)).cast("long"))


def chunked(
    df: DataFrame, halo: int, seq: str = "seq", chunk: int = CHUNK
) -> DataFrame:
    """Add ``_chunk`` and ``_halo``: each chunk also gets the ``halo`` rows before it.

    Window over ``keys + ['_chunk']`` ordered by ``seq``, then keep ``~_halo``.
    """
    chunk = max(chunk, halo, 1)
    own = F.floor(F.col(seq) / chunk).cast("long")
    serves = F.floor((F.col(seq) + halo) / chunk).cast("long")
    both = F.when(serves > own, F.array(own, serves)).otherwise(F.array(own))
    return df.withColumn("_chunk", F.explode(both)).withColumn(
        "_halo", F.col("_chunk") != own
    )


def chunk_window(keys: Sequence[str], seq: str = "seq"):
    return Window.partitionBy(*keys, "_chunk").orderBy(seq)


def unchunk(df: DataFrame) -> DataFrame:
    return df.where(~F.col("_halo")).drop("_chunk", "_halo")


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join ``table`` (one row per group) to ``df``; a NULL key is a group like any other.

    Plain equality on all keys, so Spark broadcasts a side that it has measured to be small, and
    cuts the partition of a group with very many rows when it joins by shuffle.
    """
    keys = list(keys)
    left, right = df.alias("_l"), table.alias("_r")
    joined = left.join(right, _all([F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in keys]), how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.select("_l.*", *[F.col(f"_r.{c}") for c in table.columns if c not in keys])


def _with_slice(df: DataFrame, value: str) -> DataFrame:
    """Add ``_slice``: the number of ``_cuts`` at or below the value, -1 where there are none.

    A binary search by halving steps; reads past the end are NULL and move nothing.
    """
    steps = F.array(*[F.lit(MAX_SLICES >> i) for i in range(MAX_SLICES.bit_length())])
    found = F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.get("_cuts", at + step - 1) <= F.col(value), at + step).otherwise(at)
    )
    return df.withColumn("_slice", F.when(F.col("_cuts").isNull(), F.lit(-1)).otherwise(found)).drop("_cuts")


def ranked_values(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    counts: Mapping[str, Column] | None = None,
    hot_min: int = HOT_MIN,
) -> DataFrame:
    """Distinct values of each group with counts, running counts and totals.

    For every name ``c`` in ``counts`` (default ``n`` = rows) the result has
    ``c``, ``cum_c`` (through this value) and ``total_c``, plus ``next_value``.
    Equal values are merged before anything is ordered.  A group of more than ``hot_min`` distinct
    values is cut into slices of about that many at a hash sample of its own values, so
    no task orders more, whatever the group's size; the sample is a pure function of
    the data, so recomputed tasks cut at the same places.
    """
    keys = list(keys)
    counts = dict(counts or {"n": F.lit(1)})
    merged = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("value"))
        .agg(*[F.sum(c).cast("long").alias(name) for name, c in counts.items()])
    )
    # every branch below uses all columns of ``merged``, so they share its shuffle
    sizes = merged.groupBy(*keys).agg(
        F.count("*").alias("_distinct"), *[F.sum(n).alias(f"_all_{n}") for n in counts]
    )
    hot = sizes.where(F.col("_distinct") > hot_min)
    sampled = lookup(merged, hot.select(*keys), keys, "left_semi").where(F.pmod(F.xxhash64("value"), F.lit(hot_min)) == 0)
    points = sampled.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("value", *counts))).alias("_p"))
    cuts = points.select(*keys, F.col("_p.value").alias("_cuts"))
    sliced = _with_slice(lookup(merged, cuts, keys, "left"), "value")
    slice_sums = sliced.where("_slice >= 0").groupBy(*keys, "_slice").agg(
        F.min("value").alias("_first"),
        *[F.sum(name).alias(f"_sum_{name}") for name in counts],
    )
    over = Window.partitionBy(*keys).orderBy("_slice")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = slice_sums.select(
        *keys,
        "_slice",
        F.lead("_first").over(over).alias("_next_first"),
        *[F.sum(f"_sum_{n}").over(earlier).alias(f"_off_{n}") for n in counts],
        *[F.sum(f"_sum_{n}").over(whole).alias(f"_all_{n}") for n in counts],
    )
    part = Window.partitionBy(*keys, "_slice")
    run = part.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.select(
        *keys,
        "_slice",
        "value",
        *counts,
        F.lead("value").over(part.orderBy("value")).alias("_next"),
        *[F.sum(n).over(run).alias(f"_run_{n}") for n in counts],
        *[F.sum(n).over(part).alias(f"_tot_{n}") for n in counts],
    )
    return lookup(local, offsets, [*keys, "_slice"], "left").select(
        *keys,
        "value",
        F.coalesce("_next", "_next_first").alias("next_value"),
        *counts,
        *[
            (F.col(f"_run_{n}") + F.coalesce(F.col(f"_off_{n}"), F.lit(0))).alias(f"cum_{n}")
            for n in counts
        ],
        *[F.coalesce(f"_all_{n}", f"_tot_{n}").alias(f"total_{n}") for n in counts],
    )


Level = float | Callable[[Column], Column]


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, levels: Mapping[str, Level], count: str | None = None,
    also: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Linear-interpolation quantiles per group; a level may depend on the group size.

    A mergeable sketch brackets the ranks that are wanted, the values below each bracket are counted, and
    only the values inside are ordered: a thousandth of the group for a plain level, three
    thousandths for one that depends on the size, equal values merged.  A group too small
    for the sketch to tell its ranks apart lies in its brackets as a whole.  ``also`` adds aggregates of the values
    that are present, taken in the pass of the sketch.  Should a rank ever lie outside its bracket, the query stops.

    The sketch runs when this is called: its brackets, a row per group, are written, so that Spark knows their size
    when it joins them to the rows, and no task sorts a whole group where there are few.
    """
    keys, names, also = list(keys), list(levels), dict(also or {})
    present = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    points = sorted({min(1.0, max(0.0, float(lv) + d)) for lv in levels.values() if not callable(lv) for d in (-MARGIN, MARGIN)})
    grid = len(points)  # place of the grid's first step
    if any(callable(lv) for lv in levels.values()):
        points += [i / GRID for i in range(GRID + 1)]
    total = F.col("_n")
    wanted = F.expr(f"array({', '.join(f'{x!r}D' for x in points)})")
    sketch = present.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.percentile_approx("_v", wanted, F.lit(ACCURACY)).alias("_q"),
        *[c.alias(n) for n, c in also.items()],
    )
    sure = total > ACCURACY
    ends, ranks = {}, {}
    for i, (name, level) in enumerate(levels.items()):
        if callable(level):
            share = level(total)
            low, high = F.floor((share - MARGIN) * GRID).cast("int"), F.ceil((share + MARGIN) * GRID).cast("int")
            low_end = F.when(low >= 0, F.get("_q", low + grid))
            high_end = F.when(high <= GRID, F.get("_q", high + grid))
        else:
            share, low, high = F.lit(float(level)), float(level) - MARGIN, float(level) + MARGIN
            low_end = F.get("_q", F.lit(points.index(low))) if low > 0 else F.lit(None)
            high_end = F.get("_q", F.lit(points.index(high))) if high < 1 else F.lit(None)
        ends[f"_low_{i}"], ends[f"_high_{i}"] = F.when(sure, low_end), F.when(sure, high_end)
        ranks[f"_rank_{i}"] = (total - 1) * share
    brackets = cut_lineage(sketch.select(*keys, "_n", *also, *[c.alias(n) for n, c in {**ends, **ranks}.items()]), "brackets")
    placed = lookup(present, brackets, keys)
    each = range(len(names))
    under = [F.coalesce(F.col("_v") < F.col(f"_low_{i}"), F.lit(False)) for i in each]
    over = [F.coalesce(F.col("_v") > F.col(f"_high_{i}"), F.lit(False)) for i in each]
    inside = F.filter(F.array(*[F.when(~under[i] & ~over[i], F.lit(i)) for i in each]), lambda x: x.isNotNull())
    # values inside a bracket one by one, all others merged by the brackets that they lie below
    merged = (
        placed.select(
            *keys, "_n", *also, *ranks, F.when(F.size(inside) > 0, F.col("_v")).alias("_v"), inside.alias("_in"), F.array(*under).alias("_under")
        )
        .groupBy(*keys, "_v", "_in", "_under")
        .agg(F.count("*").alias("_c"), *[F.first(c).alias(c) for c in ("_n", *also, *ranks)])
    )
    group = Window.partitionBy(*keys)
    upto = Window.partitionBy(*keys, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    known = (
        merged.withColumn(
            "_below", F.array(*[F.sum(F.when(F.get("_under", F.lit(i)), F.col("_c")).otherwise(0)).over(group) for i in each])
        )
        .withColumn("_i", F.explode_outer("_in"))
        .withColumn("_upto", F.sum("_c").over(upto))
        .withColumn("_h", F.get(F.array(*[F.col(r) for r in ranks]), F.col("_i")))
        .withColumn("_through", F.col("_upto") + F.get("_below", F.col("_i")))
    )
    before = F.col("_through") - F.col("_c")

    def at(rank: Column) -> Column:
        return (before <= rank) & (rank < F.col("_through"))

    lo, hi = F.floor("_h"), F.ceil("_h")
    found = known.groupBy(*keys).agg(
        F.max("_n").alias("_count"), *[F.first(c).alias(c) for c in also],
        *[
            c
            for i in each
            for c in (
                F.max(F.when((F.col("_i") == i) & at(lo), F.col("_v"))).alias(f"_lo_{i}"),
                F.max(F.when((F.col("_i") == i) & at(hi), F.col("_v"))).alias(f"_hi_{i}"),
                F.max(F.when(F.col("_i") == i, F.col("_h") - lo)).alias(f"_frac_{i}"),
            )
        ],
    )
    def checked(i: int) -> Column:
        met = F.col(f"_lo_{i}").isNotNull() & F.col(f"_hi_{i}").isNotNull()
        between = F.col(f"_lo_{i}") + F.col(f"_frac_{i}") * (F.col(f"_hi_{i}") - F.col(f"_lo_{i}"))
        return F.when(met, between).otherwise(F.raise_error(F.lit("a quantile lies outside its bracket")))

    return found.select(
        *keys,
        *[checked(i).alias(n) for i, n in enumerate(names)],
        *also,
        *([F.col("_count").alias(count)] if count else []),
    )
