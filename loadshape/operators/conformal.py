"""Conformal calibrators without recursion: uncalibrated, static, CQR, rolling.

Inputs are forecast rows ``(keys, ts, seq, y, y_pred[, q_lo, q_hi])``; results
add ``lower`` and ``upper``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadshape.functions.columns import (
    absolute_residual,
    band_violation,
    conformal_level,
    conformal_quantile,
    point_band,
    quantile_band,
)
from loadshape.operators.ordering import CHUNK, chunked, exact_quantiles, lookup
from loadshape.session import cut_lineage

# Calibration scores in one row of a sample that is handed over in pieces.
PIECE = 65_536


def is_score(c: Column) -> Column:
    """Whether a score counts: a missing outcome or forecast has none."""
    return c.isNotNull() & ~F.isnan(c)


def calibration_quantiles(
    cal: DataFrame,
    keys: Sequence[str],
    score: Column,
    alphas: Mapping[str, float],
) -> DataFrame:
    """Finite-sample conformal quantile of the calibration scores, one column per alpha.

    The sample of one series may be of any size, see ``exact_quantiles``.
    """
    scored = cal.select(*keys, score.cast("double").alias("_score")).where(is_score(F.col("_score")))
    levels = {name: (lambda n, a=a: conformal_level(n, a)) for name, a in alphas.items()}
    return exact_quantiles(scored, keys, "_score", levels)


def _with_quantile(test, cal, keys, score, alpha):
    # written, so that the join to all test rows knows how few they are
    q = cut_lineage(calibration_quantiles(cal, keys, score, {"conformal_quantile": alpha}), "quantiles")
    joined = lookup(test, q, keys, "left")
    # a series without calibration scores has quantile 0
    return joined.withColumn(
        "conformal_quantile", F.coalesce(F.col("conformal_quantile"), F.lit(0.0))
    )


def uncalibrated_intervals(test: DataFrame, lo: str = "q_lo", hi: str = "q_hi") -> DataFrame:
    """Raw quantile band: [max(0, lo), max(lower, hi)]."""
    lower, upper = quantile_band(lo, hi)
    return test.withColumns({"lower": lower, "upper": upper})


def static_intervals(
    cal: DataFrame, test: DataFrame, keys: Sequence[str], alpha: float = 0.10,
    y: str = "y", pred: str = "y_pred",
) -> DataFrame:
    """Split conformal: [max(0, p - q), p + q] with q from absolute calibration residuals."""
    out = _with_quantile(test, cal, keys, absolute_residual(y, pred), alpha)
    lower, upper = point_band(pred, "conformal_quantile")
    return out.withColumns({"lower": lower, "upper": upper})


def cqr_intervals(
    cal: DataFrame, test: DataFrame, keys: Sequence[str], alpha: float = 0.10,
    y: str = "y", lo: str = "q_lo", hi: str = "q_hi",
) -> DataFrame:
    """Conformalised quantile regression; the correction may be negative."""
    out = _with_quantile(test, cal, keys, band_violation(y, lo, hi), alpha)
    lower, upper = quantile_band(lo, hi, "conformal_quantile")
    return out.withColumns({"lower": lower, "upper": upper})


def pack_calibration(
    cal: DataFrame, keys: Sequence[str], scores: Mapping[str, Column], seq: str = "seq", last: int | None = None
) -> DataFrame:
    """One row per series: calibration scores as arrays in time order, missing ones left out.

    A detector's reference is the end of the sample: ``last`` bounds the arrays to that many scores.  Rows placed by
    ``place_rows`` have their rank among the scores, so only the end is packed.
    """
    if last is not None and "rank" in cal.columns:
        cal = cal.where(F.col("rank") >= -last)
    packed = cal.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(seq, *[c.cast("double").alias(n) for n, c in scores.items()]))).alias("_rows")
    )
    kept = {name: F.filter(F.col(f"_rows.{name}"), is_score) for name in scores}
    if last is not None:
        kept = {n: F.slice(c, F.greatest(F.size(c) - last, F.lit(0)) + 1, F.lit(last)) for n, c in kept.items()}
    return packed.select(*keys, *[c.alias(n) for n, c in kept.items()])


def score_ranks(
    df: DataFrame, keys: Sequence[str], pos: str, score: Column, out: str = "rank", chunk: int = CHUNK
) -> DataFrame:
    """Add how many scores of the series lie before each row; missing ones are not counted.

    Rows are counted per ``chunk`` positions, the counts summed per series, and only a chunk is ordered in one task.
    """
    keys = list(keys)
    one = is_score(score.cast("double")).cast("long")
    marked = df.withColumns({"_one": F.coalesce(one, F.lit(0)), "_span": F.floor(F.col(pos) / chunk)})
    earlier = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = marked.groupBy(*keys, "_span").agg(F.sum("_one").alias("_n"))
    spans = spans.select(*keys, "_span", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_span").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    counted = marked.withColumn("_in", F.coalesce(F.sum("_one").over(inside), F.lit(0)))
    return lookup(counted, spans, [*keys, "_span"]).withColumn(out, F.col("_before") + F.col("_in")).drop(
        "_one", "_span", "_in", "_before"
    )


def calibration_pieces(
    cal: DataFrame, keys: Sequence[str], score: Column, seq: str = "seq", out: str = "_cal", piece: int = PIECE
) -> DataFrame:
    """The calibration scores of each series, sorted within rows of at most ``piece`` steps."""
    scored = cal.select(*keys, F.floor(F.col(seq) / piece).alias("_piece"), score.cast("double").alias("_score"))
    return (
        scored.where(is_score(F.col("_score")))
        .groupBy(*keys, "_piece")
        .agg(F.sort_array(F.collect_list("_score")).alias(out))
        .drop("_piece")
    )


def pack_blocks(
    df: DataFrame, keys: Sequence[str], pos: str, block: int, columns: Mapping[str, Column]
) -> DataFrame:
    """One row per (series, block) with its values as arrays in order of position."""
    grouped = df.groupBy(*keys, F.floor(F.col(pos) / block).cast("long").alias("block"))
    rows = grouped.agg(
        F.sort_array(
            F.collect_list(F.struct(F.col(pos).alias("_pos"), *[c.alias(n) for n, c in columns.items()]))
        ).alias("_rows")
    )
    return rows.select(
        *keys, "block", F.col("_rows._pos").alias("_pos"),
        *[F.col(f"_rows.{n}").alias(n) for n in columns],
    )


def rolling_quantiles(
    cal: DataFrame,
    test: DataFrame,
    keys: Sequence[str],
    windows: Sequence[int] = (1344,),
    block: int = 48,
    alpha: float = 0.10,
    y: str = "y",
    pred: str = "y_pred",
    pos: str = "pos",
    cal_pos: str = "cal_pos",
    chunk: int = CHUNK,
) -> DataFrame:
    """Conformal quantile per (series, test block, window) of the last ``window`` scores before the block.

    ``pos`` counts test rows from 0, ``cal_pos`` counts calibration rows
    backwards from -1; ``rank`` (added by ``place_rows``, counted here where it is missing) does the
    same for scores.  A row without an outcome or a forecast has no score: it takes up
    no place in a window.  Scores are packed per chunk together with the longest
    window before it, and every block's window is a slice of its pack: a score
    is shuffled at most twice, whatever the number of blocks and windows.
    """
    windows = sorted(set(windows))
    longest = windows[-1]
    whole = max(chunk, longest)
    score = absolute_residual(y, pred).cast("double")
    if "rank" not in test.columns:
        test = score_ranks(test, keys, pos, score, "rank")
    if "rank" not in cal.columns:
        total = cal.groupBy(*keys).agg(F.count(F.when(is_score(score), 1)).alias("_total"))
        cal = lookup(score_ranks(cal, keys, cal_pos, score, "rank"), total, keys)
        cal = cal.withColumn("rank", F.col("rank") - F.col("_total"))
    kept = [F.col("rank").cast("long").alias("_rel"), score.alias("_score")]
    seeds = cal.where(F.col("rank") >= -longest).select(*keys, *kept)
    scores = chunked(seeds.unionByName(test.select(*keys, *kept)).where(is_score(F.col("_score"))), longest, "_rel", whole)
    # a block starts after so many scores; its windows lie in the chunk of the last of them, or just before it
    starts = test.groupBy(*keys, F.floor(F.col(pos) / block).cast("long").alias("block")).agg(F.min("rank").cast("long").alias("end"))
    marks = starts.select(
        *keys, F.floor(F.greatest(F.col("end") - 1, F.lit(0)) / whole).cast("long").alias("_chunk"),
        F.struct("block", "end").alias("_mark"),
    )
    entry = F.when(F.col("_score").isNotNull(), F.struct("_rel", "_score"))
    packs = (
        scores.where("_chunk >= 0").drop("_halo").unionByName(marks, allowMissingColumns=True)
        .groupBy(*keys, "_chunk")
        .agg(F.sort_array(F.collect_list(entry)).alias("_rows"), F.collect_list("_mark").alias("_marks"))
    )
    cells = packs.select(
        *keys,
        F.coalesce(F.get("_rows._rel", F.lit(0)), F.lit(0)).alias("_start"),
        F.col("_rows._score").alias("_scores"),
        F.inline("_marks"),
    )
    # a window of the pack: the last scores before the block, as many as there are
    end = F.least(F.greatest(F.col("end") - F.col("_start"), F.lit(0)), F.size("_scores"))
    begin = F.greatest(end - F.col("window"), F.lit(0))
    sliced = cells.withColumn("window", F.explode(F.array(*[F.lit(int(w)) for w in windows]))).select(
        *keys, "block", "window",
        F.sort_array(F.slice("_scores", (begin + 1).cast("int"), (end - begin).cast("int"))).alias("_window"),
    )
    return sliced.select(
        *keys, "block", "window", conformal_quantile("_window", alpha).alias("conformal_quantile")
    )


def rolling_bands(test: DataFrame, quantiles: DataFrame, keys: Sequence[str], block: int, pred: str, pos: str) -> DataFrame:
    placed = test.withColumn("block", F.floor(F.col(pos) / block).cast("long"))
    lower, upper = point_band(pred, "conformal_quantile")
    return lookup(placed, quantiles, [*keys, "block"]).withColumns({"lower": lower, "upper": upper})


def rolling_intervals(
    cal: DataFrame,
    test: DataFrame,
    keys: Sequence[str],
    alpha: float = 0.10,
    window: int = 1344,
    block: int = 48,
    y: str = "y",
    pred: str = "y_pred",
    pos: str = "pos",
    cal_pos: str = "cal_pos",
) -> DataFrame:
    """Rolling conformal: the quantile is refreshed per block from strictly earlier scores."""
    q = rolling_quantiles(cal, test, keys, [window], block, alpha, y, pred, pos, cal_pos)
    return rolling_bands(test, q.drop("window"), keys, block, pred, pos)
