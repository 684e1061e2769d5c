"""Adaptive calibrators: the only state that runs through a series is one alpha per variant.

Everything else (scores, shift scores, blocks) is prepared by set-based operators.  What remains walks the blocks of a
series in order: Arrow batches of arrays, one row per block, with constant state and all variants of a grid in one walk.
Inside a block the bounds are fixed, so the steps of alpha are known beforehand: they are added up in one go until one
meets a limit.  Results are joined back on (series, block); the rows themselves never pass through Python.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadshape.functions.columns import absolute_residual, covers, point_band, quantile_band
from loadshape.operators.conformal import calibration_pieces, pack_blocks
from loadshape.operators.ordering import lookup


@dataclass(frozen=True)
class AciVariant:
    """Adaptive conformal inference: alpha moves once per block by the block's mean miscoverage."""

    name: str = "aci"
    alpha: float = 0.10
    gamma: float = 0.01
    alpha_min: float = 0.01
    alpha_max: float = 0.50


@dataclass(frozen=True)
class ShiftAwareVariant:
    """Shift-aware adaptive conformal: alpha moves every step, faster while a shift is flagged.

    ``penalty`` is ``flagged`` (eta * score * err only while flagged) or ``always``.
    """

    name: str = "sa_acp"
    alpha: float = 0.10
    gamma_slow: float = 0.005
    gamma_fast: float = 0.035
    eta: float = 0.02
    threshold: float = 1.25
    alpha_min: float = 0.01
    alpha_max: float = 0.50
    enable_detector: bool = True
    penalty: str = "flagged"


def sample_quantiles(ascending: np.ndarray, alphas: np.ndarray) -> np.ndarray:
    """Finite-sample conformal quantiles with linear interpolation; 0 for an empty sample."""
    n = ascending.size
    if n == 0:
        return np.zeros(len(alphas))
    h = (n - 1) * np.minimum(1.0, np.ceil((n + 1) * (1.0 - alphas)) / n)
    lo, hi = np.floor(h).astype(int), np.ceil(h).astype(int)
    return ascending[lo] + (h - lo) * (ascending[hi] - ascending[lo])


def sample_quantile(ascending: np.ndarray, alpha: float) -> float:
    return float(sample_quantiles(ascending, np.array([alpha]))[0])


def clip(x: float, low: float, high: float) -> float:
    return min(max(x, low), high)


def block_coverage(y, lo, hi, q: float, band: bool) -> np.ndarray:
    lower = np.maximum(0.0, lo - q)
    upper = np.maximum(lower, hi + q) if band else hi + q
    return (y >= lower) & (y <= upper)


def aci_next(alpha: float, err: float, v: AciVariant) -> float:
    return clip(alpha + v.gamma * (v.alpha - err), v.alpha_min, v.alpha_max)


def alpha_path(alpha: float, gains: np.ndarray, losses: np.ndarray, low: float, high: float) -> tuple[np.ndarray, float]:
    """Alpha before every step and after the last, where a step adds its gain, subtracts its loss and is clipped.

    Sums are taken in the order of the steps, as far as no limit is met, and from there anew: the digits are those of
    one step after the other.
    """
    before = np.empty(len(gains))
    moves = np.column_stack([gains, -losses]).ravel()
    at = 0
    while at < len(gains):
        after = np.add.accumulate(np.concatenate([[alpha], moves[2 * at :]]))[2::2]
        out = np.nonzero((after < low) | (after > high))[0]
        stop = at + (out[0] if len(out) else len(after) - 1)
        before[at] = alpha
        before[at + 1 : stop + 1] = after[: stop - at]
        alpha, at = clip(float(after[stop - at]), low, high), stop + 1
    return before, alpha


def shift_aware_moves(miss: np.ndarray, shift: np.ndarray, scored: np.ndarray, v: ShiftAwareVariant):
    """(gains, losses, rates, flags) per step; ``shift`` is NaN while the detector fills, steps not ``scored`` move nothing."""
    ready = ~np.isnan(shift) if v.enable_detector else np.zeros(len(shift), bool)
    score = np.where(ready, shift, 0.0)
    flag = ready & (score >= v.threshold)
    rate = np.where(flag, v.gamma_fast, v.gamma_slow)
    penalised = scored & (flag if v.penalty == "flagged" else True)
    gains = np.where(scored, rate * (v.alpha - miss), 0.0)
    return gains, np.where(penalised, v.eta * score * miss, 0.0), rate, flag


def walk_block(v, alpha: float, q: float, y, lo, hi, shift, band: bool, scored=None):
    """A block, or a part of it, under fixed bounds: (misses, alphas before each step, alpha after).

    A step without an outcome or a forecast is no miss and moves nothing.  The alpha of ACI moves at the end of the block:
    by the mean over the steps that have an outcome, and not at all if none has.
    """
    scored = ~(np.isnan(y) | np.isnan(lo) | np.isnan(hi)) if scored is None else scored
    with np.errstate(invalid="ignore"):
        miss = scored & ~block_coverage(y, lo, hi, q, band)
    if isinstance(v, AciVariant):
        after = aci_next(alpha, float(np.mean(miss[scored])), v) if scored.any() else alpha
        return miss, np.full(y.size, alpha), after
    gains, losses, _, _ = shift_aware_moves(miss, shift, scored, v)
    return miss, *alpha_path(alpha, gains, losses, v.alpha_min, v.alpha_max)


HEADER = -1
WALKED = "variant string, alpha_block double, conformal_quantile double, _at array<long>, _alphas array<double>, _steps array<double>, _shifts array<double>"


def walk_blocks(
    steps: DataFrame,
    cal: DataFrame,
    keys: Sequence[str],
    variants: Sequence[AciVariant | ShiftAwareVariant],
    block: int = 48,
    y: str = "y",
    pred: str = "y_pred",
    pos: str = "pos",
    seq: str = "seq",
    shift: str | None = None,
    band: tuple[str, str] | None = None,
    cal_score=None,
    cal_packed: DataFrame | None = None,
) -> DataFrame:
    """Per (series, block, variant): alpha and quantile at its start, and arrays over its steps.

    The arrays are positions, alphas and conformal quantiles before the update of each step, and shift scores; those of
    alphas and quantiles are NULL for variants whose alpha is one per block.  A task holds the calibration scores of one
    series, eight bytes a time step, and one batch of blocks.
    """
    keys, variants = list(keys), list(variants)
    lo, hi = band or (pred, pred)
    score = absolute_residual(y, pred) if cal_score is None else cal_score
    if cal_packed is None:
        cal_packed = calibration_pieces(cal, keys, score, seq)
    missing = F.lit(float("nan"))
    values = {n: F.coalesce(F.col(c).cast("double"), missing) for n, c in {"_y": y, "_lo": lo, "_hi": hi}.items()}
    values["_shift"] = F.coalesce(F.col(shift).cast("double"), missing) if shift else missing
    # header rows with the calibration sample in pieces, then the blocks in order
    blocks = pack_blocks(steps, keys, pos, block, values)
    header = cal_packed.withColumn("block", F.lit(HEADER).cast("long"))
    lines = blocks.unionByName(header, allowMissingColumns=True)
    ordered = lines.repartition(*keys).sortWithinPartitions(*keys, "block")
    schema = T.StructType(
        [steps.schema[k] for k in keys] + T._parse_datatype_string(f"block long, {WALKED}").fields
    )
    is_band = band is not None

    def doubles(column: pa.ListArray) -> list[np.ndarray]:
        flat = column.flatten().to_numpy(zero_copy_only=False)
        sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(int)
        return np.split(flat, np.cumsum(sizes)[:-1])

    def walk(batches):
        current, pieces, cal_scores, alphas = None, [], np.empty(0), {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = list(zip(*[batch.column(k).to_pylist() for k in keys], strict=True))
            number = batch.column("block").to_pylist()
            cal_col, ys, los, his, shifts = (doubles(batch.column(c)) for c in ("_cal", "_y", "_lo", "_hi", "_shift"))
            at, found = [], []
            for i, key in enumerate(ids):
                if key != current:
                    current, pieces, cal_scores = key, [], np.empty(0)
                    alphas = {v.name: v.alpha for v in variants}
                if number[i] == HEADER:
                    pieces.append(cal_col[i])
                    continue
                if pieces:
                    cal_scores, pieces = np.sort(np.concatenate(pieces)), []
                for v in variants:
                    start = alphas[v.name]
                    q = sample_quantile(cal_scores, start)
                    _, before, alphas[v.name] = walk_block(v, start, q, ys[i], los[i], his[i], shifts[i], is_band)
                    moves = isinstance(v, ShiftAwareVariant)
                    at.append(i)
                    found.append((v.name, start, q, before if moves else None, sample_quantiles(cal_scores, before) if moves else None))
            if at:
                take = pa.array(at, pa.int32())
                names, starts, quantiles, traces, steps_q = zip(*found, strict=True)
                many = pa.list_(pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).take(take) for k in [*keys, "block"]]
                    + [
                        pa.array(names, pa.string()), pa.array(starts, pa.float64()), pa.array(quantiles, pa.float64()),
                        batch.column("_pos").take(take).cast(pa.list_(pa.int64())), pa.array(traces, many), pa.array(steps_q, many),
                        batch.column("_shift").take(take),
                    ],
                    names=[*keys, "block", "variant", "alpha_block", "conformal_quantile", "_at", "_alphas", "_steps", "_shifts"],
                )

    return ordered.select(*keys, "block", "_pos", "_y", "_lo", "_hi", "_shift", "_cal").mapInArrow(walk, schema)


def with_walk(
    rows: DataFrame, walked: DataFrame, keys: Sequence[str], block: int = 48, pos: str = "pos", shift: str | None = None
) -> DataFrame:
    """``rows`` once per variant with ``variant``, ``alpha_block`` and ``conformal_quantile`` (those of the bounds), and per
    step ``alpha_t`` and ``quantile_t`` (before its update); with ``shift``, the step's shift score under that name too."""
    placed = rows.withColumn("_block", F.floor(F.col(pos) / block).cast("long"))
    joined = lookup(placed, walked.withColumnRenamed("block", "_block"), [*keys, "_block"])
    at = (F.array_position("_at", F.col(pos).cast("long")) - 1).cast("int")
    out = {
        "alpha_t": F.coalesce(F.get("_alphas", at), "alpha_block"),
        "quantile_t": F.coalesce(F.get("_steps", at), "conformal_quantile"),
    }
    if shift:
        score = F.get("_shifts", at)
        out[shift] = F.when(~F.isnan(score), score)
    return joined.withColumns(out).drop("_block", "_at", "_alphas", "_steps", "_shifts")


def variant_table(spark, variants: Sequence) -> DataFrame:
    """The parameters of the variants, one row each."""
    schema = {"str": "string", "float": "double", "bool": "boolean"}
    kind = type(variants[0])
    ddl = ", ".join(f"{f.name} {schema[f.type]}" for f in fields(kind))
    return spark.createDataFrame([tuple(asdict(v).values()) for v in variants], ddl)


def _bounded(walked: DataFrame, pred: str, band: tuple[str, str] | None) -> DataFrame:
    lower, upper = (
        point_band(pred, "conformal_quantile") if band is None else quantile_band(*band, "conformal_quantile")
    )
    return walked.withColumns({"lower": lower, "upper": upper})


def aci_intervals(
    cal: DataFrame,
    test: DataFrame,
    keys: Sequence[str],
    variants: Sequence[AciVariant] = (AciVariant(),),
    block: int = 48,
    y: str = "y",
    pred: str = "y_pred",
    pos: str = "pos",
    seq: str = "seq",
    band: tuple[str, str] | None = None,
    cal_score=None,
    cal_packed: DataFrame | None = None,
) -> DataFrame:
    """ACI bounds per variant; alpha at a block depends on earlier blocks only."""
    walked = walk_blocks(test, cal, keys, variants, block, y, pred, pos, seq, None, band, cal_score, cal_packed)
    return _bounded(with_walk(test, walked, keys, block, pos).drop("alpha_t", "quantile_t"), pred, band)


def _per_variant(variants, attribute: str):
    """The variant's parameter as a column: a chain of literals, as many as there are variants."""
    out = None
    for v in variants:
        value = F.lit(getattr(v, attribute))
        hit = F.col("variant") == v.name
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def shift_columns(v: ShiftAwareVariant, shift: str) -> tuple:
    """Effective detector score, flag and rate of a variant, as columns."""
    enabled = F.lit(v.enable_detector)
    score = F.when(enabled, F.coalesce(F.col(shift), F.lit(0.0))).otherwise(F.lit(0.0))
    flag = enabled & F.coalesce(F.col(shift) >= v.threshold, F.lit(False))
    return score, flag, F.when(flag, F.lit(v.gamma_fast)).otherwise(F.lit(v.gamma_slow))


def shift_aware_intervals(
    cal: DataFrame,
    test: DataFrame,
    keys: Sequence[str],
    variants: Sequence[ShiftAwareVariant] = (ShiftAwareVariant(),),
    shift: str = "shift_score",
    block: int = 48,
    y: str = "y",
    pred: str = "y_pred",
    pos: str = "pos",
    seq: str = "seq",
    band: tuple[str, str] | None = None,
    cal_score=None,
    cal_packed: DataFrame | None = None,
    rows: DataFrame | None = None,
) -> DataFrame:
    """SA-ACP bounds and per-step trace.

    ``test`` carries the detector score (NULL while it fills), computed for all
    rows beforehand because it does not depend on alpha.  The result has the
    effective ``shift_score``, ``shift_flag`` and ``gamma_t`` of each variant, and
    ``quantile_t``, the conformal quantile at the alpha of the step.  It has the columns
    of ``rows`` where these are given (the test rows as they were before scoring),
    otherwise those of ``test``.
    """
    walked = walk_blocks(test, cal, keys, variants, block, y, pred, pos, seq, shift, band, cal_score, cal_packed)
    walked = with_walk(test.drop(shift) if rows is None else rows, walked, keys, block, pos, shift)
    enabled = _per_variant(variants, "enable_detector")
    score = F.when(enabled, F.coalesce(F.col(shift), F.lit(0.0))).otherwise(F.lit(0.0))
    flag = enabled & F.coalesce(F.col(shift) >= _per_variant(variants, "threshold"), F.lit(False))
    traced = walked.withColumns({"_score": score, "shift_flag": flag}).withColumn(
        "gamma_t",
        F.when(F.col("shift_flag"), _per_variant(variants, "gamma_fast")).otherwise(
            _per_variant(variants, "gamma_slow")
        ),
    )
    return _bounded(traced.drop(shift).withColumnRenamed("_score", "shift_score"), pred, band)


def step_trace(intervals: DataFrame, y: str = "y") -> DataFrame:
    """Add the miss indicator, coverage and width of every row to calibrator output; a missing outcome is neither."""
    inside = covers(y, "lower", "upper")
    known = F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double"))
    return intervals.withColumns(
        {
            "err_t": F.when(known, F.when(inside, 0.0).otherwise(1.0)),
            "covered": F.when(known, inside.cast("double")),
            "interval_width": F.col("upper") - F.col("lower"),
        }
    )


def block_trace(
    intervals: DataFrame, keys: Sequence[str], block: int = 48, y: str = "y", pos: str = "pos"
) -> DataFrame:
    """Per (series, variant, block): alpha, quantile, mean miscoverage, coverage and mean width; over known outcomes."""
    known = F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double"))
    inside = F.when(known, covers(y, "lower", "upper").cast("double"))
    group = [*keys, "variant", F.floor(F.col(pos) / block).cast("long").alias("block")]
    return intervals.groupBy(*group).agg(
        F.max("alpha_block").alias("alpha_t"),
        F.max("conformal_quantile").alias("conformal_quantile"),
        (1.0 - F.avg(inside)).alias("err_t"),
        F.avg(inside).alias("covered"),
        F.avg(F.col("upper") - F.col("lower")).alias("width"),
    )
