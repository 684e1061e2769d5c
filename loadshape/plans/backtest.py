"""Day-ahead backtest of all interval methods, as one long table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from loadshape.functions.columns import (
    absolute_residual,
    band_violation,
    point_band,
    quantile_band,
)
from loadshape.operators.adaptive import (
    AciVariant,
    ShiftAwareVariant,
    shift_columns,
    walk_blocks,
    with_walk,
)
from loadshape.operators.conformal import (
    calibration_pieces,
    calibration_quantiles,
    is_score,
    pack_calibration,
    rolling_intervals,
    score_ranks,
)
from loadshape.operators.drift import mean_shift_scores, wasserstein_scores
from loadshape.operators.ordering import lookup
from loadshape.session import cut_lineage

METHODS = ("uncalibrated", "static", "cqr", "rolling", "aci", "sa_acp")
# Method labels of the result tables.
LABELS = {
    "uncalibrated": "P0_Uncalibrated_Quantile",
    "static": "P1_Static_Split_Conformal",
    "cqr": "P2_CQR",
    "rolling": "P3_Rolling_Conformal",
    "aci": "P4_ACI",
    "sa_acp": "P5_SA_ACP",
}


@dataclass(frozen=True)
class BacktestSettings:
    alpha: float = 0.10
    block: int = 48
    rolling_window: int = 1344
    detector: str = "wasserstein_1d"
    detector_window: int = 336
    reference_length: int = 1344
    aci: AciVariant = field(default_factory=AciVariant)
    sa_acp: ShiftAwareVariant = field(default_factory=ShiftAwareVariant)


def place_rows(
    forecasts: DataFrame, keys: Sequence[str], seq: str = "seq", cut: bool = True, y: str = "y", pred: str = "y_pred"
) -> tuple[DataFrame, DataFrame]:
    """Calibration rows with ``cal_pos`` (-1 is the last) and test rows with ``pos`` (0 is the first).

    ``seq`` runs without gaps within each split of a series.  Both get ``rank``, which counts the same way but only the
    rows that have a score: a missing outcome or forecast has none.  Every calibrator
    reads these rows, so they are written once unless ``cut`` is off; where the writing has met no missing score,
    ``rank`` is the position and nothing is counted.
    """
    used = forecasts.where(F.col("split").isin("calibration", "test"))
    is_test = F.col("split") == "test"
    edges = used.groupBy(*keys).agg(
        F.max(F.when(~is_test, F.col(seq))).alias("_last"), F.min(F.when(is_test, F.col(seq))).alias("_first")
    )
    at = F.when(is_test, F.col(seq) - F.col("_first")).otherwise(F.col(seq) - F.col("_last") - 1)
    placed = lookup(used, edges, keys).withColumn("pos", at).drop("_first", "_last")
    score = absolute_residual(y, pred).cast("double")
    n_missing = None
    if cut:
        seen = Observation()
        none = F.count_if(~F.coalesce(is_score(score), F.lit(False)))
        placed = cut_lineage(placed.observe(seen, none.alias("n")), "placed")
        n_missing = seen.get["n"]
    cal = placed.where(~is_test).withColumnRenamed("pos", "cal_pos")
    test = placed.where(is_test)
    if n_missing == 0:
        return cal.withColumn("rank", F.col("cal_pos")), test.withColumn("rank", F.col("pos"))
    totals = cal.groupBy(*keys).agg(F.count(F.when(is_score(score), 1)).alias("_total"))
    cal = lookup(score_ranks(cal, keys, "cal_pos", score), totals, keys)
    cal = cal.withColumn("rank", F.col("rank") - F.col("_total")).drop("_total")
    return cal, score_ranks(test, keys, "pos", score)


def with_shift_scores(
    cal: DataFrame, test: DataFrame, keys: Sequence[str], packed: DataFrame, settings: BacktestSettings,
    also: Sequence[str] = (),
) -> DataFrame:
    """The steps of ``test`` - series, ``pos``, ``y``, ``y_pred`` and ``also`` - with the detector's ``shift_score``.

    A missing score does not enter the detector's buffer, and its step has a NULL ``shift_score``.
    """
    steps = test.select(*keys, "pos", "y", "y_pred", *also, "rank", absolute_residual("y", "y_pred").cast("double").alias("_score"))
    scored = steps.where(is_score(F.col("_score")))
    if settings.detector == "wasserstein_1d":
        out = wasserstein_scores(
            scored, packed, keys, "_score", "rank", settings.detector_window, settings.reference_length, "_abs",
        )
    else:
        cal_scores = cal.withColumn("_score", absolute_residual("y", "y_pred")).where(is_score(F.col("_score")))
        out = mean_shift_scores(scored, cal_scores, keys, "_score", "rank", settings.detector_window)
    missing = steps.where(~F.coalesce(is_score(F.col("_score")), F.lit(False)))
    return out.unionByName(missing, allowMissingColumns=True).drop("_score", "rank")


def run_backtest(
    forecasts: DataFrame,
    keys: Sequence[str],
    settings: BacktestSettings = BacktestSettings(),
    methods: Sequence[str] = METHODS,
    ts: str = "ts",
    seq: str = "seq",
) -> DataFrame:
    """Long interval table: one row per (series, test step, method).

    ``forecasts`` has ``y, y_pred, q_lo, q_hi, split`` and covers calibration
    and test.  Bounds of a block use only outcomes of earlier blocks.
    """
    keys, s = list(keys), settings
    cal, test = place_rows(forecasts, keys, seq)
    core = [*keys, ts, seq, "pos", "y", "y_pred"]
    scores = {"_abs": absolute_residual("y", "y_pred")}
    if "cqr" in methods:
        scores["_cqr"] = band_violation("y", "q_lo", "q_hi")
    tables = []

    fixed = [m for m in methods if m in ("uncalibrated", "static", "cqr")]
    if fixed:
        joined = test
        for name, score in scores.items():
            joined = lookup(joined, calibration_quantiles(cal, keys, score, {f"{name}_q": s.alpha}), keys, "left")
        bands = {
            "uncalibrated": lambda: (*quantile_band("q_lo", "q_hi"), F.lit(None).cast("double")),
            "static": lambda: (*point_band("y_pred", F.coalesce("_abs_q", F.lit(0.0))), F.col("_abs_q")),
            "cqr": lambda: (*quantile_band("q_lo", "q_hi", F.coalesce("_cqr_q", F.lit(0.0))), F.col("_cqr_q")),
        }
        entries = []
        for m in fixed:
            lower, upper, quantile = bands[m]()
            entries.append(
                F.struct(
                    F.lit(m).alias("method"), lower.alias("lower"), upper.alias("upper"),
                    quantile.alias("conformal_quantile"),
                )
            )
        tables.append(joined.select(*core, F.inline(F.array(*entries))))

    if "rolling" in methods:
        rolled = rolling_intervals(cal, test, keys, s.alpha, s.rolling_window, s.block)
        tables.append(
            rolled.select(*core, F.lit("rolling").alias("method"), "lower", "upper", "conformal_quantile")
        )

    walks = [(m, v) for m, v in (("aci", s.aci), ("sa_acp", s.sa_acp)) if m in methods]
    if walks:  # one walk for all adaptive methods
        steps, shift = test, None
        if "sa_acp" in methods:
            packed = pack_calibration(cal, keys, {"_abs": scores["_abs"]}, seq, s.reference_length)
            steps, shift = with_shift_scores(cal, test, keys, packed, s), "shift_score"
        pieces = calibration_pieces(cal, keys, scores["_abs"], seq)
        variants = [replace(v, name=m) for m, v in walks]
        walked = walk_blocks(steps, cal, keys, variants, s.block, seq=seq, shift=shift, cal_packed=pieces)
        walked = with_walk(test.select(*core), walked, keys, s.block, shift=shift)
        lower, upper = point_band("y_pred", "conformal_quantile")
        shown = {"alpha_t": F.col("alpha_block")}
        if "sa_acp" in methods:
            aware = F.col("variant") == "sa_acp"
            shift_score, flag, rate = shift_columns(s.sa_acp, shift)
            shown |= {
                "gamma_t": F.when(aware, rate), "shift_score": F.when(aware, shift_score), "shift_flag": F.when(aware, flag),
            }
        tables.append(
            walked.select(
                *core, F.col("variant").alias("method"), lower.alias("lower"), upper.alias("upper"), "conformal_quantile",
                *[c.alias(n) for n, c in shown.items()],
            )
        )
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def wide_trajectory(intervals: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """One row per step with the bounds of every method side by side."""
    def of(method: str, column: str, name: str):
        return F.max(F.when(F.col("method") == method, F.col(column))).alias(name)

    bounds = [of(m, c, f"{m}_{c}") for m in METHODS for c in ("lower", "upper")]
    wide = intervals.groupBy(*keys, ts).agg(
        F.max("y").alias("y_true"), F.max("y_pred").alias("y_point_pred"), *bounds,
        of("aci", "alpha_t", "aci_alpha"), of("sa_acp", "alpha_t", "sa_acp_alpha"),
        of("sa_acp", "gamma_t", "sa_acp_gamma"), of("sa_acp", "shift_score", "shift_score"),
        of("sa_acp", "shift_flag", "shift_flag"),
    )
    return wide


def labelled(intervals: DataFrame, labels: Mapping[str, str] = LABELS) -> DataFrame:
    """Replace the short method names by the labels of the result tables."""
    c = F.col("method")
    for short, label in labels.items():
        c = F.when(F.col("method") == short, label).otherwise(c)
    return intervals.withColumn("method", c)
