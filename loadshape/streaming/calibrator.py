"""Online calibrators on a stream of forecasts with outcomes.

A series keeps in keyed state what the batch operators hold: its calibration scores, one alpha per variant, and the last
scores.  Rows wait in state until the watermark passes them, so they are taken in the order of time whatever their
order of arrival, and the result equals the batch backtest.  State is in parts, and a trigger writes only those
that it changes: a list to which calibration scores are appended, a ring of scores of which a new one replaces the
oldest, a map of waiting rows by time, and a few numbers; a timer calls a series when its next row is due.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loadshape.operators.adaptive import (
    AciVariant,
    ShiftAwareVariant,
    aci_next,
    sample_quantile,
    shift_aware_moves,
    walk_block,
)
from loadshape.operators.drift import trailing_distances
from loadshape.streaming.ingest import event_time, join_outcomes, zone_free

STEPS = (
    "micros bigint, y double, y_pred double, method string, lower double, upper double, conformal_quantile double, "
    "alpha_t double, gamma_t double, shift_score double, shift_flag boolean"
)
ROLLING = "rolling"


class SeriesCalibrator(StatefulProcessor):
    """All methods on one series; ``methods`` are (name, variant), that of ``rolling`` with a rate of 0."""

    def __init__(self, keys, methods, window: int, detector_window: int, reference_length: int, block: int):
        self.keys, self.methods, self.window = keys, methods, window
        self.detector_window, self.reference_length, self.block = detector_window, reference_length, block
        self.ring_size = max(window, detector_window)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.numbers = handle.getValueState(
            "numbers",
            "pos bigint, n_scores bigint, n_test_scores bigint, seen bigint, alphas array<double>, quantiles array<double>, "
            "missed array<double>",
        )
        self.calibration = handle.getListState("calibration", "score double")
        self.ring = handle.getMapState("ring", "slot bigint", "score double")
        self.waiting = handle.getMapState("waiting", "us bigint", "y double, y_pred double, is_calibration boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            values = pdf[["y", "y_pred"]].astype(float)  # what is missing is NaN
            for us, y, pred, is_cal in zip(pdf["micros"], values["y"], values["y_pred"], pdf["calibrates"]):
                self.waiting.updateValue((int(us),), (float(y), float(pred), bool(is_cal)))
                first = int(us) if first is None else min(first, int(us))
        if first is not None:
            self._call_at(first, timerValues)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        held = [(us, row) for (us,), row in self.waiting.iterator()]
        due = sorted(x for x in held if x[0] <= until)
        found = self._advance(due) if due else None
        for us, _ in due:
            self.waiting.removeKey((us,))
        left = [us for us, _ in held if us > until]
        if left:
            self._call_at(min(left), timerValues)
        if found is not None:
            for i, k in enumerate(self.keys):
                found.insert(i, k, key[i])
            yield found

    def close(self) -> None:
        pass

    def _call_at(self, us: int, timerValues) -> None:
        # the watermark is in milliseconds; a timer in the past is called at the next one
        self.handle.registerTimer(max(-(-us // 1000), timerValues.getCurrentWatermarkInMs() + 1))

    def _scores(self, n: int, last: int) -> np.ndarray:
        """The last ``last`` of ``n`` scores so far, in order."""
        if n == 0 or last <= 0:
            return np.empty(0)
        held = {slot: score for (slot,), (score,) in self.ring.iterator()}
        return np.array([held[i % self.ring_size] for i in range(max(0, n - min(last, self.ring_size)), n)])

    def _keep(self, n: int, new: np.ndarray) -> None:
        for i in range(max(0, len(new) - self.ring_size), len(new)):
            self.ring.updateValue(((n + i) % self.ring_size,), (float(new[i]),))

    def _advance(self, due: list) -> pd.DataFrame | None:
        """Take the rows that are due, in order of time; the steps of the test among them come out."""
        methods = self.methods
        if self.numbers.exists():
            pos, n, n_test, seen, alphas, quantiles, missed = self.numbers.get()
            alphas, quantiles, missed = list(alphas), list(quantiles), list(missed)
        else:
            pos = n = n_test = seen = 0
            alphas, quantiles, missed = [v.alpha for _, v in methods], [0.0] * len(methods), [0.0] * len(methods)
        scores_of = lambda rows: np.abs(np.array([y - p for _, (y, p, _) in rows], float))
        cal, test = [x for x in due if x[1][2]], [x for x in due if not x[1][2]]
        if cal:
            new = scores_of(cal)
            new = new[~np.isnan(new)]
            self.calibration.appendList([(float(s),) for s in new])
            self._keep(n, new)
            n += len(new)
        out = None
        if test:
            us = np.array([t for t, _ in test])
            y, pred = (np.array([row[i] for _, row in test], float) for i in (0, 1))
            scores = scores_of(test)
            scored = ~np.isnan(scores)
            sample = np.array([s for (s,) in self.calibration.get()], float)
            before = self._scores(n, self.ring_size)
            shift = self._shifts(sample, before[max(0, len(before) - n_test) :], scores, scored)
            known = np.concatenate([before, scores[scored]])
            rank = len(before) + np.concatenate([[0], np.cumsum(scored)])
            sample = np.sort(sample)
            parts, at = [], 0
            while at < len(test):
                if pos % self.block == 0:
                    recent = np.sort(known[max(0, rank[at] - self.window) : rank[at]])
                    quantiles = [sample_quantile(recent if m == ROLLING else sample, a) for (m, _), a in zip(methods, alphas)]
                    missed, seen = [0.0] * len(methods), 0
                end = min(len(test), at + self.block - pos % self.block)
                part = slice(at, end)
                for m, (name, v) in enumerate(methods):
                    miss, path, after = walk_block(
                        v, alphas[m], quantiles[m], y[part], pred[part], pred[part], shift[part], False, scored[part]
                    )
                    parts.append(self._frame(us, y, pred, shift, part, name, v, quantiles[m], path))
                    missed[m] += float(miss.sum())
                    if isinstance(v, ShiftAwareVariant):
                        alphas[m] = after
                seen += int(scored[part].sum())
                pos, at = pos + end - at, end
                if pos % self.block == 0 and seen:
                    alphas = [
                        aci_next(a, missed[m] / seen, v) if isinstance(v, AciVariant) else a
                        for m, ((_, v), a) in enumerate(zip(methods, alphas))
                    ]
            self._keep(n, scores[scored])
            n, n_test = n + int(scored.sum()), n_test + int(scored.sum())
            out = pd.concat(parts, ignore_index=True)
        self.numbers.update((pos, n, n_test, seen, alphas, quantiles, missed))
        return out

    def _shifts(self, sample: np.ndarray, trailing: np.ndarray, scores: np.ndarray, scored: np.ndarray) -> np.ndarray:
        """The detector's score at every step; NaN while it fills and where an outcome is missing."""
        reference = sample[max(0, len(sample) - self.reference_length) :]
        trailing = trailing[max(0, len(trailing) - self.detector_window + 1) :]
        out = np.full(len(scores), np.nan)
        if len(reference):
            least = max(24, self.detector_window // 4)
            found = trailing_distances(np.concatenate([trailing, scores[scored]]), len(trailing), self.detector_window, least, reference)
            out[scored] = found / max(float(np.std(reference)), 1e-6)
        return out

    def _frame(self, us, y, pred, shift, part, name, v, q, path) -> pd.DataFrame:
        aware = isinstance(v, ShiftAwareVariant)
        lower = np.maximum(0.0, pred[part] - q)
        own = shift[part]
        frame = pd.DataFrame({
            "micros": us[part], "y": y[part], "y_pred": pred[part], "method": name, "lower": lower, "upper": pred[part] + q,
            "conformal_quantile": q, "alpha_t": path, "gamma_t": np.nan, "shift_score": np.nan, "shift_flag": None,
        })
        if aware:
            _, _, rate, flag = shift_aware_moves(np.zeros(len(own), bool), own, np.ones(len(own), bool), v)
            frame["gamma_t"], frame["shift_flag"] = rate, flag
            frame["shift_score"] = own if v.enable_detector else np.nan
        return frame


def online_intervals(
    rows: DataFrame,
    keys: Sequence[str],
    delay: str | None,
    aci: AciVariant | None = AciVariant(),
    sa_acp: ShiftAwareVariant | None = ShiftAwareVariant(),
    rolling_alpha: float | None = 0.10,
    window: int = 1344,
    detector_window: int = 336,
    reference_length: int = 1344,
    block: int = 48,
    ts: str = "ts",
    is_calibration: str = "is_calibration",
) -> DataFrame:
    """Bounds of the online methods for a stream of (keys, ts, y, y_pred, is_calibration).

    Calibration rows fill the state before the first test row of their series; ``ts`` is unique in a series, of rows that
    repeat it before they are due the last counts.  A row whose ``y`` or ``y_pred`` is NULL has bounds but no score.
    ``delay`` is the watermark delay; None if the input already has a watermark on ``ts``.  Rows later than the watermark
    are dropped by Spark, and a row comes out once the watermark passes it.  Needs the RocksDB state store, which
    ``run_to_files`` sets.
    """
    keys = list(keys)
    methods = []
    if rolling_alpha is not None:
        methods.append((ROLLING, AciVariant(ROLLING, rolling_alpha, 0.0)))
    if aci is not None:
        methods.append(("aci", aci))
    if sa_acp is not None:
        methods.append(("sa_acp", sa_acp))
    timed = rows if delay is None else event_time(rows, ts).withWatermark(ts, delay)
    base = timed.select(
        *keys, ts, F.unix_micros(ts).alias("micros"), F.col("y").cast("double"), F.col("y_pred").cast("double"),
        F.coalesce(F.col(is_calibration), F.lit(False)).alias("calibrates"),
    )
    output = T.StructType([base.schema[k] for k in keys] + T._parse_datatype_string(STEPS).fields)
    processor = SeriesCalibrator(keys, methods, window, detector_window, reference_length, block)
    walked = base.groupBy(*keys).transformWithStateInPandas(processor, output, "append", "eventTime")
    shown = [f.name for f in T._parse_datatype_string(STEPS).fields if f.name != "micros"]
    missing = {c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in ("y", "y_pred", "gamma_t", "shift_score")}
    return walked.withColumns(missing).select(*keys, zone_free(F.col("micros")).alias(ts), *shown)


def online_intervals_of(
    forecasts: DataFrame, outcomes: DataFrame, keys: Sequence[str], delay: str, ts: str = "ts", **settings
) -> DataFrame:
    """``online_intervals`` of two streams: forecasts (keys, ts, y_pred, is_calibration) and outcomes (keys, ts, y).

    Two stateful operators in one query: the join holds forecasts and outcomes until both are there, and emits a forecast
    without an outcome once the watermark has passed it; the calibrators then take the rows in order of time.
    """
    joined = join_outcomes(forecasts, outcomes, keys, delay, ts, how="left")
    return online_intervals(joined, keys, None, ts=ts, **settings)
