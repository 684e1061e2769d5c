"""Gradient-boosted trees per series, on squared error or pinball loss: one model per series, all series in one job.

A series' training rows are one group of a grouped map: features as bins of one byte, so a century of half-hours with 25
features takes 44 MB in its task, and Spark spreads the series.  Trees grow level by level on histograms: sums of
gradients per (node, feature, bin) taken in one pass over the rows.  Models are rows of a table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadshape.operators.ordering import lookup

#: Rows of a series predicted in one task.
ROWS = 1 << 16
#: A feature is cut at this many quantiles at most, so that its bin is a byte.
MAX_BINS = 255
MEAN = "mean"


def bin_edges(x: np.ndarray, bins: int = MAX_BINS) -> np.ndarray:
    """Ascending cuts: between all distinct values if they are few, else at quantiles."""
    values = np.unique(x)
    if len(values) <= bins:
        return (values[1:] + values[:-1]) / 2
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def grow(binned: np.ndarray, gradient: np.ndarray, n_bins: int, max_depth: int, min_leaf: int):
    """One tree: (feature, bin) per inner node in heap order, feature -1 where a node is not split, and the leaf per row.

    A split sends bins above its own to the right; the best one leaves the least squared error of the gradient, with
    ``min_leaf`` rows on either side.
    """
    n, p = binned.shape
    feature, cut = np.full(2**max_depth - 1, -1), np.full(2**max_depth - 1, n_bins)
    node = np.zeros(n, np.int64)
    column = binned + np.arange(p) * n_bins
    repeated = np.repeat(gradient, p)
    for depth in range(max_depth):
        m = 2**depth
        at = (column + (node * (p * n_bins))[:, None]).ravel()
        sums = np.bincount(at, repeated, m * p * n_bins).reshape(m, p, n_bins).cumsum(axis=2)
        rows = np.bincount(at, minlength=m * p * n_bins).reshape(m, p, n_bins).cumsum(axis=2)
        total, count = sums[:, :, -1:], rows[:, :, -1:]
        fits = (rows >= min_leaf) & (count - rows >= min_leaf)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(fits, sums**2 / rows + (total - sums) ** 2 / (count - rows) - total**2 / count, 0.0)
        gain = gain.reshape(m, -1)
        best = gain.argmax(axis=1)
        splits = gain[np.arange(m), best] > 1e-12 * max(1.0, float(np.abs(repeated).max(initial=0.0)) ** 2)
        at_node = slice(m - 1, 2 * m - 1)
        feature[at_node] = np.where(splits, best // n_bins, -1)
        cut[at_node] = np.where(splits, best % n_bins, n_bins)
        own = binned[np.arange(n), np.maximum(feature[m - 1 + node], 0)]
        node = 2 * node + (own > cut[m - 1 + node])
    return feature, cut, node


def leaf_quantiles(residual: np.ndarray, leaf: np.ndarray, leaves: int, level: float) -> np.ndarray:
    """Exact quantile of the residuals of every leaf, interpolated; 0 for a leaf without rows."""
    order = np.lexsort((residual, leaf))
    ends = np.searchsorted(leaf[order], np.arange(leaves + 1))
    first, n = ends[:-1], np.diff(ends)
    h = np.maximum(n - 1, 0) * level
    low = np.floor(h).astype(int)
    high = np.minimum(low + 1, np.maximum(n - 1, 0))
    held = np.append(residual[order], 0.0)
    a, b = (held[np.minimum(first + k, len(residual))] for k in (low, high))
    return np.where(n > 0, a + (h - low) * (b - a), 0.0)


def boost(
    x: np.ndarray, y: np.ndarray, level: float | None, rounds: int, max_depth: int, rate: float, min_leaf: int
) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(start, features, thresholds, leaf values) of a boosted model; ``level`` None is squared error, else pinball loss.

    Squared error follows the residuals and steps to the leaf means; pinball loss follows the sign of the residuals and
    steps to the leaves' quantiles at ``level``.
    """
    edges = [bin_edges(c) for c in x.T]
    n_bins = max([len(e) for e in edges], default=0) + 1
    binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)]).astype(np.int64)
    # row k of the table is what "bin above k" means for a value
    limit = np.full((x.shape[1], n_bins + 1), np.inf)
    for i, e in enumerate(edges):
        limit[i, : len(e)] = e
    start = float(np.mean(y) if level is None else np.quantile(y, level))
    fitted = np.full(len(y), start)
    features, thresholds, values = [], [], []
    for _ in range(rounds):
        residual = y - fitted
        gradient = residual if level is None else np.where(residual > 0, level, level - 1.0)
        feature, cut, leaf = grow(binned, gradient, n_bins, max_depth, min_leaf)
        leaves = 2**max_depth
        if level is None:
            n = np.maximum(np.bincount(leaf, minlength=leaves), 1)
            value = np.bincount(leaf, residual, leaves) / n
        else:
            value = leaf_quantiles(residual, leaf, leaves, level)
        value = rate * value
        fitted = fitted + value[leaf]
        features.append(feature)
        thresholds.append(limit[np.maximum(feature, 0), cut])
        values.append(value)
    return start, np.array(features), np.array(thresholds), np.array(values)


def evaluate(x: np.ndarray, start: float, features: np.ndarray, thresholds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Predictions of a boosted model: start plus the leaf of every tree."""
    out = np.full(len(x), start)
    rows = np.arange(len(x))
    for feature, threshold, value in zip(features, thresholds, values):
        node = np.zeros(len(x), np.int64)
        for _ in range(int(np.log2(len(value)))):
            node = 2 * node + 1 + (x[rows, np.maximum(feature[node], 0)] > threshold[node])
        out += value[node - len(feature)]
    return out


def _complete(columns: Sequence[str]) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return ok


def boosted_fit(
    train: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    target: str,
    levels: Mapping[str, float] | None = None,
    rounds: int = 150,
    max_depth: int = 6,
    learning_rate: float = 0.05,
    min_leaf: int = 20,
) -> DataFrame:
    """A table of models: (keys, output, n_rows, start, features, thresholds, leaf values), one row per series and output.

    Without ``levels`` there is one output, the mean (squared error); with them one per named quantile level (pinball
    loss).  Rows without the target or without all features are left out.
    """
    keys, features = list(keys), list(features)
    outputs = {MEAN: None} if levels is None else dict(levels)
    schema = T.StructType(
        [train.schema[k] for k in keys]
        + T._parse_datatype_string(
            "output string, n_rows long, start double, tree_features array<int>, tree_thresholds array<double>, tree_values array<double>"
        ).fields
    )

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        name, level = pdf["_output"].iloc[0], outputs[pdf["_output"].iloc[0]]
        x, y = pdf[features].to_numpy(float), pdf["_target"].to_numpy(float)
        order = np.lexsort((*x.T, y))  # sums in one order, whatever the order of arrival
        start, *trees = boost(x[order], y[order], level, rounds, max_depth, learning_rate, min_leaf)
        row = [*key[: len(keys)], name, len(y), start, trees[0].ravel(), trees[1].ravel(), trees[2].ravel()]
        return pd.DataFrame([row], columns=[f.name for f in schema])

    rows = train.select(*keys, *[F.col(c).cast("double").alias(c) for c in features], F.col(target).cast("double").alias("_target"))
    rows = rows.where(_complete([*features, "_target"]))
    # every output of a series is a task of its own
    each = rows.withColumn("_output", F.explode(F.array(*[F.lit(o) for o in outputs])))
    return each.groupBy(*keys, "_output").applyInPandas(fit, schema)


def boosted_predict(
    df: DataFrame, fitted: DataFrame, keys: Sequence[str], features: Sequence[str], outputs: Mapping[str, str] | Sequence[str] = {MEAN: "y_pred"},
    max_depth: int = 6,
) -> DataFrame:
    """``df`` with a non-negative prediction per output; NULL where a feature or the series' model is missing.

    ``outputs`` maps the outputs of the models to columns (a sequence keeps their names).  Rows meet the models of their
    series in pieces of bounded size, so a long series spreads over tasks.  Quantile outputs are put in order
    per row: each is at least the one before it in ``outputs``.
    """
    keys, features = list(keys), list(features)
    names = dict(outputs) if isinstance(outputs, Mapping) else {o: o for o in outputs}
    inner, leaves = 2**max_depth - 1, 2**max_depth
    pieces = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("_pieces"))
    models = lookup(fitted, pieces, keys).withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1))).drop("_pieces")
    dealt = lookup(df, pieces, keys).withColumn("_piece", F.pmod(F.xxhash64(*features), F.col("_pieces")).cast("int")).drop("_pieces")
    schema = T.StructType(
        [f for f in df.schema if f.name not in names.values()] + [T.StructField(c, T.DoubleType()) for c in names.values()]
    )
    kept = [f.name for f in schema if f.name not in names.values()]

    def predict(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = rows[kept].copy()
        x = rows[features].apply(pd.to_numeric).to_numpy(float) if len(rows) else np.zeros((0, len(features)))
        whole = ~np.isnan(x).any(axis=1)
        floor = np.zeros(len(rows))
        for output, column in names.items():
            model = own[own["output"] == output]
            found = np.full(len(rows), np.nan)
            if len(model):
                m = model.iloc[0]
                trees = (np.asarray(m["tree_features"]).reshape(-1, inner), np.asarray(m["tree_thresholds"]).reshape(-1, inner),
                         np.asarray(m["tree_values"]).reshape(-1, leaves))
                found[whole] = np.maximum(floor[whole], evaluate(x[whole], m["start"], *trees))
                floor[whole] = found[whole]
            out[column] = found
        return out

    both = [*keys, "_piece"]
    models = models.select(*[F.col(c).alias(c) for c in models.columns])  # columns of their own
    scored = dealt.groupBy(*both).cogroup(models.groupBy(*both)).applyInPandas(predict, schema)
    return scored.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in names.values()})
