"""Forecast models: every fit is a distributed aggregate or an MLlib job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadshape.functions.columns import step_of_day
from loadshape.operators.ordering import exact_quantiles, lookup

QUANTILES: Mapping[str, float] = {"q_lo": 0.05, "q_mid": 0.50, "q_hi": 0.95}


def non_negative(c: Column) -> Column:
    return F.greatest(F.lit(0.0), c)


# seasonal naive -------------------------------------------------------------

def seasonal_naive(columns: Sequence[str], season_lag: int = 48) -> Column:
    """The load one season ago; lag 48 if that lag was not built, 0 where it is missing."""
    name = f"load_lag_{season_lag}"
    if name not in columns:
        name = "load_lag_48"
    if name not in columns:
        raise ValueError(f"Feature column 'load_lag_{season_lag}' not found")
    c = F.col(name).cast("double")
    return non_negative(F.nanvl(F.coalesce(c, F.lit(0.0)), F.lit(0.0)))


def add_seasonal_naive(df: DataFrame, season_lag: int = 48, out: str = "y_pred") -> DataFrame:
    return df.withColumn(out, seasonal_naive(df.columns, season_lag))


# ridge ----------------------------------------------------------------------

#: Groups that the moments of a series are merged in before they meet in one task.
MERGES = 64


def moments_of(z: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, centred cross-products) of the rows of ``z``."""
    mean = z.mean(axis=0)
    c = z - mean
    return len(z), mean, c.T @ c


def merge_moments(a, b):
    """Moments of two samples taken together; what is lost is the rounding of the difference of their means."""
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def series_moments(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, n, mean, cross): mergeable moments of ``columns`` per series; rows with a missing value are left out.

    Input tasks reduce their rows to one row per series, these are merged in ``MERGES`` groups per series, and the
    groups once more: no task sees more than a few rows of arrays, however many rows a series has.
    """
    keys, columns = list(keys), list(columns)
    p = len(columns)
    schema = T.StructType(
        [df.schema[k] for k in keys]
        + T._parse_datatype_string("_part int, n long, mean array<double>, cross array<double>").fields
    )
    names = [f.name for f in schema]
    held = 1024  # series kept in a task before their moments are passed on

    def as_rows(sums: dict) -> pd.DataFrame:
        return pd.DataFrame([(*k, n, mean, cross.ravel()) for k, (n, mean, cross) in sums.items()], columns=names)

    def reduce_rows(batches):
        sums: dict = {}
        for pdf in batches:
            for key, part in pdf.groupby([*keys, "_part"], dropna=False, sort=False):
                own = moments_of(part[columns].to_numpy(float))
                sums[key] = merge_moments(sums[key], own) if key in sums else own
            if len(sums) >= held:
                yield as_rows(sums)
                sums.clear()
        if sums:
            yield as_rows(sums)

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["_part", "n"])  # one order, whatever the order of arrival
        parts = [(int(n), np.asarray(m, float), np.asarray(c, float).reshape(p, p)) for n, m, c in zip(rows["n"], rows["mean"], rows["cross"])]
        total = reduce(merge_moments, parts)
        return as_rows({(*key[: len(keys)], int(rows["_part"].iloc[0]) % MERGES): total})

    rows = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).where(_complete(columns))
    parts = rows.withColumn("_part", F.spark_partition_id()).select(*keys, *columns, "_part").mapInPandas(reduce_rows, schema)
    some = parts.groupBy(*keys, (F.col("_part") % MERGES).alias("_group")).applyInPandas(merge, schema)
    return some.groupBy(*keys).applyInPandas(merge, schema).drop("_part")


def ridge_fit(
    train: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, alpha: float = 1.0
) -> DataFrame:
    """Ridge coefficients per series, intercept unpenalised: (keys, n_rows, intercept, coefficients).

    Moments are centred before they are multiplied, so means far from 0 cost no digits; only a (p + 1)-square system
    per series is solved in Python.  Rows whose target or a feature is missing are left out of the fit and of ``n_rows``.
    """
    keys, features = list(keys), list(features)
    p = len(features)
    moments = series_moments(train, keys, [*features, target])

    @F.pandas_udf("array<double>")
    def solve(mean: pd.Series, cross: pd.Series) -> pd.Series:
        out = []
        for m, c in zip(mean, cross):
            m, c = np.asarray(m, float), np.asarray(c, float).reshape(p + 1, p + 1)
            gram = c[:-1, :-1] + alpha * np.eye(p)
            # without a penalty, collinear features have many solutions: the shortest
            beta = np.linalg.solve(gram, c[:-1, -1]) if alpha > 0 else np.linalg.lstsq(gram, c[:-1, -1], rcond=None)[0]
            out.append(np.concatenate([[m[-1] - m[:-1] @ beta], beta]))
        return pd.Series(out)

    return moments.select(*keys, F.col("n").alias("n_rows"), solve("mean", "cross").alias("_beta")).select(
        *keys, "n_rows", F.get("_beta", F.lit(0)).alias("intercept"), F.slice("_beta", 2, p).alias("coefficients")
    )


def ridge_predict(
    df: DataFrame, fitted: DataFrame, keys: Sequence[str], features: Sequence[str],
    out: str = "y_pred",
) -> DataFrame:
    """``df`` with the prediction; NULL where a feature is missing, or the series has no model."""
    joined = lookup(df, fitted.select(*keys, "intercept", "coefficients"), keys, "left")
    pred = F.col("intercept")
    for i, f in enumerate(features):
        pred = pred + F.get("coefficients", F.lit(i)) * F.col(f)
    found = F.when(_complete(features) & pred.isNotNull(), non_negative(pred))
    return joined.withColumn(out, found).drop("intercept", "coefficients")


# seasonal empirical quantiles --------------------------------------------------

def seasonal_quantile_fit(
    train: DataFrame, keys: Sequence[str], target: str, levels: Mapping[str, float] = QUANTILES,
    ts: str = "ts", steps_per_day: int = 48,
) -> DataFrame:
    """Empirical target quantiles per series, step of day and weekend flag."""
    stepped = train.select(
        *keys,
        step_of_day(ts, steps_per_day).alias("_step"),
        (F.weekday(ts) >= 5).alias("_weekend"),
        target,
    )
    return exact_quantiles(stepped, [*keys, "_step", "_weekend"], target, levels)


def seasonal_quantile_predict(
    df: DataFrame, fitted: DataFrame, keys: Sequence[str], ts: str = "ts", steps_per_day: int = 48
) -> DataFrame:
    levels = [c for c in fitted.columns if c not in (*keys, "_step", "_weekend")]
    placed = df.withColumns(
        {"_step": step_of_day(ts, steps_per_day), "_weekend": F.weekday(ts) >= 5}
    )
    joined = placed.join(fitted, [*keys, "_step", "_weekend"], "left")
    return joined.withColumns({c: non_negative(F.col(c)) for c in levels}).drop("_step", "_weekend")


def nearest_levels(fitted: Mapping[str, float], alpha: float) -> tuple[str, str, str]:
    """Names of the fitted levels closest to alpha / 2, 0.5 and 1 - alpha / 2."""
    def closest(level: float) -> str:
        return min(fitted, key=lambda name: abs(fitted[name] - level))

    return closest(alpha / 2.0), closest(0.5), closest(1.0 - alpha / 2.0)


def quantile_interval(df: DataFrame, fitted: Mapping[str, float], alpha: float = 0.10) -> DataFrame:
    """lower, median and upper from the fitted levels, with upper >= lower."""
    lo, mid, hi = nearest_levels(fitted, alpha)
    return df.withColumns(
        {"lower": F.col(lo), "median": F.col(mid), "upper": F.greatest(F.col(lo), F.col(hi))}
    )


# tree ensembles (MLlib) ------------------------------------------------------

def _assembled(df: DataFrame, features: Sequence[str], invalid: str) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid=invalid).transform(df)


def _complete(features: Sequence[str]) -> Column:
    """Whether a row has all its features."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in features])


def boosted_trees_fit(
    train: DataFrame, features: Sequence[str], target: str, max_iter: int = 150, max_depth: int = 6,
    learning_rate: float = 0.05, min_leaf: int = 20, seed: int = 42,
):
    """Gradient-boosted trees on squared error, one model over all series."""
    gbt = GBTRegressor(
        featuresCol="_x", labelCol=target, predictionCol="_p", lossType="squared", maxIter=max_iter,
        maxDepth=max_depth, stepSize=learning_rate, minInstancesPerNode=min_leaf, maxBins=255, seed=seed,
    )
    return gbt.fit(_assembled(train, features, "skip"))


def boosted_trees_predict(df: DataFrame, model, features: Sequence[str], out: str = "y_pred") -> DataFrame:
    """``df`` with the prediction; NULL where a feature is missing."""
    scored = model.transform(_assembled(df, features, "keep"))
    return scored.withColumn(out, F.when(_complete(features), non_negative(F.col("_p")))).drop("_x", "_p")


def quantile_forest_fit(
    train: DataFrame, features: Sequence[str], target: str, levels: Mapping[str, float] = QUANTILES,
    num_trees: int = 20, max_depth: int = 6, min_leaf: int = 20, seed: int = 42,
):
    """Random forest plus the empirical target quantiles of the training rows in every leaf.

    Returns (model, leaf table); the table has at most num_trees * 2**max_depth rows.
    """
    forest = RandomForestRegressor(
        featuresCol="_x", labelCol=target, predictionCol="_p", leafCol="_leaf", numTrees=num_trees,
        maxDepth=max_depth, minInstancesPerNode=min_leaf, maxBins=255, seed=seed,
    )
    x = _assembled(train, features, "skip")
    model = forest.fit(x)
    leaves = model.transform(x).select(
        F.posexplode(vector_to_array("_leaf")).alias("tree", "_l"), F.col(target).alias("_target")
    ).select("tree", F.col("_l").cast("int").alias("leaf"), "_target")
    return model, exact_quantiles(leaves, ["tree", "leaf"], "_target", levels)


def quantile_forest_predict(
    df: DataFrame, fitted, features: Sequence[str], levels: Mapping[str, float] = QUANTILES
) -> DataFrame:
    """Leaf quantiles averaged over the trees: an array lookup per row, no join of the rows.

    NULL where a feature is missing.
    """
    model, table = fitted
    names = list(levels)
    entry = F.struct("leaf", F.struct(*names).alias("q"))
    per_tree = table.groupBy("tree").agg(
        F.map_from_entries(F.collect_list(entry)).alias("_m"), F.max("leaf").alias("_last")
    ).select(
        "tree",
        F.transform(F.sequence(F.lit(0), F.col("_last")), lambda i: F.try_element_at("_m", i)).alias("_q"),
    )
    # bounded: num_trees arrays of at most 2**max_depth entries
    nested = per_tree.agg(F.sort_array(F.collect_list(F.struct("tree", "_q"))).alias("_t")).select("_t._q")
    scored = model.transform(_assembled(df, features, "keep")).withColumn("_tables", nested.scalar())
    leaf = vector_to_array("_leaf")
    hit = F.transform(leaf, lambda l, t: F.get(F.get(F.col("_tables"), t), l.cast("int")))
    scored = scored.withColumn("_hits", hit)

    def mean(name: str) -> Column:
        values = F.filter(F.transform("_hits", lambda s: s[name]), lambda v: v.isNotNull())
        return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), F.size(values))

    return scored.withColumns({n: F.when(_complete(features), non_negative(mean(n))) for n in names}).drop(
        "_x", "_p", "_leaf", "_tables", "_hits"
    )


# comparison ------------------------------------------------------------------

def stack_models(df: DataFrame, keys: Sequence[str], models: Mapping[str, str], y: str, ts: str = "ts") -> DataFrame:
    """Long table (keys, ts, model, y, y_pred) from one prediction column per model."""
    return df.select(
        *keys, ts, F.col(y).alias("y"),
        F.inline(F.array(*[
            F.struct(F.lit(m).alias("model"), F.col(c).alias("y_pred")) for m, c in models.items()
        ])),
    )


def primary_model(models: Sequence[str], preferred: str = "hist_gradient_boosting") -> str:
    """The preferred point model if present, else the first."""
    return preferred if preferred in models else list(models)[0]


def outer_levels(levels: Mapping[str, float]) -> tuple[str, str]:
    """Names of the lowest and highest quantile level."""
    return min(levels, key=levels.get), max(levels, key=levels.get)
