"""Whitening of embeddings by the covariance of distinct vectors, weighted with how often each occurs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadshape.llm.common import cut
from loadshape.llm.vectors import doubles, finite, lists, matrix

#: Integers up to here are sums of products that 64 bits hold.
SAFE = 1 << 62
LARGEST = (1 << 53) - 1


def quantised(vector: str, scale: int, offset: int) -> Column:
    """floor(scale * c) + offset for every entry c as double, kept within 53 bits."""
    at = lambda c: F.least(F.greatest(F.floor(c * F.lit(float(scale))), F.lit(-LARGEST)), F.lit(LARGEST))
    return F.transform(doubles(vector), lambda c: at(F.least(F.greatest(c, F.lit(-1e15)), F.lit(1e15))) + F.lit(offset))


def _weighted_sums(fitted: DataFrame) -> tuple[int, list[int]]:
    """Sum of the weights and, per dimension, of weight times value: exact, one row per task and dimension shuffled."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, total = 0, None
        for b in batches:
            if not len(b):
                continue
            w, x = b.column("w").to_numpy(zero_copy_only=False), matrix(b.column("x"))
            if int(w.sum()) * int(np.abs(x).max(initial=0)) >= SAFE:
                w, x = w.astype(object), x.astype(object)
            part = w @ x
            weight, total = weight + int(w.sum()), [int(s) + (total[i] if total else 0) for i, s in enumerate(part)]
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(-1, len(total)), pa.int32()), pa.array([weight, *total], pa.decimal128(38, 0))], ["i", "s"]
            )

    parts = fitted.select("w", "x").mapInArrow(partial, "i int, s decimal(38,0)")
    sums = {r.i: int(r.s) for r in parts.groupBy("i").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()}
    return sums.get(-1, 0), [sums[i] for i in range(len(sums) - 1)]


@dataclass(frozen=True)
class Centre:
    """The mean as an integer and a rest below one: differences to it lose no digit."""

    n: int
    whole: np.ndarray
    rest: np.ndarray  # sum minus n times whole, as Python integers

    @classmethod
    def of(cls, n: int, sums: list[int]) -> Centre:
        whole = [round(Fraction(s, n)) for s in sums]
        return cls(n, np.array(whole, np.int64), np.array([s - n * w for s, w in zip(sums, whole)], object))

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - np.array([float(Fraction(int(r), self.n)) for r in self.rest])

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Per row the sum over the dimensions of (n * x - sum)^2, exact."""
        off = x - self.whole
        if len(self.rest) * (self.n * (int(np.abs(off).max(initial=0)) + 1)) ** 2 < SAFE:
            far = self.n * off - self.rest.astype(np.int64)
            return pa.array((far * far).sum(axis=1)).cast(pa.decimal128(38, 0))
        far = self.n * off.astype(object) - self.rest
        return pa.array([int(v) for v in (far * far).sum(axis=1)], pa.decimal128(38, 0))


def _weighted_covariance(fitted: DataFrame, column: str, n: int, centred) -> np.ndarray:
    """Sum of w * c c' / n over the rows, c the centred vector: a matrix product per batch, a matrix per task shuffled."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for b in batches:
            if len(b):
                c = centred(matrix(b.column(column)))
                total = total + (c * b.column("w").to_numpy(zero_copy_only=False)[:, None]).T @ c
        if not np.isscalar(total):
            p = len(total)
            at = np.arange(p * p, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], ["at", "v"])

    parts = fitted.select("w", column).mapInArrow(partial, "at long, v double")
    cells = parts.groupBy("at").agg(F.sum("v").alias("v")).toPandas().sort_values("at")
    p = round(len(cells) ** 0.5)
    return cells["v"].to_numpy().reshape(p, p) / n


def _mean(fitted: DataFrame, column: str, n: int) -> np.ndarray:
    at = F.posexplode(column).alias("i", "v")
    sums = fitted.select("w", at).groupBy("i").agg(F.sum(F.col("w") * F.col("v")).alias("s")).orderBy("i").collect()
    return np.array([r.s for r in sums]) / n


def whiten(
    df: DataFrame, key: str, vector: str, *, scale: int = 1024, offset: int = 100_000, components: int = 8,
    weights: str = "counts",
) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) per row of ``df`` and principal component.

    Every entry c of a vector, as double, becomes the integer x = floor(scale * c) + offset.  Identical x-vectors are
    one entry: copies of any number are merged before the shuffle, fitted as one weighted row (``weights='counts'``, or
    ``'one'`` to give every distinct vector the same weight), whitened once, and joined back.  ``n`` is the total weight.
    Sums and the mean are exact; the covariance has divisor ``n`` and is a weighted product of centred vectors per batch,
    summed over the tasks.  Components are its unit eigenvectors by falling eigenvalue, numbered from 1, their largest
    entry positive.  ``whitened`` is the centred vector projected on the component, over the root of the eigenvalue;
    ``explained`` the eigenvalue's share of the trace; ``deviation`` the sum over the dimensions of (n * x - sum)^2 as
    decimal(38,0); ``identity_error`` the largest absolute entry of the whitened vectors' own covariance, measured, less
    the identity.  What goes to the driver is one matrix of the dimension, whatever the number of rows.

    A vector that is NULL, empty or holds a NULL or non-finite entry gives no rows; nor does one whose length is not the
    most frequent one (the least of several).  Components without variance have a NULL ``whitened`` and do not count in
    ``identity_error``, which is NULL if there is no other.  NULL and repeated keys are ordinary rows.  An x beyond 53 bits
    is held at that bound.  Other columns of ``df`` play no part, whatever their names.  An empty table gives an empty
    result.
    """
    if weights not in ("counts", "one"):
        raise ValueError("weights are 'counts' or 'one'")
    rows = df.where(finite(vector)).select(F.col(key).alias("key"), quantised(vector, scale, offset).alias("x"))
    weight = F.count(F.lit(1)) if weights == "counts" else F.lit(1).cast("long")
    groups = cut(rows.groupBy("x").agg(weight.alias("w")))
    kind = df.schema[key].dataType.simpleString()
    result = (
        f"`{key}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, "
        "identity_error double"
    )
    lengths = groups.groupBy(F.size("x").alias("p")).agg(F.sum("w").alias("w")).orderBy(F.desc("w"), "p").limit(1).collect()
    if not lengths:
        return df.sparkSession.createDataFrame([], result)
    groups = groups.where(F.size("x") == lengths[0].p)
    n, sums = _weighted_sums(groups)
    centre = Centre.of(n, sums)
    covariance = _weighted_covariance(groups, "x", n, centre.centred)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    trace = float(np.trace(covariance))
    varies = values > max(trace, 0.0) * len(sums) * np.finfo(float).eps
    turn = np.where(varies, axes / np.sqrt(np.where(varies, values, 1.0)), 0.0)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = matrix(b.column("x"))
                yield pa.RecordBatch.from_arrays(
                    [b.column("x"), b.column("w"), centre.deviations(x), lists(centre.centred(x) @ turn)], ["x", "w", "deviation", "z"]
                )

    white = cut(groups.select("x", "w").mapInArrow(project, "x array<long>, w long, deviation decimal(38,0), z array<double>"))
    error = None
    if varies.any():
        middle = _mean(white, "z", n)
        spread = _weighted_covariance(white, "z", n, lambda z: z - middle)
        error = float(np.abs(spread - np.eye(len(values)))[np.ix_(varies, varies)].max())
    shares = [float(v) / trace if trace > 0 else None for v in values]
    parts = F.array(*[
        F.struct(
            F.lit(i + 1).alias("component"),
            (F.element_at("z", i + 1) if varies[i] else F.lit(None).cast("double")).alias("whitened"),
            F.lit(share).cast("double").alias("explained"),
        )
        for i, share in enumerate(shares)
    ])
    found = rows.join(white.select("x", "deviation", "z"), "x").select("key", "deviation", F.explode(parts).alias("c"))
    return found.select(
        F.col("key").alias(key), "c.component", F.lit(n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained",
        F.lit(error).cast("double").alias("identity_error"),
    )
