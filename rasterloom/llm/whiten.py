"""Whitening of embeddings: the covariance by polarisation, in exact integers.

For integer vectors x over n fitted rows with per-dimension sums S, y = n * x - S is the centred
vector times n, still an integer. One pass sums y_i ** 2 for every dimension and (y_i + y_j) ** 2 for
every pair; the covariance is half the difference (y_i + y_j) ** 2 - y_i ** 2 - y_j ** 2, over n ** 3.
No rounding happens before the final division.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.vectors import integer_vectors, matrix
from rasterloom.runtime import freeze

#: Rows whose pair sums are formed at once.
STEP_ROWS = 512
#: Sums travel as hi * 2 ** LOW_BITS + lo.
LOW_BITS = 40
#: Eigenvalues up to this share of the trace are no variance.
NO_VARIANCE = 1e-12
DIGITS = 10**38


def exact_sum(m: np.ndarray) -> list[int]:
    """Column sums as Python integers."""
    if m.dtype != object and int(np.abs(m).max(initial=0)) * len(m) >= 1 << 63:
        m = m.astype(object)
    return [int(v) for v in m.sum(axis=0)]


def exact_squares(m: np.ndarray, axis: int) -> list[int]:
    """Sums of squares along an axis as Python integers; entries are integers below 2 ** 62."""
    most = 0 if m.dtype == object else int(np.abs(m).max(initial=0))
    if m.dtype == object or most * most * m.shape[axis] < 1 << 63:
        return [int(v) for v in (m * m).sum(axis=axis)]
    high, low = m >> 31, m & (2**31 - 1)
    total = np.zeros(m.shape[1 - axis], object)
    for part, shift in ((high * high, 62), (high * low, 32), (low * low, 0)):
        total += (((part >> 31).sum(axis=axis).astype(object) << 31) + (part & (2**31 - 1)).sum(axis=axis).astype(object)) << shift
    return total.tolist()


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, as 64-bit integers where a pair sum of them is below 2 ** 62, else as Python integers."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if most < 1 << 61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def pair_squares(y: np.ndarray) -> list[int]:
    """Sums of y_i ** 2 at (i, i) and of (y_i + y_j) ** 2 at (i, j), for i <= j, row by row."""
    out = []
    for i in range(y.shape[1]):
        out += exact_squares(y[:, i:i + 1], 0)
        out += exact_squares(y[:, i + 1:] + y[:, i:i + 1], 0)
    return out


def _totals(fit: DataFrame, fn: Callable[[np.ndarray], list[int]]) -> list[int]:
    """Exact sums over all rows of what ``fn`` gives for blocks of rows; one row per sum and task is
    shuffled, and as many numbers as ``fn`` gives reach the driver."""

    def run(batches):
        total = None
        for batch in batches:
            x = matrix(batch.column(0))
            for s in range(0, len(x), STEP_ROWS):
                part = fn(x[s:s + STEP_ROWS])
                total = part if total is None else [a + b for a, b in zip(total, part)]
        if total:
            yield pa.RecordBatch.from_arrays([
                pa.array(range(len(total)), pa.int32()),
                pa.array([Decimal(v >> LOW_BITS) for v in total], pa.decimal128(38, 0)),
                pa.array([v & ((1 << LOW_BITS) - 1) for v in total], pa.int64())], names=["k", "hi", "lo"])

    parts = fit.select("x").mapInArrow(run, "k int, hi decimal(38,0), lo bigint")
    rows = parts.groupBy("k").agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo")).orderBy("k").collect()
    return [(int(r["hi"]) << LOW_BITS) + r["lo"] for r in rows]


def covariance(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance matrix (divisor n) of the fitted rows by polarisation, each entry rounded once."""
    d = len(sums)
    squares = _totals(fit, lambda x: pair_squares(centred(x, n, sums)))
    at = dict(zip([(i, j) for i in range(d) for j in range(i, d)], squares, strict=True))
    out = np.empty((d, d))
    for (i, j), s in at.items():
        out[i, j] = out[j, i] = (s if i == j else (s - at[i, i] - at[j, j]) // 2) / n**3
    return out


def directions(cov: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors in columns) of the largest eigenvalues, falling; the entry of
    largest size in a vector is positive."""
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    lead = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return np.maximum(values, 0.0), vectors * np.where(lead < 0, -1.0, 1.0)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) per usable row and component.

    Vectors become integers (:func:`rasterloom.llm.vectors.integer_vectors`, which also says which
    rows are left out); vectors of another length than most (ties: the longer) are left out too. Each
    distinct vector is fitted once, so repeated rows and null ids change nothing and keep their own
    output rows. ``n`` counts the fitted rows, ``deviation`` is the sum of (n * x - S) ** 2 (null from
    39 digits on), ``whitened`` the centred vector along a component over its standard deviation,
    ``explained`` the component's share of the variance. ``identity_error`` is the largest entry of the
    whitened columns' covariance minus the identity, from a pass over the fitted rows. A component
    without variance (all rows equal, or fewer rows than dimensions) has null ``whitened``; without any
    variance ``explained`` and ``identity_error`` are null as well. No usable row: no output row.
    """
    rows = freeze(integer_vectors(df, id_col, vector_col))
    most = rows.groupBy(F.size("x").alias("d")).count().filter("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    d = most["d"] if most else 0
    rows = rows.filter(F.size("x") == d)
    out = (f"id {rows.schema['id'].dataType.simpleString()}, component int, n bigint, deviation decimal(38,0), "
           "whitened double, explained double, identity_error double")
    if not d:
        return df.sparkSession.createDataFrame([], out)
    fit = freeze(rows.select("x").distinct())
    n = fit.count()
    sums = _totals(fit, exact_sum)
    cov = covariance(fit, n, sums)
    trace = float(np.trace(cov))
    values, vectors = directions(cov, components)
    kept = values > NO_VARIANCE * trace
    weights = vectors[:, kept] / np.sqrt(values[kept])
    explained = [float(v / trace) if trace > 0 else None for v in values]
    error = _identity_error(fit, n, sums, weights) if kept.any() else None

    def run(batches):
        for batch in batches:
            y = centred(matrix(batch.column(1)), n, sums)
            scores = np.full((len(y), len(values)), np.nan)
            scores[:, kept] = (y.astype(np.float64) / n) @ weights
            deviation = pa.array([Decimal(v) if v < DIGITS else None for v in exact_squares(y, 1)], pa.decimal128(38, 0))
            each = pa.array(np.repeat(np.arange(len(y)), len(values)))
            flat = scores.ravel()
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(each), pa.array(np.tile(np.arange(1, len(values) + 1, dtype=np.int32), len(y))),
                pa.array(np.full(len(flat), n, np.int64)), deviation.take(each), pa.array(flat, pa.float64(), mask=np.isnan(flat)),
                pa.array(explained * len(y), pa.float64()), pa.array([error] * len(flat), pa.float64())],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("id", "x").mapInArrow(run, out)


def _identity_error(fit: DataFrame, n: int, sums: list[int], weights: np.ndarray) -> float:
    """Largest absolute entry of the covariance of the whitened fitted rows minus the identity."""
    k = weights.shape[1]

    def run(batches):
        total = np.zeros((k, k))
        for batch in batches:
            w = (centred(matrix(batch.column(0)), n, sums).astype(np.float64) / n) @ weights
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array(total.ravel())], names=["k", "s"])

    rows = fit.select("x").mapInArrow(run, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).orderBy("k").collect()
    found = np.array([r["s"] for r in rows]).reshape(k, k) / n
    return float(np.abs(found - np.eye(k)).max())
