"""Embedding whitening: Chebyshev-filtered subspace iteration over distributed passes, certified by its residuals.

A vector's entry c becomes x = floor(64 c) + 1000000. The fit list holds every different x vector once; V is its
covariance with divisor n, centred before multiplying. A block of `components + guard` directions is iterated: every
step of the polynomial recurrence is one pass over the fit list, in which each task adds up Xc'(Xc Q) of its rows and
Spark adds up the tasks' sums by row of the result. The polynomial is small on [lowest, cut] (the unwanted spectrum) and
grows fast above it; then QR, one more pass for the Rayleigh-Ritz matrix Q'VQ, and the residuals |V q - e q|. The loop
ends once every wanted residual is below `TOLERANCE` times the largest eigenvalue; a loop that does not get there within
`ROUNDS` rounds raises an error instead of returning components that are not certified. Where the block spans all
dimensions, the first Rayleigh-Ritz step is exact.

What is on the driver has the size dims x block, whatever the number of rows. A pass that is run again after a lost
executor gives the same sums but for rounding.

Defined cases: rows whose vector is null or holds null or non-finite entries give no rows, and neither do rows whose
vector has another length than the most frequent one (ties: the shorter); equal vectors count once in the fit but each
row is returned; rows that repeat and null ids are returned like others; components without variance (below 1e-12 of
the trace) are left out, so that an empty table, one distinct vector or vectors of length zero give no rows; other
columns are ignored. Sums that leave 64 bits raise an error (ANSI arithmetic).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderpulse.llm.common import settle

COMPONENTS, GUARD = 16, 16
#: Steps of the recurrence in a round, rounds, and the residual to reach, relative to the largest eigenvalue.
DEGREE, ROUNDS, TOLERANCE = 8, 40, 1e-13
#: What a component must carry of the trace.
RANK = 1e-12
SCALE, SHIFT, SEED = 64, 1_000_000, 13


@dataclass
class Fit:
    """Centre sums, count and certified components of a fit list."""

    n: int
    sums: np.ndarray
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residual: float
    passes: int


def scaled(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, x) of the vectors (vec_id, embedding) that take part."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("long") + F.lit(SHIFT))
    taken = vectors.where(F.col("embedding").isNotNull() & fine).select("vec_id", x.alias("x"))
    sizes = taken.groupBy(F.size("x").alias("dim")).count()
    usual = sizes.select(F.max(F.struct("count", (-F.col("dim")).alias("less")))["less"].alias("less"))
    return settle(taken.join(F.broadcast(usual), F.size("x") == -F.col("less")).select("vec_id", "x"), "scaled")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _centred(batch: pa.RecordBatch, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n from the exact integer n x - S."""
    return (n * _matrix(batch.column("x")) - sums) / n


def product(rows: DataFrame, n: int, sums: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Xc'(Xc Q) / n by one pass: partial sums of each task, added up by Spark for every row of the result."""
    dim, width = q.shape
    sent = rows.sparkSession.sparkContext.broadcast((sums, q))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, q = sent.value
        total = np.zeros((dim, width))
        for batch in batches:
            if batch.num_rows:
                c = _centred(batch, n, sums)
                total += c.T @ (c @ q)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(dim + 1) * width, pa.int32()), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), lists], ["i", "y"])

    parts = rows.select("x").mapInArrow(work, "i int, y array<double>")
    added = parts.groupBy("i").agg(F.array(*[F.sum(F.col("y")[j]) for j in range(width)]).alias("y")).collect()
    sent.destroy()
    result = np.zeros((dim, width))
    for r in added:
        result[r["i"]] = r["y"]
    return result / n


def filtered(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, low: float, cut: float, top: float, degree: int) -> np.ndarray:
    """Scaled Chebyshev recurrence: damps what lies in [low, cut] against `top`; a product `times` for each degree."""
    half, middle = (cut - low) / 2, (cut + low) / 2
    sigma = first = half / (top - middle)
    y = (times(q) - middle * q) * (sigma / half)
    for _ in range(1, degree):
        new = 1 / (2 / first - sigma)
        q, y = y, 2 * (new / half) * (times(y) - middle * y) - sigma * new * q
        sigma = new
    return y


def fit(rows: DataFrame, components: int = COMPONENTS, guard: int = GUARD, degree: int = DEGREE, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> Fit | None:
    """Components of the different vectors of `rows` (x); None where there is nothing to fit."""
    once = settle(rows.select("x").distinct(), "fit")
    n, dim = once.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n or not dim:
        return None
    summed = once.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum("c").alias("s")).collect()
    sums = np.zeros(dim, np.int64)
    for r in summed:
        sums[r["i"]] = r["s"]
    squares = deviations(once, n, sums).select(F.sum(F.col("deviation").cast("double"))).first()[0]
    trace = squares / n / n / n
    if trace <= 0:
        return Fit(n, sums, 0.0, np.zeros(0), np.zeros((dim, 0)), 0.0, 0)
    width = min(dim, components + guard)
    passes = 0

    def times(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return product(once, n, sums, q)

    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, width)))[0]
    residual = np.inf
    for _ in range(rounds):
        vq = times(q)
        small = q.T @ vq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        wanted = min(components, int((values > RANK * trace).sum()))
        errors = np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0)
        residual = float(errors.max(initial=0.0)) / max(values[0], np.finfo(float).tiny)
        # A block of all dimensions holds all eigenvectors: its Rayleigh-Ritz step is the whole solution.
        if width == dim or residual <= tolerance:
            return Fit(n, sums, trace, values[:wanted], q[:, :wanted], residual, passes)
        # The unwanted spectrum ends at the smallest Ritz value; all eigenvalues are positive.
        cut = max(values[-1], values[0] * 1e-8)
        q = np.linalg.qr(filtered(times, q, 0.0, cut, values[0] * 1.000001, degree))[0]
    raise RuntimeError(f"components not certified after {rounds} rounds: residual {residual:.3g}, wanted {tolerance:.3g}")


def deviations(rows: DataFrame, n: int, sums: np.ndarray) -> DataFrame:
    """Rows with their exact sum over dimensions of (n x - S)^2."""
    centre = F.array(*[F.lit(int(s)) for s in sums])
    apart = F.zip_with("x", centre, lambda x, s: F.lit(n).cast("long") * x - s)
    return rows.withColumn("deviation", F.aggregate(apart, F.lit(0).cast("long"), lambda a, d: a + d * d))


def apply(rows: DataFrame, fit: Fit) -> DataFrame:
    """Rows (vec_id, deviation, whitened): the components' coordinates of every row (vec_id, x)."""
    n, sums = fit.n, fit.sums
    turn = fit.vectors / np.sqrt(fit.values)
    kind = rows.schema["vec_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w = _centred(batch, n, sums) @ turn
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("deviation"), lists], ["vec_id", "deviation", "whitened"])

    return deviations(rows, n, sums).mapInArrow(work, f"vec_id {kind}, deviation long, whitened array<double>")


def identity_error(rows: DataFrame, fit: Fit) -> float:
    """Largest entry of |covariance of the whitened fit list - identity|, measured by a pass of its own."""
    turn = fit.vectors / np.sqrt(fit.values)
    k = turn.shape[1]
    # Xc'(Xc W) / n, then W' from the left, is the covariance of the whitened rows.
    seen = turn.T @ product(settle(rows.select("x").distinct(), "fit"), fit.n, fit.sums, turn)
    return float(np.abs(seen - np.eye(k)).max(initial=0.0))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error, residual."""
    columns = "vec_id, component, n, deviation, whitened, explained, identity_error, residual"
    rows = scaled(vectors.select("vec_id", "embedding"))
    found = fit(rows, components)
    if found is None or not len(found.values):
        kind = rows.schema["vec_id"].dataType.simpleString()
        empty = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"
        return rows.sparkSession.createDataFrame([], empty)
    shares = F.array(*[F.lit(float(e / found.trace)) for e in found.values])
    spread = apply(rows, found).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return spread.select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", "whitened",
        shares[F.col("k")].alias("explained"), F.lit(identity_error(rows, found)).alias("identity_error"), F.lit(found.residual).alias("residual"),
    ).select(*columns.split(", "))
