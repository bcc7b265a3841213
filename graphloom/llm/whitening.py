"""Whitening of embeddings: pivoted Cholesky of the centred scatter, one-sided Jacobi on the triangular factor."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import written

#: Components that are returned, at most.
COMPONENTS = 16
#: Dimensions, at most: the driver holds a matrix of as many rows and columns.
MAX_DIMS = 2048
#: Entries whose size is beyond this don't fit in a long as multiples of 1/64.
LARGEST = float(1 << 56)


@dataclass(frozen=True)
class Whitening:
    """Fitted on n vectors with `sums` by dimension; whitened = (x - sums / n) @ axes."""

    n: int
    sums: tuple[int, ...]
    explained: tuple[float, ...]
    axes: np.ndarray

    @property
    def center(self) -> np.ndarray:
        """The whole numbers next to the means."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """What is left of the means, times n: |rest| <= n / 2."""
        return np.array([s - self.n * int(m) for s, m in zip(self.sums, self.center, strict=True)], np.int64)


def grid(vector: str) -> Column:
    """Entries as whole numbers, 64 a unit, one million for zero; null for a vector that has no such form."""
    v = F.col(vector)
    fine = F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False)))  # NaN is more than any number
    return F.when(fine, F.transform(v, lambda c: F.floor(c.cast("double") * 64).cast("bigint") + 1_000_000))


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _centered(x: np.ndarray, w: Whitening) -> np.ndarray:
    """x - sums / n: exact to the whole mean, then less than one half is taken off."""
    return (x - w.center).astype(np.float64) - w.rest / w.n


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A lower triangular factor of v with its rows and columns in the order `pivots`, as far as pivots are not rounding.

    Each step takes the largest diagonal entry that is left, so columns fall in size; v is symmetric, without negative
    eigenvalues.
    """
    n = len(v)
    left, factor, pivots = v.astype(np.float64).copy(), np.zeros((n, n)), np.arange(n)
    least = n * np.finfo(np.float64).eps * max(np.diag(v).max(initial=0.0), 0.0)
    for k in range(n):
        d = np.diag(left)[k:]
        best = k + int(np.argmax(d))
        if left[best, best] <= least:
            return factor[:, :k], pivots
        if best != k:
            both = [k, best]
            left[both] = left[both[::-1]]
            left[:, both] = left[:, both[::-1]]
            factor[both] = factor[both[::-1]]
            pivots[both] = pivots[both[::-1]]
        factor[k, k] = np.sqrt(left[k, k])
        factor[k + 1 :, k] = left[k + 1 :, k] / factor[k, k]
        left[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, pivots


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """`factor` times the rotations that make its columns orthogonal.

    A sweep meets each pair of columns once, in rounds of disjoint pairs, all of a round at a time; it ends when a sweep
    finds no pair that is further from orthogonal than rounding.
    """
    rows, n = factor.shape
    a = np.hstack([factor, np.zeros((rows, n % 2))])
    seats = np.arange(a.shape[1])
    tolerance = np.finfo(np.float64).eps * max(1.0, np.sqrt(rows))
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            p, q = seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            off = np.abs(gamma) > tolerance * np.sqrt(alpha * beta)
            if off.any():
                turned = True
                zeta = np.divide(beta - alpha, 2 * gamma, out=np.zeros_like(gamma), where=off)
                t = np.where(off, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
                c = 1 / np.hypot(1.0, t)
                a[:, p], a[:, q] = c * x - c * t * y, c * t * x + c * y
            seats = np.concatenate([seats[:1], np.roll(seats[1:], 1)])
        if not turned:
            break
    return a[:, :n]


def eigenpairs(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues above rounding, falling, and unit eigenvectors as columns, their largest entry positive."""
    factor, pivots = pivoted_cholesky(v)
    columns = one_sided_jacobi(factor)
    values = (columns * columns).sum(0)
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > 0]
    vectors = np.empty((len(v), len(order)))
    vectors[pivots] = columns[:, order] / np.sqrt(values[order])
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(order))]) if len(order) else np.ones(0)
    return values[order], vectors * signs


def _sums(dims: int):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)  # halves of 32 bits can't overflow
        for b in batches:
            x = _matrix(b.column(0), dims)
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(np.full(dims, n)), pa.array(high), pa.array(low)], ["dim", "n", "high", "low"])

    return sums


def _scatter(w: Whitening, project: bool):
    """Sums of products of centred (or whitened) entries, a task's rows added up before anything is sent."""
    dims = len(w.sums)
    size = w.axes.shape[1] if project else dims

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, i, j = np.zeros((size, size)), *np.triu_indices(size)
        for b in batches:
            c = _centered(_matrix(b.column(0), dims), w)
            c = c @ w.axes if project else c
            total += c.T @ c
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "s"])

    return scatter


def _covariance(fit: DataFrame, w: Whitening, project: bool = False) -> np.ndarray:
    size = w.axes.shape[1] if project else len(w.sums)
    v = np.zeros((size, size))
    for r in fit.mapInArrow(_scatter(w, project), "i bigint, j bigint, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toLocalIterator():
        v[r.i, r.j] = v[r.j, r.i] = r.s / w.n
    return v


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> tuple[Whitening, float] | None:
    """The whitening of the vectors of `fit` (x, each once and all as long), and the identity error; None without vectors.

    The identity error is the largest entry of the whitened vectors' covariance less the identity. Components whose
    variance is rounding (no more than the rank of the vectors has) are left out. The driver gets sums by dimension and
    the covariance, of at most MAX_DIMS columns.
    """
    first = fit.first()
    if first is None:
        return None
    dims = len(first.x)
    if dims > MAX_DIMS:
        raise ValueError(f"vectors have {dims} dimensions, more than {MAX_DIMS}")
    parts = fit.mapInArrow(_sums(dims), "dim bigint, n bigint, high bigint, low bigint").groupBy("dim")
    sums = parts.agg(F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).orderBy("dim").collect()
    plain = Whitening(int(sums[0].n), tuple((int(r.high) << 32) + int(r.low) for r in sums), (), np.zeros((dims, 0)))
    v = _covariance(fit, plain)
    values, vectors = eigenpairs(v)
    values, vectors, total = values[:components], vectors[:, :components], float(np.trace(v))
    w = Whitening(plain.n, plain.sums, tuple(float(e) / total for e in values), vectors / np.sqrt(values))
    k = len(values)
    return w, float(np.abs(_covariance(fit, w, project=True) - np.eye(k)).max()) if k else 0.0


def _deviations(x: np.ndarray, w: Whitening) -> list[int | None]:
    """Exact sums of (n * x - sums)^2; null beyond 64 bits."""
    y, rest = x - w.center, w.rest
    largest = w.n * (int(np.abs(y).max(initial=0)) + 1)
    if largest * largest * len(w.sums) < 1 << 63:
        d = w.n * y - rest
        return (d * d).sum(1).tolist()
    rest = rest.tolist()
    sums = [sum((w.n * a - r) ** 2 for a, r in zip(row, rest, strict=True)) for row in y.tolist()]
    return [s if s < 1 << 63 else None for s in sums]


def _applied(w: Whitening, error: float):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = w.axes.shape[1]
        for b in batches:
            x = _matrix(b.column(1), len(w.sums))
            rows = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(rows)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(rows), w.n)),
                    pa.array(_deviations(x, w), pa.int64()).take(pa.array(rows)),
                    pa.array((_centered(x, w) @ w.axes).ravel()),
                    pa.array(np.tile(np.array(w.explained), len(x))),
                    pa.array(np.full(len(rows), error)),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return apply


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """id_col, component (from 1), n, deviation, whitened, explained and identity_error, for each row and component.

    Entries become whole numbers x, 64 a unit. Rows are left out whose vector is null or empty, holds a null, a number
    that isn't finite or one beyond 2^56, or has another length than most distinct vectors have (of equal ones, the
    longest). The whitening is fitted on each distinct vector once; n is how many. Repeated ids and null ids stay.
    Vectors without any variance have no components, so no rows; other columns are not looked at.
    """
    rows = vectors.select(F.col(id_col).alias("id"), grid(vector_col).alias("x")).where(F.size("x") > 0)
    fit = written(rows.select("x").distinct(), "distinct-vectors")
    lengths = fit.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    kind = dict(vectors.dtypes)[id_col]
    schema = f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if lengths is None:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    found = fit_whitening(fit.where(F.size("x") == lengths.dims), components)
    return rows.where(F.size("x") == lengths.dims).mapInArrow(_applied(*found), schema).withColumnRenamed("id", id_col)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
