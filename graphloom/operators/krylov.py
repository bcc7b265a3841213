"""Weighted least squares by iteration, for as many columns as a model's dictionaries have.

Conjugate gradients on the normal equations, from zero, so that of many solutions the one of least norm (in columns
scaled to norm 1) is found. A step is one pass over the rows, each a sparse vector: a task multiplies its rows with the
direction, which is broadcast, and their transpose with that, and adds up before one sum for each column is shuffled.
The driver holds vectors of as many numbers as there are columns, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import written

#: Columns, at most.
MAX_COLUMNS = 2_000_000

ZERO, COMPATIBLE, LEAST, LIMIT = "zero", "compatible", "least squares", "limit"


@dataclass(frozen=True)
class Solution:
    """Coefficients by column, why the iteration stopped, after how many steps, and the norm of the weighted residual.

    ZERO: nothing to explain. COMPATIBLE: the rows are met within the tolerance. LEAST: no better fit within it. LIMIT:
    not converged.
    """

    coefficients: dict[int, float]
    stop: str
    steps: int
    residual: float

    @property
    def converged(self) -> bool:
        return self.stop != LIMIT


def _rows(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """y and the sparse row (idx, value), both times the root of the weight; repeated cells of a row add up."""
    top = targets.agg(F.max("weight")).first()[0] or 0.0
    known = targets.where("y IS NOT NULL AND weight IS NOT NULL").where(F.sqrt("weight") > float(np.sqrt(np.finfo(float).eps) * np.sqrt(top)))
    sums = cells.groupBy("row_id", "idx").agg(F.sum("value").alias("value")).groupBy("row_id").agg(F.collect_list(F.struct("idx", "value")).alias("c"))
    root = F.sqrt("weight")
    return sums.join(known.select("row_id", "weight", "y"), "row_id").select(
        (F.col("y") * root).alias("y"), F.col("c.idx").cast("array<bigint>").alias("idx"), F.transform("c", lambda c: c["value"].cast("double") * root).alias("value")
    )


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, column and value of each cell."""
    idx = b.column("idx")
    size = np.diff(idx.offsets.to_numpy())
    return np.repeat(np.arange(b.num_rows), size), idx.flatten().to_numpy(), b.column("value").flatten().to_numpy()


def _pass(rows: DataFrame, columns: np.ndarray, direction: np.ndarray, share: float = 0.0) -> tuple[np.ndarray, float]:
    """A't and |t|^2 for t = Ap + share y, with a direction p over the sorted columns."""
    shared = rows.sparkSession.sparkContext.broadcast((columns, direction))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, p = shared.value
        out, square = np.zeros(len(at)), 0.0
        for b in batches:
            row, idx, value = _flat(b)
            place = np.searchsorted(at, idx)
            t = np.bincount(row, value * p[place], b.num_rows) + share * b.column("y").to_numpy()
            out += np.bincount(place, value * t[row], len(at))
            square += float(t @ t)
        used = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(out[used], square))], ["place", "s"])

    out, square = np.zeros(len(columns)), 0.0
    for r in rows.mapInArrow(run, "place bigint, s double").groupBy("place").agg(F.sum("s").alias("s")).toLocalIterator():
        if r.place < 0:
            square = r.s
        else:
            out[r.place] = r.s
    shared.unpersist()
    return out, square


def least_squares(cells: DataFrame, targets: DataFrame, tolerance: float = 1e-10, max_iterations: int = 10_000) -> Solution:
    """The fit of targets (row_id, weight, y) by cells (row_id, idx, value).

    Rows with a null target or weight, or whose root weight is within rounding of 0 next to the largest, are left out.
    It stops when the residual, or what columns can still explain of it, is within the tolerance.
    """
    rows = written(_rows(cells, targets), "rows")
    square = rows.select(F.explode(F.arrays_zip("idx", "value")).alias("c")).groupBy(F.col("c.idx").alias("idx")).agg(F.sum(F.col("c.value") * F.col("c.value")).alias("s"))
    norms = square.orderBy("idx").limit(MAX_COLUMNS + 1).collect()
    if len(norms) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} columns")
    columns = np.array([r.idx for r in norms], np.int64)
    scale = np.sqrt(np.array([r.s for r in norms], float))
    scale = np.divide(1.0, scale, out=np.zeros_like(scale), where=scale > 0)
    right, y2 = _pass(rows, columns, np.zeros(len(columns)), 1.0)
    s = right * scale
    x, p, gamma, r2 = np.zeros(len(columns)), s.copy(), float(s @ s), y2
    size = np.sqrt(np.count_nonzero(scale))  # the Frobenius norm of the scaled matrix

    def stopped() -> str | None:
        left, found = np.sqrt(max(r2, 0.0)), np.sqrt(gamma)
        if left <= tolerance * (np.sqrt(y2) + size * np.linalg.norm(x)):
            return COMPATIBLE
        return LEAST if found <= tolerance * size * left else None

    stop, steps = ZERO if gamma == 0 else stopped(), 0
    while stop is None and steps < max_iterations:
        steps += 1
        image, q2 = _pass(rows, columns, p * scale)
        if q2 == 0:
            stop = LEAST
            break
        alpha = gamma / q2
        x, r2 = x + alpha * p, r2 - alpha * gamma
        s = s - alpha * image * scale
        before, gamma = gamma, float(s @ s)
        p = s + gamma / before * p
        stop = stopped()
    # what the steps have taken off has rounding of its own size, so the residual is measured
    r2 = _pass(rows, columns, -x * scale, 1.0)[1] if steps else y2
    stop = COMPATIBLE if stop in (COMPATIBLE, LEAST) and stopped() == COMPATIBLE else LEAST if stop == COMPATIBLE else stop
    return Solution(dict(zip(columns.tolist(), (x * scale).tolist(), strict=True)), stop or LIMIT, steps, float(np.sqrt(r2)))


def solved(cells: DataFrame, targets: DataFrame, tolerance: float = 1e-10, max_iterations: int = 10_000) -> dict[int, float]:
    """The coefficients; no convergence is an error."""
    found = least_squares(cells, targets, tolerance, max_iterations)
    if not found.converged:
        raise ValueError(f"no convergence within {max_iterations} steps; residual {found.residual}")
    return found.coefficients


def meets(cells: DataFrame, targets: DataFrame, tolerance: float = 1e-6, max_iterations: int = 10_000) -> bool:
    """Whether some combination of the columns gives the targets; false also where the iteration doesn't converge."""
    found = least_squares(cells, targets, tolerance, max_iterations)
    return found.stop == COMPATIBLE or found.stop == ZERO and found.residual == 0
