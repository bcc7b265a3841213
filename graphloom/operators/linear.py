"""Linear models on sparse rows (row_id, idx, value): Gram matrices by join and aggregation, solved on the driver.

The number of columns is that of fragments and features, which a model's dictionary bounds; what comes to the driver is
a matrix of that size, never rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a model that is solved on the driver, at most.
MAX_COLUMNS = 4096


def column_norms(cells: DataFrame) -> DataFrame:
    return cells.groupBy("idx").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))


def gram(cells: DataFrame) -> DataFrame:
    """(i, j, v) with i <= j: sums over rows of the products of two columns."""
    rows = cells.groupBy("row_id").agg(F.collect_list(F.struct("idx", "value")).alias("c"))  # a row is one graph's vector
    pairs = rows.select(F.explode("c").alias("a"), "c").select("a", F.explode("c").alias("b")).where("a.idx <= b.idx")
    return pairs.groupBy(F.col("a.idx").alias("i"), F.col("b.idx").alias("j")).agg(F.sum(F.col("a.value") * F.col("b.value")).alias("v"))


def scaled_gram(cells: DataFrame) -> DataFrame:
    """The Gram matrix of columns of norm 1; columns of norm 0 are left out."""
    norms = column_norms(cells).where("norm > 0")
    left, right = norms.select(F.col("idx").alias("i"), F.col("norm").alias("ni")), norms.select(F.col("idx").alias("j"), F.col("norm").alias("nj"))
    return gram(cells).join(left, "i").join(right, "j").select("i", "j", (F.col("v") / (F.col("ni") * F.col("nj"))).alias("v"))


def normal_equations(cells: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weighted Gram matrix (i, j, v) and right side (i, v); targets has row_id, weight and y, rows with a null y go."""
    known = targets.where("y IS NOT NULL AND weight IS NOT NULL").select("row_id", "weight", "y")
    joined = cells.join(known, "row_id")
    scaled = joined.select("row_id", "idx", (F.col("value") * F.sqrt("weight")).alias("value"))
    right = joined.groupBy(F.col("idx").alias("i")).agg(F.sum(F.col("value") * F.col("weight") * F.col("y")).alias("v"))
    return gram(scaled), right


def _dense(g: DataFrame, rows: list[int]) -> np.ndarray:
    at = {k: n for n, k in enumerate(rows)}
    out = np.zeros((len(rows), len(rows)))
    for r in g.toLocalIterator():
        out[at[r["i"]], at[r["j"]]] = out[at[r["j"]], at[r["i"]]] = r["v"]
    return out


def least_squares(cells: DataFrame, targets: DataFrame, rcond: float = 1e-10) -> dict[int, float]:
    """Coefficients of the weighted fit; of many, those of least norm in columns scaled to norm 1.

    Rows whose root weight is within rounding of 0 next to the largest are left out.
    """
    top = targets.agg(F.max("weight")).first()[0] or 0.0
    targets = targets.where(F.sqrt("weight") > float(np.sqrt(np.finfo(float).eps) * np.sqrt(top)))
    g, right = normal_equations(cells, targets)
    y = {r["i"]: r["v"] for r in right.toLocalIterator()}
    idx = sorted(y)
    if len(idx) > MAX_COLUMNS:
        raise ValueError(f"{len(idx)} columns; at most {MAX_COLUMNS} are solved on the driver")
    a = _dense(g, idx)
    norm = np.sqrt(np.diag(a))
    norm[norm == 0] = 1
    x = np.linalg.pinv(a / np.outer(norm, norm), rcond=rcond, hermitian=True) @ (np.array([y[i] for i in idx]) / norm) / norm
    return dict(zip(idx, x.tolist(), strict=True))


def predict(cells: DataFrame, coefficients: DataFrame, name: str = "pred") -> DataFrame:
    """row_id and the sum of value times coefficient (idx, coef); null if a column has none."""
    found = cells.join(coefficients, "idx", "left")
    return found.groupBy("row_id").agg(F.when(F.bool_and(F.col("coef").isNotNull()), F.sum(F.col("value") * F.col("coef"))).alias(name))


def span_basis(cells: DataFrame, tolerance: float = 1e-9) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Column numbers, norms, and an orthonormal basis of the rows' span in columns scaled to norm 1."""
    norms = {r["idx"]: r["norm"] for r in column_norms(cells).where("norm > 0").toLocalIterator()}
    idx = sorted(norms)
    if len(idx) > MAX_COLUMNS:
        raise ValueError(f"{len(idx)} columns; at most {MAX_COLUMNS} are solved on the driver")
    values, vectors = np.linalg.eigh(_dense(scaled_gram(cells), idx)) if idx else (np.empty(0), np.empty((0, 0)))
    keep = values > tolerance * max(values.max(initial=0), 1e-300)
    return idx, np.array([norms[i] for i in idx]), vectors[:, keep]


def in_span(cells: DataFrame, train: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """row_id and whether the row is a combination of the training rows, up to a relative residual."""
    return in_span_of(cells, *span_basis(train), tolerance)


def in_span_of(cells: DataFrame, idx: list[int], norm: np.ndarray, basis: np.ndarray, tolerance: float = 1e-6) -> DataFrame:
    """The same for a span that `span_basis` has found; tasks get it as one broadcast, of MAX_COLUMNS columns at most."""
    if len(idx) > MAX_COLUMNS:
        raise ValueError(f"{len(idx)} columns; at most {MAX_COLUMNS}")
    shared = cells.sparkSession.sparkContext.broadcast(({k: n for n, k in enumerate(idx)}, norm, basis))

    def judge(batches):
        at, norm, basis = shared.value
        for b in batches:
            ok = []
            for row in b.column("c").to_pylist():
                if any(c["idx"] not in at and c["value"] for c in row):
                    ok.append(False)
                    continue
                x = np.zeros(len(at))
                for c in row:
                    if c["idx"] in at:
                        x[at[c["idx"]]] += c["value"] / norm[at[c["idx"]]]
                rest = x - basis @ (basis.T @ x)
                ok.append(bool(np.linalg.norm(rest) <= tolerance * max(np.linalg.norm(x), 1e-300)))
            yield pa.RecordBatch.from_arrays([b.column("row_id"), pa.array(ok)], ["row_id", "in_span"])

    rows = cells.groupBy("row_id").agg(F.collect_list(F.struct("idx", "value")).alias("c"))
    return rows.mapInArrow(judge, f"row_id {rows.schema['row_id'].dataType.simpleString()}, in_span boolean")


def covariance_groups(scaled: DataFrame, tolerance: float = 1e-6) -> list[list[int]]:
    """Columns whose coefficients can't be told apart: groups of two or more that share combinations with no effect.

    `scaled` is a `scaled_gram`. Two columns belong together if a vector that the matrix makes zero, among those nearest
    to one of them, has a part of the other; groups are the components of that. Columns of which no such vector has a
    part are in none.
    """
    idx = sorted({r["i"] for r in scaled.where("i = j").select("i").toLocalIterator()})
    if len(idx) > MAX_COLUMNS:
        raise ValueError(f"{len(idx)} columns; at most {MAX_COLUMNS} are solved on the driver")
    if not idx:
        return []
    values, vectors = np.linalg.eigh(_dense(scaled, idx))
    kernel = vectors[:, values <= tolerance * max(values.max(), 1e-300)]
    together = np.abs(kernel @ kernel.T) > tolerance
    group = np.arange(len(idx))
    while True:  # the smallest number among neighbours, until nothing changes
        least = np.where(together, group[None, :], len(idx)).min(axis=1)
        new = np.minimum(group, least)
        if (new == group).all():
            break
        group = new
    return [[idx[k] for k in np.flatnonzero(group == g)] for g in np.unique(group) if (group == g).sum() > 1]
