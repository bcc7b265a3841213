"""Whitening against numpy's own decomposition."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm.whitening import eigenpairs, one_sided_jacobi, pivoted_cholesky, whiten

EXTRA = "x long, id string, n int, component int, dims int"


def vectors(seed=3, n=180, dims=24) -> list[tuple]:
    r = np.random.default_rng(seed)
    v = (r.normal(size=(n, 6)) @ r.normal(size=(6, dims)) * 0.3 + r.normal(size=(n, dims)) * 0.05 - 0.2).astype(np.float32)
    rows = [(k, [float(c) for c in row]) for k, row in enumerate(v)]
    rows += [(1000 + k, rows[0][1]) for k in range(60)]  # a group of copies
    rows += [(5, rows[1][1]), (None, rows[2][1]), (2000, None), (2001, []), (2002, [1.0] * (dims - 1)), (2003, [None, *rows[3][1][1:]])]
    rows += [(2004 + k, [bad, *rows[3][1][1:]]) for k, bad in enumerate((math.nan, math.inf, -math.inf))]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "i", 2, 3, 4) for r in rows], f"vec_id long, embedding array<float>, {EXTRA}")


def by_hand(rows, dims, most=16):
    """{id: {component: values}} as lists, and the eigenvalues, by exact sums and numpy's eigh."""
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    shift = [s // n for s in sums]
    c = np.array([[x - m - (s - n * m) / n for x, m, s in zip(row, shift, sums)] for row in fit])
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1], axes[:, ::-1]
    out = []
    for i, x in kept:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        y = np.array([a - m - (s - n * m) / n for a, m, s in zip(x, shift, sums)])
        out += [(i, k + 1, n, deviation, y @ axes[:, k] / math.sqrt(values[k]), values[k] / values.sum()) for k in range(min(most, dims))]
    return out


def test_factors():
    r = np.random.default_rng(1)
    for dims, rank in ((1, 1), (2, 2), (7, 7), (30, 30), (31, 12), (8, 0)):
        a = r.normal(size=(dims, rank)) * np.logspace(0, -3, rank)
        v = a @ a.T
        factor, pivots = pivoted_cholesky(v)
        assert factor.shape[1] == rank and np.allclose(np.triu(factor, 1)[:rank], 0)
        assert np.allclose(factor @ factor.T, v[np.ix_(pivots, pivots)], atol=1e-12)
        turned = one_sided_jacobi(factor)
        assert np.allclose(turned @ turned.T, factor @ factor.T, atol=1e-12)
        gram = turned.T @ turned
        norms = np.sqrt(np.diag(gram))
        assert np.all(np.abs(gram - np.diag(np.diag(gram))) <= 1e-13 * np.outer(norms, norms))
        values, axes = eigenpairs(v)
        assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:rank], rtol=1e-9, atol=1e-13)
        assert np.allclose(axes.T @ axes, np.eye(rank), atol=1e-12)


def test_whitened(spark):
    rows = vectors()
    got = whiten(table(spark, rows).repartition(5)).collect()
    want = by_hand(rows, 24)
    assert len(got) == len(want)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], abs(r[4]))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    assert np.allclose([abs(r[4]) for r in got], [abs(r[4]) for r in want], atol=1e-9)
    signs = {}
    for g, w in zip(got, want, strict=True):  # either sign, the same for all rows
        if abs(w[4]) > 1e-6:
            signs.setdefault(g[1], set()).add(np.sign(g[4] * w[4]))
    assert all(len(s) == 1 for s in signs.values())
    assert len({r[6] for r in got}) == 1 and got[0][6] < 1e-9


def test_few_vectors(spark):
    """Copies of one vector have no variance; fewer vectors than dimensions have few components; none have no rows."""
    assert whiten(table(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect() == []
    got = whiten(table(spark, [(1, [0.5, 0.25, 1.0]), (2, [0.75, 0.25, 1.0]), (2, [0.75, 0.25, 1.0])])).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation) for r in sorted(got)] == [(1, 1, 2, 256), (2, 1, 2, 256), (2, 1, 2, 256)]
    assert np.allclose([abs(r.whitened) for r in got], 1) and np.allclose([r.explained for r in got], 1)
    for rows in ([], [(1, None)], [(1, [math.nan])]):
        none = whiten(table(spark, rows))
        assert none.collect() == [] and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_entries(spark):
    """Deviations are exact as long as they fit in 64 bits, and null beyond."""
    rows = [(1, [float(1 << 20), 0.0]), (2, [0.0, 3.0]), (3, [float(1 << 50), 1.0]), (4, [1e30, 0.0])]
    got = {(r.vec_id, r.deviation) for r in whiten(table(spark, rows).withColumn("embedding", F.col("embedding").cast("array<double>"))).collect()}
    want = {(i, d if d < 1 << 63 else None) for i, _, _, d, _, _ in by_hand(rows[:3], 2)}
    assert got == want


@pytest.mark.parametrize("dims", [1, 17])
def test_dimensions(spark, dims):
    rows = vectors(seed=dims, n=60, dims=dims)
    got = {(r.vec_id, r.component): abs(r.whitened) for r in whiten(table(spark, rows)).collect() if r.vec_id is not None}
    want = {(i, k): abs(w) for i, k, _, _, w, _ in by_hand(rows, dims) if i is not None}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in got)
