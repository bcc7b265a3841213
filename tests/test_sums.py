"""Sums over partitions that are not listed, against lists, and on graphs with more partitions than can be listed."""

import math
import random

import numpy as np
import pytest

from graphloom.operators import mining, sums, tuning
from graphloom.operators.kernels import all_exact_covers, fragments_of

GRAPH = "graph_id long, group long, weight double, bonds array<struct<src:int,trg:int>>, colors array<int>"
MODEL = {";0": (0, -1.0), ";1": (1, -1.5), "0,1;0,0": (2, -2.0), "0,1;0,1": (3, -1.8), "0,1;1,1": (4, -2.5)}
LONG = 80  # vertices of a path: some 6e16 partitions


def random_graph(r):
    n = r.randint(1, 6)
    return [r.randint(0, 1) for _ in range(n)], [(a, b) for b in range(n) for a in range(b) if r.random() < 0.5]


def test_against_lists():
    r = random.Random(3)
    for _ in range(40):
        colors, bonds = random_graph(r)
        found = fragments_of(colors, bonds, 3)
        names = {t: k for k, t in enumerate(sorted(found)) if r.random() < 0.8}
        places = sorted((m, names[t]) for t, sets in found.items() if t in names for m in sets)
        if {v for m, _ in places for v in m} != set(range(len(colors))):
            continue
        covers = [list(c) for c in all_exact_covers([list(m) for m, _ in places])]
        lw = np.array([-r.random() * 3 - 0.1 for _ in range(len(found))])
        ids = np.array([[i for _, i in places]] * 2)
        steps = sums.steps_of(tuple(m for m, _ in places))
        assert steps.n_parts == len(covers)
        if not covers:
            continue
        w = lw[ids]
        logs = np.array([sum(w[0][x] for x in c) for c in covers])
        total, share = sums.shares(steps, w)
        assert np.allclose(total, np.logaddexp.reduce(logs)) and np.allclose(sums.best_sums(steps, w), logs.max())
        want = np.zeros(len(places))
        for c, x in zip(covers, np.exp(logs - total[0]), strict=True):
            want[c] += x
        assert np.allclose(share, want)
        free = tuning.freed(lw)
        parts = [(x, [{"id": i, "n": [places[k][1] for k in c].count(i)} for i in {places[k][1] for k in c}]) for x, c in zip(logs, covers, strict=True)]
        assert np.allclose(sums.log_losses(steps, w, ids, free), tuning.losses_of(parts, free))


def test_none_likely_and_no_cover():
    steps = sums.steps_of(((0,), (0, 1), (1,)))
    total, share = sums.shares(steps, np.array([[-np.inf, -np.inf, -1.0]]))
    assert total[0] == -np.inf and np.allclose(share, 0.5)
    assert sums.steps_of(((0, 1), (1, 2))).n_parts == 0


def test_structural_sums(spark):
    """Against the list of the search; a path whose partitions are some 4e12 is summed by its pieces."""
    r = random.Random(6)
    graphs = [random_graph(r) for _ in range(30)] + [([0, 1, 0, 0, 1, 0], [(k, k + 1) for k in range(5)] + [(3, 2), (1, 1)]), ([], [])]
    df = spark.createDataFrame([(k, k, 1.0, b, c) for k, (c, b) in enumerate(graphs)], GRAPH)
    parts = mining.partitions(df, MODEL, 2, limit=None, max_iter=None, max_heap=None, structural=True).collect()
    want = {}
    for p in parts:
        want.setdefault(p.graph_id, []).append(p.lweight)
    got = {x.graph_id: x for x in mining.summed_partitions(df, MODEL, 2, structural=True).collect()}
    assert got.keys() == want.keys() and len(want) > 20
    for k, logs in want.items():
        assert got[k].n_parts == len(logs) and np.allclose([got[k].lweight, got[k].best], [np.logaddexp.reduce(logs), max(logs)])
    n, long = 60, spark.createDataFrame([(1, 1, 1.0, [(k, k + 1) for k in range(59)], [0] * 60)], GRAPH)
    (x,) = mining.summed_partitions(long, MODEL, 2, structural=True).collect()
    logs, count = [], 0
    for two in range(n // 2 + 1):  # pairs among n - two pieces
        ways, outer = math.comb(n - two, two), n - 1 - two
        bonding = outer * math.log(2) - math.log(math.pi) / 2 + math.lgamma(outer + 0.5)
        log = -1.0 * (n - 2 * two) - 2.0 * two - math.lgamma(two + 1) - math.lgamma(n - 2 * two + 1) + math.lgamma(n - two + 1) - bonding
        count += ways
        logs.append((log, math.log(ways) + log))
    assert x.n_parts == count > 10**12 and np.allclose([x.lweight, x.best], [np.logaddexp.reduce([b for _, b in logs]), max(a for a, _ in logs)])


def test_groups_of_any_size(monkeypatch):
    rows = [(k, (((0,), (1,)) if k % 2 else ((0,), (0, 1), (1,))), [k] * (2 if k % 2 else 3)) for k in range(50)]
    monkeypatch.setattr(sums, "WAITING", 7)
    monkeypatch.setattr(sums, "NUMBERS", 20)
    monkeypatch.setattr(sums, "KEPT", 1)
    got = [(k, i[0], steps.n_parts) for keys, steps, ids in sums.by_sets(rows) for k, i in zip(keys, ids.tolist(), strict=True)]
    assert sorted(got) == [(k, k, 1 if k % 2 else 2) for k in range(50)]


@pytest.fixture(scope="module")
def long_paths(spark):
    rows = [(k, k, 0.5 + k, [(a, a + 1) for a in range(LONG - 1)], [(a * a // 7 + k) % 2 for a in range(LONG)]) for k in range(3)]
    return spark.createDataFrame(rows, GRAPH), rows


def by_recursion(rows, model, power=None, without=None):
    """ln of the sums over tilings by weight; with `power`, each piece by that factor and none of `without`."""
    out = 0.0
    for _, _, weight, _, colors in rows:
        z = [1.0]
        for v in range(len(colors)):
            step = lambda t: 0.0 if model[t][0] == without else math.exp(model[t][1]) * (power or 1.0)
            z.append(z[v] * step(f";{colors[v]}") + (z[v - 1] * step("0,1;{},{}".format(*sorted(colors[v - 1 : v + 1]))) if v else 0.0))
        out += weight * math.log(z[-1])
    return out


def masses(rows, model):
    """Expected counts by what the sum grows by with a weight."""
    h, out = 1e-6, {}
    for t, (i, w) in model.items():
        out[i] = (by_recursion(rows, model | {t: (i, w + h)}) - by_recursion(rows, model | {t: (i, w - h)})) / (2 * h)
    return out


def test_round_on_more_partitions_than_can_be_listed(long_paths):
    g, rows = long_paths
    new, expected, likelihood = mining.em_round(g, MODEL, 2)
    want = masses(rows, MODEL)
    got = {r["id"]: r["lweight"] for r in new.collect()}
    assert set(got) == set(want) and all(abs(got[i] - math.log(x / sum(want.values()))) < 1e-6 for i, x in want.items())
    assert math.isclose(expected.first()[0], sum(x * w for x, w in zip(want.values(), (w for _, w in MODEL.values()), strict=True)), rel_tol=1e-7)
    assert math.isclose(likelihood.first()[0], by_recursion(rows, MODEL))


def test_sums_of_more_partitions_than_can_be_listed(long_paths):
    g, rows = long_paths
    fib = [1, 1]
    while len(fib) <= LONG:
        fib.append(fib[-1] + fib[-2])
    got = {r["graph_id"]: r for r in mining.summed_partitions(g, MODEL, 2).collect()}
    assert {r["n_parts"] for r in got.values()} == {fib[LONG]} and len(got) == 3
    assert all(math.isclose(got[r[0]]["lweight"], by_recursion([(*r[:2], 1.0, *r[3:])], MODEL)) for r in rows)


def test_sums_are_those_of_a_search_without_limits(spark):
    r, rows = random.Random(4), []
    for k in range(30):
        colors, bonds = random_graph(r)
        rows.append((k, 0, 1.0, bonds, colors))
    g = spark.createDataFrame([*rows, (99, 0, 1.0, [], [7]), (98, 0, 1.0, [], [])], GRAPH)
    listed = {}
    for x in mining.partitions(g, MODEL, 2, limit=None, max_iter=None, max_heap=None).collect():
        listed.setdefault(x["graph_id"], []).append(x["lweight"])
    got = {x["graph_id"]: x for x in mining.summed_partitions(g, MODEL, 2).collect()}
    assert got.keys() == listed.keys()
    for k, some in listed.items():
        assert got[k]["n_parts"] == len(some) and math.isclose(got[k]["lweight"], np.logaddexp.reduce(some)) and math.isclose(got[k]["best"], max(some))


def test_round_is_that_of_listed_partitions(spark):
    r, rows = random.Random(8), []
    for k in range(30):
        colors, bonds = random_graph(r)
        rows.append((k, k, [0.0, 0.5, 2.0][k % 3], bonds, colors))
    g = spark.createDataFrame([*rows, (99, 0, 1.0, [], [7]), (98, 0, 1.0, [], [])], GRAPH)
    parts = mining.partitions(g, MODEL, 2, every=True)
    table = lambda df: sorted((x["id"], round(x["lweight"], 9)) for x in df.collect())
    new, expected, _ = mining.em_round(g, MODEL, 2)
    old = mining.em_step(parts, g.select("graph_id", "weight"))
    assert table(new) == table(old[0]) and math.isclose(expected.first()[0], old[1].first()[0])
    g = g.selectExpr("graph_id", "bonds", "colors", "1L AS n_same")
    new, _, likelihood = mining.em_round(g, MODEL, 2, "n_same")
    old = mining.em_step_unweighted(parts)
    assert table(new) == table(old[0]) and math.isclose(likelihood.first()[0], old[1].first()[0])
    new, expected, likelihood = mining.em_round(g.where("1 = 0"), MODEL, 2, "n_same")
    assert new.count() == 0 and expected.first()[0] is None and likelihood.first()[0] is None


def test_store_holds_no_partitions(long_paths):
    g, rows = long_paths
    store = tuning.partition_store(g, MODEL, 2, tuning.Search(None, None, None))
    assert [(r["complete"], r["parts"]) for r in store.table.collect()] == [(True, None)] * 2
    model = tuning.em_round(store, MODEL)
    want = masses(rows, MODEL)
    assert all(abs(w - math.log(want[i] / sum(want.values()))) < 1e-6 for i, w in model.values())
    losses, likelihood = tuning.fragment_losses(store, model)
    own = tuning.color_costs(model)
    assert math.isclose(likelihood, by_recursion(rows, model) + sum(own.values()))
    for t, (i, w) in model.items():
        if "," in t:
            assert math.isclose(losses[i], by_recursion(rows, model, 1 / (1 - math.exp(w)), i) - own[i])
    few = tuning.partition_store(g.limit(1).selectExpr("graph_id", "weight", "slice(bonds, 1, 5) AS bonds", "slice(colors, 1, 6) AS colors"), MODEL, 2, tuning.Search(None, None, None))
    assert few.partitions(MODEL).count() == 13
