"""The store of partitions and tuning by loss, against searching again each round and sums over all partitions."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from graphloom.operators import mining, tuning
from graphloom.operators.kernels import all_exact_covers, fragments_of

GRAPH = "graph_id long, group long, weight double, bonds array<struct<src:int,trg:int>>, colors array<int>"


def random_graphs(seed, n):
    r, out = random.Random(seed), []
    for g in range(n):
        k = r.randint(1, 6)
        bonds = [(v, r.randrange(v)) for v in range(1, k)] + [(a, b) for a in range(k) for b in range(a) if r.random() < 0.15]
        out.append((g, g % 5, 0.5 + g % 2, bonds, [r.randint(0, 1) for _ in range(k)]))
    return [*out, out[3][:2] + (2.0,) + out[3][3:], (800, 1, 1.0, [], None), (801, 1, 1.0, [], [7])]


def all_partitions(row, model, most):
    """(log-weight, counts) of each partition of a graph, by depth-first search."""
    _, _, _, bonds, colors = row
    found = fragments_of(colors or [], bonds, most)
    places = [(m, *model[t]) for t, sets in found.items() if t in model for m in sets]
    if not colors or {v for m, _, _ in places for v in m} != set(range(len(colors))):
        return []
    return [(sum(places[x][2] for x in c), Counter(places[x][1] for x in c)) for c in all_exact_covers([list(m) for m, _, _ in places])]


def log_sum(xs):
    return math.log(sum(math.exp(x) for x in xs)) if xs else -math.inf


def em_by_hand(rows, model, most, floor=-100.0):
    mass = Counter()
    for row in rows:
        parts = all_partitions(row, model, most)
        whole = log_sum([w for w, _ in parts])
        for w, used in parts:
            for i, n in used.items():
                mass[i] += row[2] * math.exp(w - whole) * n
    total = sum(mass.values())
    raised = {t: (i, max(math.log(mass[i] / total), floor) if mass[i] else floor) for t, (i, _) in model.items()}
    norm = log_sum([w for _, w in raised.values()])
    return {t: (i, w - norm) for t, (i, w) in raised.items()}


def losses_by_hand(rows, model, most):
    losses, likelihood = {}, 0.0
    colors = Counter(c for t in model for c in t.split(";")[1].split(","))
    own = {i: sum(math.log(colors[c] / sum(colors.values())) for c in t.split(";")[1].split(",")) for t, (i, _) in model.items()}
    merged = {}
    for row in rows:
        merged.setdefault(repr(row[3:]), [row, 0.0])[1] += row[2]
    for row, weight in merged.values():
        parts = all_partitions(row, model, most)
        if not parts:
            continue
        likelihood += weight * log_sum([w for w, _ in parts])
        for i, w in model.values():
            rest = log_sum([x - sum(used.values()) * math.log1p(-math.exp(w)) for x, used in parts if i not in used])
            losses[i] = losses.get(i, 0.0) + weight * rest
    return {i: x - own[i] for i, x in losses.items()}, likelihood + sum(own.values())


def close(a, b):
    return a.keys() == b.keys() and all((x == y) or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in ((a[k], b[k]) for k in a))


@pytest.fixture(scope="module")
def rows():
    return random_graphs(4, 60)


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, GRAPH).cache()


@pytest.fixture(scope="module")
def model(table):
    found = mining.most_common(table, 3, 12).orderBy("rank", "fragment").collect()
    found = [r for r in found if r.fragment != ";7"]
    total = sum(r.weight for r in found)
    return {r.fragment: (k, math.log(r.weight / total)) for k, r in enumerate(found)}


def test_store_is_a_search_again(table, model):
    """As fragments go, at limits that some graphs pass and some don't: the partitions of a search of its own."""
    for limit in (1, 3, 64):
        search = tuning.Search(limit)
        store = tuning.partition_store(table, model, 3, search)
        kinds = {r.complete for r in store.table.select("complete").distinct().collect()}
        assert kinds == ({True} if limit == 64 else {True, False})
        for gone in (set(), {"0,1;0,1"}, set(list(model)[4:9])):
            less = tuning.normalized({t: x for t, x in model.items() if t not in gone})
            less = {t: (i, w - 0.1 * i) for t, (i, w) in less.items()}
            again = mining.partitions(store_graphs(store, table), less, 3, limit)
            form = lambda df: {(r.graph_id, round(r.lweight, 9), tuple((f.id, f.n) for f in r.frags)) for r in df.collect()}
            assert form(store.partitions(less)) == form(again)


def store_graphs(store, table):
    return table.join(store.table.select("graph_id"), "graph_id", "left_semi").dropDuplicates(["bonds", "colors"])


def test_rounds(table, rows, model):
    store = tuning.partition_store(table, model, 3)
    want = model
    for _ in range(3):
        model = tuning.em_round(store, model)
        want = em_by_hand(rows, want, 3)
        assert close({t: w for t, (_, w) in model.items()}, {t: w for t, (_, w) in want.items()})
        got, likelihood = tuning.fragment_losses(store, model)
        losses, total = losses_by_hand(rows, want, 3)
        assert close(got, losses) and math.isclose(likelihood, total, rel_tol=1e-9)


def tuned_by_hand(rows, model, most, rounds, share, size):
    def train(m):
        for _ in range(rounds):
            m = em_by_hand(rows, m, most)
        return m

    model = train(model)
    before, last = model, -math.inf
    if share == 0:
        return model
    while size is None or len(model) > size:
        losses, likelihood = losses_by_hand(rows, model, most)
        if size is None and likelihood < last:
            return before
        several = sorted((t for t in model if "," in t.split(";")[1]), key=lambda t: (-losses[model[t][0]], model[t][1], -model[t][0]))
        n = max(int(len(model) * share), 1)
        gone = set(several[: n if size is None else min(n, len(model) - size)])
        if not gone:
            return model
        left = {t: x for t, x in model.items() if t not in gone}
        norm = log_sum([w for _, w in left.values()])
        before, last, model = model, likelihood, train({t: (i, w - norm) for t, (i, w) in left.items()})
    return model


@pytest.mark.parametrize("share, size", [(0.2, None), (0.3, 5), (0.0, None), (0.5, 1)])
def test_tuned(table, rows, model, share, size):
    store = tuning.partition_store(table, model, 3)
    got, want = tuning.tune(store, model, 2, share, size=size), tuned_by_hand(rows, model, 3, 2, share, size)
    assert close({t: w for t, (_, w) in got.items()}, {t: w for t, (_, w) in want.items()})
    assert {t: i for t, (i, _) in got.items()} == {t: model[t][0] for t in got}


def test_losses_without_a_matrix():
    """Against one number for each partition and fragment."""
    r = np.random.default_rng(5)
    for _ in range(60):
        n = int(r.integers(1, 7))
        weights = np.log(r.dirichlet(np.ones(n)))
        parts = []
        for _ in range(int(r.integers(1, 6))):
            used = r.choice(n, int(r.integers(1, n + 1)), replace=False)
            frags = [{"id": int(i), "n": int(r.integers(1, 4))} for i in used]
            parts.append((sum(weights[f["id"]] * f["n"] for f in frags), frags))
        free = tuning.freed(weights)
        want = []
        for i in range(n):
            rest = [w - sum(f["n"] for f in frags) * free[i] for w, frags in parts if i not in {f["id"] for f in frags}]
            want.append(np.logaddexp.reduce(rest) if rest else -math.inf)
        assert np.allclose(tuning.losses_of(parts, free), want)


def test_fitted_and_empty(spark, table):
    model = mining.fit_fragments(table, 2, 8, rounds=2, prune=0.3)
    assert math.isclose(sum(math.exp(w) for _, w in model.values()), 1.0, rel_tol=1e-9)
    assert sorted(i for i, _ in model.values()) == list(range(len(model)))
    assert mining.fit_fragments(table.where("1 = 0"), 2) == {}
    with pytest.raises(ValueError):
        tuning.partition_store(table, {";0": (1, 0.0)}, 1)
