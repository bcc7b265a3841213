"""Growth of fragments by joins and the tree that names them, against enumeration of all connected sets."""

import itertools
import math
import random
import time
from collections import Counter, defaultdict

import pytest

from graphloom.operators import growth
from graphloom.operators.bonded import bonded_search, canonical_bonded, parse_bonded
from graphloom.operators.kernels import canonical, canonical_search, connected_sets, most_disjoint, neighbors

GRAPH = "graph_id long, group long, weight double, bonds array<struct<src:int,trg:int,color:int>>, colors array<int>"


def random_graphs(seed: int, n: int) -> list[tuple]:
    r, out = random.Random(seed), []
    for g in range(n):
        k = r.randint(1, 7)
        bonds = [(a, b, r.randint(0, 1)) for a in range(k) for b in range(a + 1, k) if r.random() < 0.45]
        bonds = [(b, a, c) if r.random() < 0.5 else (a, b, c) for a, b, c in bonds]
        out.append((g, g % 7, 0.5 + g % 3, bonds, [r.randint(0, 1) for _ in range(k)]))
    ring = [(k, (k + 1) % 6, 0) for k in range(6)]
    return [*out, (900, 1, 1.0, ring, [0] * 6), (901, 2, 1.0, None, [1]), (902, 3, 1.0, [], []), (903, 3, 1.0, None, None)]


def occurrences(colors, bonds, most):
    """Connected vertex sets by the canonical text of what they induce."""
    out = defaultdict(list)
    for m in connected_sets(len(colors), neighbors(len(colors), [(a, b) for a, b, _ in bonds]), most):
        at = {v: k for k, v in enumerate(m)}
        out[canonical_bonded([colors[v] for v in m], [(at[a], at[b], c) for a, b, c in bonds if a in at and b in at])[0]].append(m)
    return out


def by_hand(graphs, most):
    keys, at = defaultdict(lambda: [0, set(), 0, 0, 0]), {}
    for g, group, w, bonds, colors in graphs:
        for text, sets in occurrences(colors or [], bonds or [], most).items():
            d, k = most_disjoint(sets, exact=False), keys[text]
            k[0], k[2], k[3], k[4] = k[0] + d * w, k[2] + 1, k[3] + d, k[4] + len(sets)
            k[1].add(group)
            at[g, text] = sorted(sets)
    return {t: (round(w, 9), len(gs), n, d, e) for t, (w, gs, n, d, e) in keys.items()}, at


@pytest.fixture(scope="module")
def graphs():
    return random_graphs(3, 60)


@pytest.fixture(scope="module")
def table(spark, graphs):
    return spark.createDataFrame(graphs, GRAPH).cache()


def test_growth_finds_all(table, graphs):
    want, _ = by_hand(graphs, 4)
    found, steps = growth.mine(table, 4)
    got = {r.fragment: (r.weight, r.n_groups, r.n_graphs, r.n_disjoint, r.n) for r in found.collect()}
    assert got == want
    for r in steps.collect():
        colors, bonds = parse_bonded(r.parent)
        color, links = growth._parse_op(r.op)
        grown, n = [*colors, color], len(colors)
        assert canonical_bonded(grown, [*bonds, *((i, n, b) for i, b in links)])[0] == r.fragment
        small, pairs = parse_bonded(r.fragment)
        assert [grown[p] for p in r.places] == small
        whole = {(min(a, b), max(a, b)): c for a, b, c in [*bonds, *((i, n, b) for i, b in links)]}
        assert {tuple(sorted((r.places[a], r.places[b]))): c for a, b, c in pairs} == whole


def test_growth_in_enough_groups(table, graphs):
    """Larger fragments need the groups, and something to grow from that has them."""
    want, _ = by_hand(graphs, 3)
    got = {r.fragment for r in growth.mine(table, 3, min_groups=5)[0].collect()}
    assert got == {t for t, k in want.items() if k[1] >= 5 or t.startswith(";")}


@pytest.mark.parametrize("limit", [1, 2, 3, 6, 9, 1000])
def test_growth_to_a_limit(table, graphs, limit):
    want, _ = by_hand(graphs, 3)
    single = [t for t in want if t.startswith(";")]
    others = sorted((k[:4] for t, k in want.items() if t not in single), reverse=True)
    left = max(limit - len(single), 1)
    last = others[min(left, len(others)) - 1]
    rows = growth.mine(table, 3, limit=limit)[0].collect()
    kept = set(single) if len(single) >= limit else {t for t, k in want.items() if t in single or k[:4] >= last}
    assert {r.fragment for r in rows} == kept
    ranks = {r.fragment: r.rank for r in rows}
    for t in kept:
        assert ranks[t] == 1 + sum((u not in single, [-x for x in want[u][:4]]) < (t not in single, [-x for x in want[t][:4]]) for u in want)


@pytest.mark.parametrize("all_steps", [True, False])
def test_located_by_tree(table, graphs, all_steps):
    _, want = by_hand(graphs, 4)
    found, steps = growth.mine(table, 4)
    pins = found.select("fragment")
    got = {}
    for r in growth.locate(table, steps if all_steps else growth.tree_of(pins), pins).collect():
        got[r.graph_id, r.fragment] = sorted(tuple(sorted(m)) for m in r.maps)
        colors, bonds = parse_bonded(r.fragment)
        _, _, _, own, labels = next(g for g in graphs if g[0] == r.graph_id)
        pairs = {(min(a, b), max(a, b)): c for a, b, c in own or ()}
        assert all([labels[v] for v in m] == colors and all(pairs[tuple(sorted((m[a], m[b])))] == c for a, b, c in bonds) for m in r.maps)
    assert got == want


def test_few_pins_in_other_graphs(spark, graphs):
    """A tree made from some fragments finds exactly these in graphs that it was not made from."""
    other = random_graphs(8, 40)
    table = spark.createDataFrame(other, GRAPH)
    _, known = by_hand(graphs, 5)
    pins = random.Random(1).sample(sorted({t for _, t in known}), 30)
    _, want = by_hand(other, 5)
    frame = spark.createDataFrame([(p,) for p in pins], "fragment string")
    got = {(r.graph_id, r.fragment): sorted(tuple(sorted(m)) for m in r.maps) for r in growth.locate(table, growth.tree_of(frame), frame).collect()}
    assert got == {k: v for k, v in want.items() if k[1] in pins}


@pytest.mark.parametrize("most", [2, 3])
def test_closed(spark, graphs, most):
    """Without those of which every occurrence grows into one and the same fragment."""
    graphs = [*graphs, (910, 1, 1.0, [(0, 1, 0), (1, 2, 0), (2, 3, 1)], [5, 5, 6, 6]), (911, 1, 1.0, [(0, 1, 1)], [6, 6])]
    table = spark.createDataFrame(graphs, GRAPH)
    want, at = by_hand(graphs, most + 1)
    within = defaultdict(list)
    for (g, text), sets in at.items():
        for m in sets:
            larger = {t for (h, t), more in at.items() if h == g for x in more if len(x) == len(m) + 1 and set(m) < set(x)}
            within[text].append(larger)
    idle = {t for t, found in within.items() if set.intersection(*found)}
    rows = growth.mine(table, most, closed=True)[0].collect()
    small = {t for t in want if t.count(",", t.index(";")) < most}
    assert {r.fragment for r in rows} == {t for t in small if t.startswith(";") or t not in idle}
    assert idle & small and all(want[r.fragment][4] == r.n for r in rows)


@pytest.mark.parametrize("few", [growth.MAX_LIKELY, 0])
def test_closed_pairs(spark, few, monkeypatch):
    """As `mine` finds them, also where vertices have several bonds, loops, or fewer colours than bonds say."""
    monkeypatch.setattr(growth, "MAX_LIKELY", few)
    r, graphs = random.Random(9), random_graphs(5, 12)
    for g in range(200, 260):
        k = r.randint(2, 5)
        bonds = [(*r.sample(range(k), 2), r.randint(0, 2)) for _ in range(r.randint(1, 5))] + [(0, 0, 1)] * (g % 3 == 0)
        graphs.append((g, g % 5, 1.0, bonds, [r.randint(g % 4 * 10, g % 4 * 10 + 3) for _ in range(k)]))
    graphs += [(910, 1, 1.0, [(0, 1, 0), (1, 2, 0), (2, 3, 1)], [5, 5, 6, 6]), (911, 1, 1.0, [(0, 1, 1)], [6, 6]), (912, 1, 1.0, [(0, 1, 1), (1, 2, 1)], [70, 71, 70]), (913, 1, 1.0, [(0, 1, 1), (0, 2, 1)], [71, 70, 70])]
    table = spark.createDataFrame(graphs, GRAPH)
    want = {(x.fragment, x["size"], x.n) for x in growth.mine(table, 2, closed=True)[0].collect()}
    got = [tuple(x) for x in growth.closed_pairs(table).collect()]
    assert set(got) == want and len(got) == len(want)
    everything = growth.mine(table, 2)[0]
    assert everything.count() > len(got) > everything.where("size = 1").count()
    beyond = spark.createDataFrame([(1, 1, 1.0, [(0, 1, 1), (1, 2, 1), (None, 0, 1)], [7, 8]), (2, 1, 1.0, None, None)], GRAPH)
    assert sorted(map(tuple, growth.closed_pairs(beyond).collect())) == [("0,1,1;7,8", 2, 1), (";7", 1, 1), (";8", 1, 1)]


def ln_bell(n):
    return n * (math.log(0.792 * n) - math.log(math.log(n + 1))) if n else 0.0


@pytest.mark.parametrize("n_fragments, ratio", [(4, True), (9, True), (9, False), (1000, True)])
def test_bell_seeds(table, graphs, n_fragments, ratio):
    _, at = by_hand(graphs, 3)
    size = lambda t: t.count(",", t.index(";")) + 1
    colors = {g[0]: len(g[4] or ()) for g in graphs}
    singles = {t for _, t in at if size(t) == 1}
    ways = {(g, t): len(sets) for (g, t), sets in at.items() if size(t) == 1}
    kept, larger = set(singles), Counter()
    for k in (2, 3):
        level = Counter()
        for (g, t), sets in at.items():
            if size(t) == k:
                parents = [p for (h, p), small in at.items() if h == g and p in kept and size(p) == k - 1 for x in small for m in sets if set(x) < set(m)]
                if parents:
                    ways[g, t] = len(parents)
                    level[t] += 1
        larger = Counter({t: n for t, n in (larger + level).items() if n >= 2 or t in kept})
        room = n_fragments - len(singles)
        larger = Counter({t: n for t, n in larger.items() if sum(m > n for m in larger.values()) < room})
        kept = singles | set(larger)
    mass = Counter()
    for (g, t), n in ways.items():
        if t in kept:
            whole, k = colors[g], size(t)
            mass[t] += n * math.exp(ln_bell(k) + ln_bell(whole - k) - ln_bell(whole)) if ratio and k < whole else n
    total = sum(mass.values())
    got = {r.fragment: r.lweight for r in growth.bell_seeds(table, 3, n_fragments, 2, ratio).collect()}
    assert got.keys() == mass.keys() and all(math.isclose(got[t], math.log(m / total), rel_tol=1e-9) for t, m in mass.items())
    with pytest.raises(ValueError):
        growth.bell_seeds(table, 2, 1)


def test_nothing_grows(spark, table):
    none = table.where("1 = 0")
    found, steps = growth.mine(none, 3)
    assert found.collect() == [] and steps.collect() == []
    assert growth.locate(none, steps, found).collect() == [] and growth.locate(table, steps, found).collect() == []


def moved(colors, bonds, r):
    to = r.sample(range(len(colors)), len(colors))
    out = [0] * len(colors)
    for v, c in enumerate(colors):
        out[to[v]] = c
    pairs = [(to[a], to[b]) if r.random() < 0.5 else (to[b], to[a]) for a, b in bonds]
    r.shuffle(pairs)
    return tuple(out), tuple(pairs)


LIKE = {
    "forty vertices in pairs": (40, [(2 * k, 2 * k + 1) for k in range(20)], 2**20 * math.factorial(20)),
    "cube of five dimensions": (32, [(v, v | 1 << k) for v in range(32) for k in range(5) if not v >> k & 1], 3840),
    "ten triangles": (30, [(3 * k + a, 3 * k + b) for k in range(10) for a, b in ((0, 1), (1, 2), (0, 2))], 6**10 * math.factorial(10)),
    "two classes of five": (10, [(a, 5 + b) for a in range(5) for b in range(5)], 2 * 120**2),
    "five-rings with spokes": (10, [(k, (k + 1) % 5) for k in range(5)] + [(k, k + 5) for k in range(5)] + [(5 + k, 5 + (k + 2) % 5) for k in range(5)], 120),
    "grid": (36, [(6 * a + b, 6 * a + b + 1) for a in range(6) for b in range(5)] + [(6 * a + b, 6 * a + b + 6) for a in range(5) for b in range(6)], 8),
}


@pytest.mark.parametrize("name", LIKE)
def test_like_vertices(name):
    n, bonds, automorphisms = LIKE[name]
    r, colors = random.Random(name), (0,) * n
    began = time.process_time()
    form = canonical(colors, tuple(bonds))
    assert time.process_time() - began < 1
    assert form[1] == automorphisms
    assert all(canonical(*moved(colors, bonds, r)) == form for _ in range(4))


def test_moves_are_automorphisms_and_make_all():
    r = random.Random(2)
    for _ in range(150):
        n = r.randint(1, 6)
        colors = [r.randint(0, 1) * (k % 2) for k in range(n)]
        bonds = [(a, b) for a in range(n) for b in range(a) if r.random() < 0.5]
        pairs = {frozenset(b) for b in bonds}
        whole = {p for p in itertools.permutations(range(n)) if all(colors[p[v]] == colors[v] for v in range(n)) and {frozenset((p[a], p[b])) for a, b in bonds} == pairs}
        moves = canonical_search(tuple(colors), tuple(bonds))[2]
        made, open_ = {tuple(range(n))}, [tuple(range(n))]
        while open_:
            p = open_.pop()
            for g in moves:
                q = tuple(g[x] for x in p)
                if q not in made:
                    made.add(q)
                    open_.append(q)
        assert made == whole
        order, count, moves = bonded_search(colors, [(a, b, 3) for a, b in bonds])
        assert sorted(order) == list(range(n)) and count == len(whole) and set(moves) <= whole
