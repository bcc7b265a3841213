import itertools
import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.operators.bonded import canonical_bonded, canonical_typed
from graphloom.operators.kernels import (
    all_exact_covers, bonding_cost, canonical, composition_cost, connected_sets, least_by_size, most_disjoint, neighbors, overlap_clusters, ring_blocks, top_exact_covers, top_n_exact_covers,
    top_p_exact_covers, top_structural_covers,
)

# Covers whose order, and whose number by share, must come out as below.
SMALL = [[1], [2], [3], [4], [5], [6], [7], [1, 2], [1, 2, 3], [3, 4]]


def test_exact_covers():
    r = random.Random(3)
    for _ in range(50):
        covers = [r.sample(range(6), r.randint(1, 3)) for _ in range(8)]
        items = {x for c in covers for x in c}
        want = {s for n in range(1, 9) for s in itertools.combinations(range(8), n) if sum(len(covers[k]) for k in s) == len(items) and {x for k in s for x in covers[k]} == items}
        assert {tuple(sorted(x)) for x in all_exact_covers(covers)} == want
        assert {tuple(sorted(x)) for x in top_exact_covers(covers, [1.0] * 8)} == want
    found = [sorted(x) for x in top_exact_covers(SMALL, [1] * 10)]
    assert found == [[4, 5, 6, 7, 9], [3, 4, 5, 6, 8], [0, 1, 4, 5, 6, 9], [2, 3, 4, 5, 6, 7], [0, 1, 2, 3, 4, 5, 6]]
    assert [sorted(x) for x in top_n_exact_covers(SMALL, [1] * 10, 3)] == found[:3]
    assert top_n_exact_covers(SMALL, [1] * 10, 0) == []
    assert list(top_exact_covers(SMALL, [1] * 10, max_iter=1)) == []
    assert list(top_exact_covers(SMALL, [1] * 10, max_heap=0)) == []


def test_covers_by_share():
    subsets = [list(s) for k in range(1, 8) for s in itertools.combinations(range(1, 8), k)]
    weights = [10 if set(s) <= {1, 2, 3} else 1 for s in subsets]
    assert len(top_p_exact_covers(subsets, weights, 0.5)) == 220
    assert top_p_exact_covers(subsets, weights, 1.5) == []


def test_most_disjoint():
    # Counts that must come out so, also where they are not the most.
    for covers, n in (([], 0), ([[1]], 1), ([[0, 1], [1, 2], [2, 3], [3, 4], [3, 5], [3, 6]], 2), ([[2, 3, 4, 5], [2, 3, 4, 6], [2, 3, 5, 6], [3, 4, 5, 6]], 1)):
        assert most_disjoint(covers) == most_disjoint(covers, exact=False) == n
    odd = [[1, 2, 3, 5], [1, 4], [2, 6], [3, 7]]
    assert most_disjoint(odd) == 3 and most_disjoint(odd, exact=False) == 1


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32))
def test_canonical_form_does_not_depend_on_names(seed):
    r = random.Random(seed)
    n = r.randint(0, 8)
    colors = [r.randint(0, 2) for _ in range(n)]
    bonds = [(i, j) for i in range(n) for j in range(i) if r.random() < 0.4]
    to = r.sample(range(n), n)
    moved = [0] * n
    for i in range(n):
        moved[to[i]] = colors[i]
    assert canonical(tuple(colors), tuple(bonds)) == canonical(tuple(moved), tuple((to[i], to[j]) for i, j in bonds))


def test_like_vertices_are_not_tried_in_turn():
    many = tuple((i, j) for i in range(12) for j in range(i))
    assert canonical((1,) * 12, many) == canonical((1,) * 12, many[::-1]) and canonical((1,) * 12, many)[1] == 479001600
    assert canonical((2,) * 11, ())[1] == 39916800
    star = tuple((0, k) for k in range(1, 10))
    assert canonical((0,) * 10, star)[1] == 362880


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32))
def test_automorphisms_by_all_permutations(seed):
    r = random.Random(seed)
    n = r.randint(1, 6)
    colors = [r.randint(0, 1) for _ in range(n)]
    bonds = [(i, j) for i in range(n) for j in range(i) if r.random() < 0.5]
    pairs = {frozenset(b) for b in bonds}
    same = sum(all(colors[p[v]] == colors[v] for v in range(n)) and {frozenset((p[a], p[b])) for a, b in bonds} == pairs for p in itertools.permutations(range(n)))
    assert canonical(tuple(colors), tuple(bonds))[1] == same
    assert canonical_typed(["xyz"[c] for c in colors], bonds) == canonical_typed(["xyz"[c] for c in colors], [(b, a) for a, b in bonds])


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32))
def test_bond_colored_form_does_not_depend_on_names(seed):
    r = random.Random(seed)
    n = r.randint(0, 6)
    colors = [r.randint(0, 2) for _ in range(n)]
    bonds = [(i, j, r.randint(0, 2)) for i in range(n) for j in range(i) if r.random() < 0.4]
    to = r.sample(range(n), n)
    moved = [0] * n
    for i in range(n):
        moved[to[i]] = colors[i]
    form = canonical_bonded(colors, bonds)
    assert form == canonical_bonded(moved, [(to[j], to[i], c) for i, j, c in bonds])
    if bonds:
        i, j, c = bonds[0]
        assert canonical_bonded(colors, [(i, j, c + 5), *bonds[1:]])[0] != form[0]


def test_overlap_clusters():
    assert [overlap_clusters(x) for x in ([], [[1]], [[1, 2], [3, 4], [2, 3]], [[1, 2], [3, 4], [4, 5]])] == [0, 1, 1, 2]


def test_automorphisms_and_connected_sets():
    ring = tuple((i, (i + 1) % 6) for i in range(6))
    assert canonical((0,) * 6, ring)[1] == 12
    sets = list(connected_sets(6, neighbors(6, ring), 3))
    assert len(sets) == len(set(sets)) == 18


def test_structural_covers():
    """The same covers as without structure; what a finished cover costs; and first the cheapest where the estimate is exact."""
    r = random.Random(6)
    for _ in range(60):
        n = r.randint(1, 6)
        covers = [[v] for v in range(n)] + [sorted(r.sample(range(n), r.randint(1, n))) for _ in range(5)]
        weights = [r.random() * 3 for _ in covers]
        bonds = [(a, b) for a in range(n) for b in range(a + 1, n) if r.random() < 0.5]
        inner = [sum(a in c and b in c for a, b in bonds) for c in covers]
        labels = [r.randint(0, 3) for _ in covers]
        search = top_structural_covers(covers, weights, inner, len(bonds), labels, n)
        found = [tuple(sorted(x)) for x in search]
        assert sorted(found) == sorted(tuple(sorted(x)) for x in all_exact_covers(covers)) and len(set(found)) == len(found)
        for x in found:
            apart = len(bonds) - sum(inner[k] for k in x)
            pairings = math.prod(range(2 * apart - 1, 0, -2)) if apart > 1 else 1
            counts = [sum(labels[k] == label for k in x) for label in range(4)]
            want = math.log(math.prod(map(math.factorial, counts)) / math.factorial(len(x))) + math.log(pairings)
            assert math.isclose(composition_cost((labels[k] for k in x), 0) + bonding_cost(sum(inner[k] for k in x), len(bonds)), want, abs_tol=1e-9)
    some = top_structural_covers([[0], [1], [0, 1]], [1.0, 1.0, 1.0], [0, 0, 1], 1, [0, 1, 2], 2, max_iter=1)
    assert list(some) == []
    # two pieces of unlike kinds can be composed in two ways: ln 2 less
    ordered = list(top_structural_covers([[0], [1], [0, 1]], [1.0, 1.0, 1.5], [0, 0, 1], 1, [0, 1, 2], 2))
    assert [sorted(x) for x in ordered] == [[0, 1], [2]]


def test_least_by_size():
    r = random.Random(7)
    for _ in range(40):
        rows = [(r.randint(0, 5), r.choice((1.0, 2.5, -1.0 + r.random() * 4))) for _ in range(r.randint(0, 5))]
        got = least_by_size([s for s, _ in rows], [w for _, w in rows], 7)
        kinds = [(s, w) for s, w in rows if s]
        for n in range(8):
            best = min((sum(w for _, w in c) for k in range(n + 1) for c in itertools.combinations_with_replacement(kinds, k) if sum(s for s, _ in c) == n), default=math.inf)
            assert got[n] == best or math.isclose(got[n], best)


def pieces(n, bonds):
    """Component of each vertex, by its smallest member."""
    at = list(range(n))
    for _ in range(n):
        for a, b in bonds:
            at[a] = at[b] = min(at[a], at[b])
    return at


def test_ring_blocks():
    """A bridge is a bond whose ends part without it; two bonds share a block if no single vertex parts them."""
    r = random.Random(8)
    for _ in range(150):
        n = r.randint(1, 8)
        bonds = sorted({(a, b) for a in range(n) for b in range(a + 1, n) if r.random() < r.choice((0.2, 0.4))})
        block, least = ring_blocks(n, [(b, a) if r.random() < 0.5 else (a, b) for a, b in [*bonds, *bonds[:2], (0, 0)]])
        assert sorted(block) == bonds
        bridges = {b for b in bonds if (p := pieces(n, [x for x in bonds if x != b]))[b[0]] != p[b[1]]}
        assert {b for b in bonds if list(block.values()).count(block[b]) == 1} == bridges
        assert least == pieces(n, [b for b in bonds if b not in bridges])
        for x, y in itertools.combinations(bonds, 2):
            # on one ring: no vertex (but a shared end) whose loss parts what is left of the two
            together = x not in bridges and y not in bridges
            for v in range(n):
                p = pieces(n, [b for b in bonds if v not in b])
                ends = [[w for w in z if w != v] for z in (x, y)]
                together &= p[ends[0][0]] == p[ends[1][0]]
            assert (block[x] == block[y]) == together
