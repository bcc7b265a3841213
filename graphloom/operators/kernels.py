"""Small searches on one graph at a time, called from within tasks."""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Generator, Iterable, Iterator
from functools import wraps
from itertools import count
from math import exp, inf, lgamma, log, log1p, pi

Bonds = tuple[tuple[int, int], ...]


def remembered(f, most: int = 4_000_000):
    """`f` with its latest results kept; unlike the standard cache it can be sent to executors with its code.

    `most` bounds the entries of all arguments that are kept together, not their number, so large graphs can't fill a
    worker's memory.
    """
    kept: dict = {}
    held = [0]

    @wraps(f)
    def g(*args):
        if args not in kept:
            held[0] += 8 + sum(len(a) for a in args)
            if held[0] > most:
                kept.clear()
                held[0] = 0
            kept[args] = f(*args)
        return kept[args]

    return g


def neighbors(n: int, bonds: Iterable[tuple[int, int]]) -> list[int]:
    """Bit masks of each vertex's neighbours."""
    out = [0] * n
    for a, b in bonds:
        out[a] |= 1 << b
        out[b] |= 1 << a
    return out


def _refined(colors: list[int], near: list[list[int]]) -> list[int]:
    """Colours split by the multisets of neighbours' colours until nothing changes; numbered in an order free of names."""
    classes = len(set(colors))
    while True:
        seen = [(c, tuple(sorted([colors[w] for w in near[v]]))) for v, c in enumerate(colors)]
        rank = {s: k for k, s in enumerate(sorted(set(seen)))}
        colors = [rank[s] for s in seen]
        if len(rank) == classes:
            return colors
        classes = len(rank)


def _twin_swaps(colors: tuple[int, ...], near: list[int]) -> list[tuple[int, ...]]:
    """Exchanges of two vertices of a colour with the same neighbours, but for each other: automorphisms at sight."""
    swaps, last = [], {}
    for v, m in enumerate(near):
        for kind in ((colors[v], True, m), (colors[v], False, m | 1 << v)):
            if kind in last:
                u = last[kind]
                swaps.append(tuple(v if x == u else u if x == v else x for x in range(len(near))))
            last[kind] = v
    return swaps


def orbits(n: int, moves: Iterable[tuple[int, ...]]) -> list[int]:
    """For each vertex the smallest that the moves, which are permutations, can bring it to."""
    least = list(range(n))

    def find(v: int) -> int:
        while least[v] != v:
            least[v] = least[least[v]]
            v = least[v]
        return v

    for g in moves:
        for v, w in enumerate(g):
            a, b = find(v), find(w)
            if a != b:
                least[max(a, b)] = min(a, b)
    return [find(v) for v in range(n)]


class _Labelling:
    """The search of `canonical_search`.

    A way singles out vertices one by one, each time refining what that tells apart, down to a leaf, where all are apart.
    The traces of a way (sizes of its classes) and its leaf's graph don't depend on names; the least wins. A leaf with
    the graph of the first or the best one shows an automorphism. Of vertices that the known automorphisms without effect
    on the way so far bring to one another, one is tried; and a leaf that shows an automorphism ends all up to where its
    way parted from the other's, since the rest there is alike.
    """

    def __init__(self, colors: tuple[int, ...], bonds: Bonds):
        self.colors, self.bonds, self.n = colors, {(min(b), max(b)) for b in bonds}, len(colors)
        masks = neighbors(self.n, bonds)
        self.near = [[w for w in range(self.n) if m >> w & 1] for m in masks]
        self.moves = _twin_swaps(colors, masks)
        self.first = self.best = None
        self.automorphisms = 1

    def alike(self, fixed: tuple[int, ...]) -> list[int]:
        return orbits(self.n, (g for g in self.moves if all(g[v] == v for v in fixed)))

    def leaf(self, split: list[int], fixed: tuple[int, ...], trace: tuple, like_first: bool) -> int:
        order = sorted(range(self.n), key=split.__getitem__)
        edges = sorted((max(split[a], split[b]), min(split[a], split[b])) for a, b in self.bonds)
        key = (trace, tuple(self.colors[v] for v in order), tuple(edges))
        if self.first is None:
            self.first = self.best = (key, order, fixed)
            return len(fixed)
        for known, order_then, fixed_then in ((self.first, self.best) if like_first else (self.best,)):
            if key == known:
                move = [0] * self.n
                for v, w in zip(order_then, order, strict=True):
                    move[v] = w
                self.moves.append(tuple(move))
                return next(k for k, (v, w) in enumerate(zip(fixed, fixed_then, strict=True)) if v != w)
        if key < self.best[0]:
            self.best = (key, order, fixed)
        return len(fixed)

    def visit(self, split: list[int], fixed: tuple[int, ...], trace: tuple) -> int:
        """How many of the vertices in `fixed` are still of use to look on from."""
        split = _refined(split, self.near)
        sizes, depth = Counter(split), len(fixed)
        trace = (*trace, tuple(sorted(sizes.items())))
        on_first = self.first is None
        like_first = on_first or trace == self.first[0][0][: depth + 1]
        if not like_first and trace > self.best[0][0][: depth + 1]:
            return depth
        if len(sizes) == self.n:
            return self.leaf(split, fixed, trace, like_first)
        cell = min((size, c) for c, size in sizes.items() if size > 1)[1]
        tried: list[int] = []
        for v in (v for v in range(self.n) if split[v] == cell):
            if tried:
                alike = self.alike(fixed)
                if any(alike[v] == alike[u] for u in tried):
                    continue
            back = self.visit([2 * c + (w != v and c == cell) for w, c in enumerate(split)], (*fixed, v), trace)
            tried.append(v)
            if back < depth:
                return back
        if on_first:
            alike = self.alike(fixed)
            self.automorphisms *= sum(a == alike[tried[0]] for a in alike)
        return depth


@remembered
def canonical_search(colors: tuple[int, ...], bonds: Bonds) -> tuple[tuple[int, ...], int, tuple[tuple[int, ...], ...]]:
    """Vertices in an order in which isomorphic graphs are equal, the number of automorphisms, and some that make all."""
    search = _Labelling(colors, bonds)
    if not colors:
        return (), 1, ()
    search.visit(list(colors), (), ())
    return tuple(search.best[1]), search.automorphisms, tuple(search.moves)


def canonical_order(colors: tuple[int, ...], bonds: Bonds) -> tuple[tuple[int, ...], int]:
    """The order and number of `canonical_search`."""
    return canonical_search(colors, bonds)[:2]


def canonical(colors: tuple[int, ...], bonds: Bonds) -> tuple[str, int]:
    """Text `bonds;colors` that isomorphic graphs share, and the number of automorphisms.

    A vertex or a bonded pair is said at sight and not kept, as with many colours there are very many.
    """
    if len(colors) == 1 and not bonds:
        return f";{colors[0]}", 1
    if len(colors) == 2 and len(bonds) == 1 and bonds[0] in ((0, 1), (1, 0)):
        return f"0,1;{min(colors)},{max(colors)}", 1 + (colors[0] == colors[1])
    return _canonical(colors, bonds)


@remembered
def _canonical(colors: tuple[int, ...], bonds: Bonds) -> tuple[str, int]:
    order, automorphisms = canonical_order(colors, bonds)
    at = {v: k for k, v in enumerate(order)}
    edges = sorted((max(at[a], at[b]), min(at[a], at[b])) for a, b in set(bonds))
    return ",".join(f"{a},{b}" for b, a in edges) + ";" + ",".join(str(colors[v]) for v in order), automorphisms


def induced(members: Iterable[int], colors: list[int], near: list[int]) -> tuple[tuple[int, ...], Bonds]:
    m = sorted(members)
    at = {v: k for k, v in enumerate(m)}
    return tuple(colors[v] for v in m), tuple((at[a], at[b]) for a in m for b in m if a < b and near[a] >> b & 1)


def connected_sets(n: int, near: list[int], most: int, keep=None) -> Iterator[tuple[int, ...]]:
    """Each connected set of up to `most` vertices once, by size; only sets for which `keep` holds grow further."""
    level = {1 << v for v in range(n)}
    for size in range(1, most + 1):
        grown = set()
        for mask in sorted(level):
            members = tuple(v for v in range(n) if mask >> v & 1)
            yield members
            if size < most and (keep is None or keep(members)):
                around = 0
                for v in members:
                    around |= near[v]
                around &= ~mask
                grown.update(mask | 1 << w for w in range(n) if around >> w & 1)
        level = grown


def fragments_of(colors: list[int], bonds: Iterable[tuple[int, int]], most: int, keep=None) -> dict[str, list[tuple[int, ...]]]:
    """Connected vertex sets of a graph by the canonical text of what they induce; `keep` judges a text."""
    near, out, text = neighbors(len(colors), bonds), defaultdict(list), {}

    def name(m: tuple[int, ...]) -> str:
        if m not in text:
            text[m] = canonical(*induced(m, colors, near))[0]
        return text[m]

    for m in connected_sets(len(colors), near, most, None if keep is None else lambda m: keep(name(m))):
        out[name(m)].append(m)
    return out


def most_disjoint(covers: Iterable[Iterable[int]], exact: bool = True) -> int:
    """How many of the covers can be disjoint at once.

    Not exact: depth by depth, always taking one of the covers of the rarest item, until one leaves no other; this
    can be less than the most, and is what rankings of mined fragments go by.
    """
    masks = list(dict.fromkeys(sum(1 << x for x in set(c)) for c in map(list, covers) if c))
    if exact:
        best = 0

        def take(rest: list[int], n: int) -> None:
            nonlocal best
            best = max(best, n)
            if not rest or n + len(rest) <= best:
                return
            head = rest[0]
            clash = [m for m in rest if m & head]
            for m in clash:  # some cover that meets the head is in a best choice
                take([x for x in rest if not x & m], n + 1)

        take(sorted(masks, key=lambda m: m.bit_count()), 0)
        return best
    if not masks:
        return 0
    states, n = {tuple(masks)}, 0
    while True:
        n += 1
        following = set()
        for rest in states:
            items = Counter(b for m in rest for b in range(m.bit_length()) if m >> b & 1)
            rarest = min(items, key=items.__getitem__)  # of equal ones, the first met
            for m in rest:
                if m >> rarest & 1:
                    left = tuple(x for x in rest if not x & m)
                    if not left:
                        return n
                    following.add(left)
        states = following


def overlap_clusters(sets: Iterable[Iterable[int]]) -> int:
    """How many clusters the sets make, of those that share items, directly or through others."""
    clusters: list[int] = []
    for mask in (sum(1 << x for x in set(s)) for s in sets):
        apart = []
        for c in clusters:
            if c & mask:
                mask |= c
            else:
                apart.append(c)
        clusters = [*apart, mask]
    return len(clusters)


class _Covers:
    """Rows as bit masks over columns in order of (frequency, item)."""

    def __init__(self, covers: list[list[int]]):
        freq = Counter(x for c in covers for x in set(c))
        self.columns = sorted(freq, key=lambda x: (freq[x], x))
        at = {x: k for k, x in enumerate(self.columns)}
        self.masks = [sum(1 << at[x] for x in set(c)) for c in covers]
        self.full = (1 << len(self.columns)) - 1
        self.rows = [[r for r, m in enumerate(self.masks) if m >> k & 1] for k in range(len(self.columns))]

    def fitting(self, covered: int) -> list[list[int]]:
        """Rows that still fit, for each column that isn't covered."""
        return [[r for r in self.rows[k] if not self.masks[r] & covered] for k in range(len(self.columns)) if not covered >> k & 1]


def all_exact_covers(covers: list[list[int]]) -> Iterator[list[int]]:
    """All sets of rows that cover every item once, depth first."""
    c = _Covers(covers)

    def visit(covered: int, chosen: list[int]) -> Iterator[list[int]]:
        if covered == c.full:
            yield chosen
            return
        for r in min(c.fitting(covered), key=len):
            yield from visit(covered | c.masks[r], [*chosen, r])

    return visit(0, [])


def _best_first(c: _Covers, rating, start: float, max_iter: int | None, max_heap: int | None) -> Generator[list[int], None, bool]:
    """Exact covers in the order of `rating(chosen rows, covered)`, of equal ones the first in; returns whether these are all.

    Every state taken counts against max_iter; a state that finds max_heap waiting ends the search.
    """
    ticket, heap, left = count(), [], max_iter
    heapq.heappush(heap, (start, next(ticket), 0, ()))
    while heap and left != 0:
        left = None if left is None else left - 1
        _, _, covered, chosen = heapq.heappop(heap)
        if covered == c.full:
            yield list(chosen)
            continue
        best = min(c.fitting(covered), key=len)
        for r in reversed(best):
            if max_heap is not None and len(heap) >= max_heap:
                return False
            now, picked = covered | c.masks[r], (*chosen, r)
            heapq.heappush(heap, (rating(picked, now), next(ticket), now, picked))
    return not heap


def top_exact_covers(covers: list[list[int]], weights: list[float], max_iter: int | None = None, max_heap: int | None = None) -> Generator[list[int], None, bool]:
    """Exact covers by search cost, the sum of weight over size of the rows; returns whether these are all.

    Partial covers wait by that cost and, for each open item, the least cost of a row that fits. As a row may fit several
    items, that can be more than what follows costs, so covers needn't come in the order of their costs. See `_best_first`.
    """
    c = _Covers(covers)
    cost = [w / max(1, m.bit_count()) for w, m in zip(weights, c.masks, strict=True)]

    def rating(picked: tuple[int, ...], covered: int) -> float:
        return sum(cost[x] for x in picked) + sum(min((cost[x] for x in rows), default=inf) for rows in c.fitting(covered))

    return _best_first(c, rating, 0.0, max_iter, max_heap)


def least_by_size(sizes: Iterable[int], costs: Iterable[float], most: int) -> list[float]:
    """The least cost of rows of 0, 1, ... `most` items together, whichever items; infinite where sizes don't add up."""
    single: dict[int, float] = {}
    for s, w in zip(sizes, costs, strict=True):
        if s > 0:
            single[s] = min(single.get(s, inf), w)
    least = [0.0]
    for n in range(1, most + 1):
        least.append(min((w + least[n - s] for s, w in single.items() if s <= n), default=inf))
    return least


def _ln_factorial(n: int) -> float:
    return lgamma(n + 1)


def composition_cost(labels: Iterable[int], open_vertices: int) -> float:
    """ln of the product of the labels' count factorials, less that of as many things as there are labels and open vertices."""
    return composition_cost_of(Counter(labels).values(), open_vertices)


def composition_cost_of(counts: Iterable[int], open_vertices: int) -> float:
    """`composition_cost` of labels that stand so many times."""
    counts = list(counts)
    return sum(map(_ln_factorial, counts)) - _ln_factorial(sum(counts) + open_vertices)


def bonding_cost(inner: int, bonds: int) -> float:
    """ln of the ways to pair the ends of the bonds that no piece has inside."""
    n = bonds - inner
    return 0.0 if n < 2 else n * log(2) - log(pi) / 2 + lgamma(n + 0.5)


def top_structural_covers(
    covers: list[list[int]], weights: list[float], inner_bonds: list[int], bonds: int, labels: list[int], vertices: int, max_iter: int | None = None, max_heap: int | None = None
) -> Generator[list[int], None, bool]:
    """Exact covers by the sum of their rows' weights and what their composition costs; returns whether these are all.

    A cover adds `composition_cost` of its rows' labels and `bonding_cost` of the bonds that no row has inside. A partial
    one counts its open vertices as pieces of their own, and the least that rows of so many items can weigh. As that is an
    estimate only, the order is that of the search, not of the cost.
    """
    c = _Covers(covers)
    sizes = [m.bit_count() for m in c.masks]
    ahead = least_by_size(sizes, weights, len(c.columns))

    def rating(picked: tuple[int, ...], covered: int) -> float:
        done, own = covered.bit_count(), sum(weights[x] for x in picked)
        cost = own + composition_cost((labels[x] for x in picked), max(vertices - done, 0))
        if done >= vertices:
            return cost + bonding_cost(sum(inner_bonds[x] for x in picked), bonds)
        return cost + ahead[len(c.columns) - done]

    return _best_first(c, rating, 0.0, max_iter, max_heap)


def ring_blocks(n: int, bonds: Iterable[tuple[int, int]]) -> tuple[dict[tuple[int, int], int], list[int]]:
    """Each bond's block, and each vertex's smallest fellow that it reaches without a bridge.

    Blocks are the largest sets of bonds any two of which lie on one ring, numbered from 0; a bridge is a block alone.
    Bonds are pairs (smaller, larger), repeated ones are one and loops none. A walk keeps, for each vertex, the earliest
    one that it or what follows can reach by one bond back; where nothing reaches before a vertex, a block ends.
    """
    near: dict[int, list[int]] = {v: [] for v in range(n)}
    for a, b in sorted({(min(b), max(b)) for b in bonds if b[0] != b[1]}):
        near[a].append(b)
        near[b].append(a)
    seen, low, block, waiting = [-1] * n, [0] * n, {}, []
    order = count()
    blocks = count()
    for start in range(n):
        if seen[start] >= 0:
            continue
        seen[start] = low[start] = next(order)
        walk = [(start, -1, iter(near[start]))]
        while walk:
            v, before, rest = walk[-1]
            w = next(rest, None)
            if w is None:
                walk.pop()
                if walk:
                    u = walk[-1][0]
                    low[u] = min(low[u], low[v])
                    if low[v] >= seen[u]:
                        number = next(blocks)
                        while True:
                            bond = waiting.pop()
                            block[min(bond), max(bond)] = number
                            if bond == (u, v):
                                break
            elif seen[w] < 0:
                seen[w] = low[w] = next(order)
                waiting.append((v, w))
                walk.append((w, v, iter(near[w])))
            elif w != before and seen[w] < seen[v]:
                waiting.append((v, w))
                low[v] = min(low[v], seen[w])
    sizes = Counter(block.values())
    least = list(range(n))

    def find(v: int) -> int:
        while least[v] != v:
            v = least[v]
        return v

    for (a, b), k in block.items():
        if sizes[k] > 1:
            x, y = find(a), find(b)
            least[max(x, y)] = min(x, y)
    return block, [find(v) for v in range(n)]


def top_exact_covers_or_all(covers, weights, n: int | None, max_iter: int | None = None, max_heap: int | None = None) -> tuple[list[list[int]], bool]:
    """The covers of `top_n_exact_covers`, and whether the search came to its end with no more than these."""
    search, out = top_exact_covers(covers, weights, max_iter, max_heap), []
    while True:
        try:
            found = next(search)
        except StopIteration as end:
            return out, bool(end.value)
        if n is not None and len(out) == n:
            return out, False
        out.append(found)


def top_n_exact_covers(covers, weights, n: int | None, max_iter: int | None = None, max_heap: int | None = None) -> list[list[int]]:
    out = []
    if n == 0:
        return out
    for found in top_exact_covers(covers, weights, max_iter, max_heap):
        out.append(found)
        if len(out) == n:
            break
    return out


def _log_sum(xs: Iterable[float]) -> float:
    xs = list(xs)
    top = max(xs, default=-inf)
    return top if top in (-inf, inf) else top + log(sum(exp(x - top) for x in xs))


def top_p_exact_covers(covers, weights, alpha: float, max_iter: int | None = None, max_heap: int | None = None) -> list[list[int]]:
    """Best-first covers until the share of those not seen is estimated at alpha or less; [] for an alpha outside 0 to 1.

    There are about as many covers as a Bell number says, and each unseen one has at most the last one's mass.
    """
    if not 0 <= alpha <= 1:
        return []
    n = len({x for c in covers for x in c})
    total = n * log(0.792 * n / log(n + 1)) if n else 0.0
    out, last, known, goal = [], -inf, -inf, log(alpha) if alpha else -inf
    search = top_exact_covers(covers, weights, max_iter, max_heap)
    while True:
        rest = 0.0
        if out:
            seen = log(len(out))
            rest = last + (total + log1p(-exp(seen - total)) if total > seen else -inf)
        both = _log_sum([rest, known])
        if (rest - both if rest != -inf else -inf) <= goal:
            return out
        found = next(search, None)
        if found is None:
            return out
        out.append(found)
        last = -sum(weights[r] for r in found)
        known = _log_sum([known, last])
