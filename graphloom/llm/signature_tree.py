"""Signature trees: nodes with OR-combined token bitmaps and size ranges, joined by dual traversal."""

from __future__ import annotations

import numpy as np

FANOUT = 8
#: Node pairs whose bitmaps are compared at once.
AT_ONCE = 1 << 15


class SignatureTree:
    """Sets of hashes, sorted by size; each level joins FANOUT nodes of the one below."""

    def __init__(self, sets: list[np.ndarray], labels: np.ndarray, bits: int):
        size = np.array([len(s) for s in sets], np.int64)
        self.order = np.lexsort((np.array([s[0] for s in sets], np.uint64), size))
        self.sets = [sets[i] for i in self.order]
        size, labels = size[self.order], labels[self.order]
        flat = np.zeros((len(sets), bits), bool)
        for row, s in enumerate(self.sets):
            flat[row, (s % np.uint64(bits)).astype(np.int64)] = True
        maps = np.packbits(flat, axis=1).view(np.uint64)
        excess = size - np.bitwise_count(maps).sum(axis=1).astype(np.int64)  # elements that share their bit
        #: Bottom level first: bitmaps, smallest and largest size, largest excess, label (-1: several).
        self.levels = [(maps, size, size, excess, labels)]
        while len(self.levels[-1][1]) > 1:
            maps, low, high, excess, label = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            first, last = np.minimum.reduceat(label, at), np.maximum.reduceat(label, at)
            self.levels.append(
                (np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at), np.where(first == last, first, -1))
            )


def _may_link(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether some pair below nodes i and j can reach the similarity num / den, and they aren't all of one label."""
    (ma, la, ha, ea, ta), (mb, lb, hb, eb, tb) = a, b
    ok = (den * ha[i] >= num * lb[j]) & (den * hb[j] >= num * la[i]) & ((ta[i] != tb[j]) | (ta[i] < 0))
    at = np.flatnonzero(ok)
    i, j = i[at], j[at]
    most = np.bitwise_count(ma[i] & mb[j]).sum(axis=1).astype(np.int64) + np.minimum(ea[i], eb[j])
    ok[at] = (num + den) * np.minimum(most, np.minimum(ha[i], hb[j])) >= num * (la[i] + lb[j])
    return ok


def _pairs(a: SignatureTree, b: SignatureTree, num: int, den: int):
    """Blocks of pairs of sets that may link, from the roots down."""
    own = a is b
    top = max(len(a.levels), len(b.levels)) - 1

    def level(t: SignatureTree, k: int) -> tuple:
        return t.levels[min(k, len(t.levels) - 1)]

    def children(t: SignatureTree, k: int, i: int) -> range:
        if k >= len(t.levels):
            return range(i, i + 1)
        return range(i * FANOUT, min((i + 1) * FANOUT, len(t.levels[k - 1][1])))

    stack = [(top, np.array([0]), np.array([0]))]
    while stack:
        k, i, j = stack.pop()
        ok = _may_link(level(a, k), level(b, k), i, j, num, den)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if k == 0:
            yield i, j
            continue
        found = [(x, y) for p, q in zip(i.tolist(), j.tolist(), strict=True) for x in children(a, k, p) for y in children(b, k, q) if not own or x < y or (x == y and k > 1)]
        found = np.array(found, np.int64).reshape(-1, 2)
        for s in range(0, len(found), AT_ONCE):
            stack.append((k - 1, found[s : s + AT_ONCE, 0], found[s : s + AT_ONCE, 1]))


def links(left: tuple[np.ndarray, list, np.ndarray], right: tuple[np.ndarray, list, np.ndarray] | None, num: int, den: int) -> list[tuple[int, int]]:
    """Links (ids) that join all sets of similarity num / den or more; pairs that other links join already are left out.

    A side is ids, sets (sorted distinct hashes, none empty) and labels; equal labels are joined already. Without a
    right side the left one is joined with itself.
    """
    sides = [left] if right is None else [left, right]
    if any(not len(s[0]) for s in sides):
        return []
    common = np.sort(np.concatenate([[len(x) for x in s[1]] for s in sides]))
    bits = 1 << int(np.clip(4 * common[len(common) // 2], 256, 8192) - 1).bit_length()
    trees = [SignatureTree(s[1], s[2], bits) for s in sides]
    a, b = trees[0], trees[-1]
    ids = [s[0][t.order].tolist() for s, t in zip(sides, trees, strict=True)]
    labels = [t.levels[0][4].tolist() for t in trees]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    out = []
    for i, j in _pairs(a, b, num, den):
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            p, q = root(labels[0][x]), root(labels[-1][y])
            if p == q:
                continue
            s, t = a.sets[x], b.sets[y]
            both = len(s) + len(t) - len(np.union1d(s, t))
            if den * both >= num * (len(s) + len(t) - both):
                parent[max(p, q)] = min(p, q)
                out.append((ids[0][x], ids[-1][y]))
    return out
