"""Sums over all partitions of graphs that are not listed: a partition is a way through what is covered so far.

A step covers the first open vertex by a row, a set of vertices. Ways that have covered the same vertices go on together,
so a path of n vertices takes n + 1 states, while its partitions grow exponentially with n. Graphs whose rows are the same sets
have the same states and steps, whatever their colours, and are summed at once as arrays.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

Sets = tuple[tuple[int, ...], ...]
#: Graphs that wait to be summed together, numbers that a sum holds at once, and steps that a task keeps, at most.
WAITING, NUMBERS, KEPT = 4096, 1 << 21, 1 << 18


@dataclass(frozen=True)
class Steps:
    """Steps (from, row, to) on ways from state 0 to the last one, by `from`; n_parts is the number of ways.

    `pieces` bounds the steps of a way.
    """

    n_states: int
    steps: list[tuple[int, int, int]]
    n_parts: int
    pieces: int

    def at_once(self, width: int = 1) -> int:
        """How many graphs to sum at once, if each has so many numbers for a state."""
        return max(NUMBERS // (max(self.n_states, 1) * max(width, 1)), 1)


def steps_of(sets: Sets) -> Steps:
    """The steps of exact covers of all items in `sets` by them; without a cover there is no state."""
    items = sorted({x for s in sets for x in s})
    at = {x: k for k, x in enumerate(items)}
    masks = [sum(1 << at[x] for x in set(s)) for s in sets]
    by_item: list[list[int]] = [[] for _ in items]
    for r, m in enumerate(masks):
        for k in range(len(items)):
            if m >> k & 1:
                by_item[k].append(r)
    full, found, level = (1 << len(items)) - 1, {}, {0}
    while level:
        following = set()
        for covered in level:
            if covered in found or covered == full:
                continue
            first = (~covered & (covered + 1)).bit_length() - 1
            found[covered] = [(r, covered | masks[r]) for r in by_item[first] if not masks[r] & covered]
            following.update(to for _, to in found[covered])
        level = following
    ways = {full: 1}
    for covered in sorted(found, reverse=True):  # a step only adds items, so it leads to a larger number
        n = sum(ways.get(to, 0) for _, to in found[covered])
        if n:
            ways[covered] = n
    if 0 not in ways:
        return Steps(0, [], 0, 0)
    number = {covered: k for k, covered in enumerate(sorted(ways))}
    steps = [(number[covered], r, number[to]) for covered in sorted(ways) for r, to in found.get(covered, ()) if to in ways]
    return Steps(len(ways), steps, ways[0], len(items))


def log_sums(s: Steps, w: np.ndarray) -> np.ndarray:
    """ln of the sum over all ways, for each row of `w`, log-weights by graph and row of the cover."""
    return _forward(s, w)[-1]


def _forward(s: Steps, w: np.ndarray) -> np.ndarray:
    out = np.full((s.n_states, len(w)), -np.inf)
    out[0] = 0.0
    for a, r, b in s.steps:
        out[b] = np.logaddexp(out[b], out[a] + w[:, r])
    return out


def best_sums(s: Steps, w: np.ndarray) -> np.ndarray:
    """The largest log-weight of a way, for each row of `w`."""
    out = np.full((s.n_states, len(w)), -np.inf)
    out[0] = 0.0
    for a, r, b in s.steps:
        np.maximum(out[b], out[a] + w[:, r], out=out[b])
    return out[-1]


def shares(s: Steps, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`log_sums`, and the share of the ways that use each row, by likelihood; where none is likely, all ways share alike."""
    total = log_sums(s, w)
    w = np.where(np.isneginf(total)[:, None], 0.0, w)
    before, after = _forward(s, w), np.full((s.n_states, len(w)), -np.inf)
    after[-1] = 0.0
    for a, r, b in reversed(s.steps):
        after[a] = np.logaddexp(after[a], after[b] + w[:, r])
    out = np.zeros(w.shape)
    for a, r, b in s.steps:
        out[:, r] += np.exp(before[a] + w[:, r] + after[b] - before[-1])
    return total, out


def log_sums_by_pieces(s: Steps, w: np.ndarray) -> np.ndarray:
    """`log_sums` over the ways of 0, 1, ... steps, as columns."""
    out = np.full((s.n_states, s.pieces + 1, len(w)), -np.inf)
    out[0, 0] = 0.0
    for a, r, b in s.steps:
        out[b, 1:] = np.logaddexp(out[b, 1:], out[a, :-1] + w[:, r])
    return out[-1].T


def log_losses(s: Steps, w: np.ndarray, ids: np.ndarray, free: np.ndarray) -> np.ndarray:
    """`tuning.losses_of` of all ways, by graph and fragment; `ids` are the fragments of the rows, for each graph."""

    def freed(by_pieces: np.ndarray, free: np.ndarray) -> np.ndarray:
        out = np.full(np.broadcast_shapes(by_pieces[:, :1].shape, free.shape), -np.inf)
        for k in range(by_pieces.shape[1]):
            some = by_pieces[:, k : k + 1]
            with np.errstate(invalid="ignore"):
                out = np.logaddexp(out, np.where(np.isneginf(some), -np.inf, some - (k * free if k else 0.0)))
        return out

    out = freed(log_sums_by_pieces(s, w), free[None, :])
    pairs = sorted({(g, i) for g, row in enumerate(ids.tolist()) for i in row})
    for start in range(0, len(pairs), step := s.at_once(s.pieces + 1)):
        g, i = np.array(pairs[start : start + step]).T
        without = np.where(ids[g] == i[:, None], -np.inf, w[g])
        out[g, i] = freed(log_sums_by_pieces(s, without), free[i][:, None])[:, 0]
    return out


def ways_by_pieces(s: Steps, kinds: list[int]) -> list[tuple[tuple[int, ...], int]]:
    """How many of each kind of row ways use, and the number of ways that use so many; `kinds` has the rows' kinds from 0.

    Ways that have covered the same vertices by as many rows of each kind go on together.
    """
    width, n_kinds = s.pieces.bit_length(), max(kinds, default=-1) + 1
    at: list[dict[int, int]] = [{} for _ in range(s.n_states)]
    if at:
        at[0][0] = 1
    for k, (a, r, b) in enumerate(s.steps):
        more, into = 1 << kinds[r] * width, at[b]
        for used, n in at[a].items():
            into[used + more] = into.get(used + more, 0) + n
        if k + 1 < len(s.steps) and s.steps[k + 1][0] != a:
            at[a] = {}  # all steps from it are done
    return [(tuple(used >> k * width & (1 << width) - 1 for k in range(n_kinds)), n) for used, n in (at[-1] if at else {}).items()]


def by_sets(rows: Iterable[tuple[object, Sets, list[int]]], held: int = 1) -> Iterator[tuple[list, Steps, np.ndarray]]:
    """Keys, steps and ids (by graph and row) of graphs with the same sets; those that have no partition are left out.

    `rows` are keys, sets and the fragments' ids in the order of the sets. `held` is how many numbers a graph takes in what
    is to follow, besides those of its states.
    """

    kept: dict[Sets, Steps] = {}
    at_once, most = WAITING, KEPT

    def ready():
        for sets, some in waiting.items():
            if sets not in kept:
                if sum(len(x.steps) + 8 for x in kept.values()) > most:
                    kept.clear()
                kept[sets] = steps_of(sets)
            steps = kept[sets]
            if steps.n_parts:
                n = max(min(steps.at_once(steps.pieces + 1), NUMBERS // max(held, 1)), 1)
                for k in range(0, len(some), n):
                    yield [x for x, _ in some[k : k + n]], steps, np.array([i for _, i in some[k : k + n]], int).reshape(len(some[k : k + n]), -1)

    waiting, n = {}, 0
    for key, sets, ids in rows:
        waiting.setdefault(sets, []).append((key, ids))
        n += 1
        if n == at_once:
            yield from ready()
            waiting, n = {}, 0
    yield from ready()
