"""Two-stage suffix sorting to a stated depth, in numpy.

Suffixes smaller than their successors are sorted directly; the others are induced by a scan of the buckets of first
symbols, from the smallest symbol up. Symbols are 0 to 256; 0 ends a segment, and the text ends with one.
"""

from __future__ import annotations

import numpy as np

#: Symbols that one sort key holds, nine bits each.
PER_KEY = 7


def sort_keys(text: np.ndarray) -> np.ndarray:
    """For each place the next PER_KEY symbols as one number; beyond the end there are zeros."""
    padded = np.concatenate([text, np.zeros(PER_KEY, text.dtype)])
    key = np.zeros(len(text), np.uint64)
    for k in range(PER_KEY):
        key <<= np.uint64(9)
        key |= padded[k : k + len(text)]
    return key


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the one that starts a symbol later; the last one counts as such."""
    if not len(text):
        return np.empty(0, bool)
    rises = np.append(text[:-1] < text[1:], True)
    differs = np.append(text[:-1] != text[1:], True)
    at = np.flatnonzero(differs)  # a run of equal symbols goes by its last one
    return np.repeat(rises[at], np.diff(at, prepend=-1))


def _sort_directly(places: np.ndarray, keys: np.ndarray, depth: int) -> np.ndarray:
    """Places in order of their first `depth` symbols, ties in any order."""
    order = places[np.argsort(keys[places], kind="stable")]
    k = keys[order]
    same = k[1:] == k[:-1]
    for at in range(PER_KEY, depth, PER_KEY):
        tied = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        where = np.flatnonzero(tied)
        if not len(where):
            break
        mine = order[where]
        group = np.cumsum(~np.concatenate([[False], same])[where])
        nxt = mine + at
        k = np.where(nxt < len(keys), keys[np.minimum(nxt, len(keys) - 1)], 0)
        inner = np.lexsort((k, group))
        order[where] = mine[inner]
        k, group = k[inner], group[inner]
        within = (k[1:] == k[:-1]) & (group[1:] == group[:-1])
        same = same.copy()
        adjacent = np.diff(where) == 1
        same[where[:-1][adjacent]] &= within[adjacent]
    return order


def two_stage_order(text: np.ndarray, keys: np.ndarray, depth: int) -> np.ndarray:
    """All places of `text`, ordered by their suffixes' first `depth` symbols at least."""
    small = smaller_than_next(text)
    direct = _sort_directly(np.flatnonzero(small), keys, depth)
    first = np.searchsorted(text[direct], np.arange(258))
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []
    for c in range(257):
        found, fresh = [], np.concatenate(waiting[c]) if waiting[c] else np.empty(0, np.int64)
        waiting[c] = []
        while len(fresh):
            found.append(fresh)
            before = fresh[fresh > 0] - 1
            fresh = before[text[before] == c]
        bucket = np.concatenate([*found, direct[first[c] : first[c + 1]]])
        if len(bucket):
            out.append(bucket)
            before = bucket[bucket > 0] - 1
            symbol = text[before]
            before, symbol = before[symbol > c], symbol[symbol > c]
            by = np.argsort(symbol, kind="stable")
            before, symbol = before[by], symbol[by]
            cuts = np.flatnonzero(np.diff(symbol)) + 1
            for part in np.split(before, cuts) if len(before) else ():
                waiting[text[part[0]]].append(part)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def common_prefix_reaches(order: np.ndarray, text: np.ndarray, keys: np.ndarray, depth: int) -> np.ndarray:
    """Whether each place of `order` has its first `depth` symbols in common with the one before; the first hasn't."""
    a, b = order[:-1], order[1:]
    same = np.ones(len(b), bool)
    for at in range(0, depth - PER_KEY + 1, PER_KEY):
        same &= keys[a + at] == keys[b + at]
    for at in range(depth - depth % PER_KEY, depth):
        same &= text[a + at] == text[b + at]
    return np.concatenate([[False], same])[: len(order)]
