"""Tuning of a fragment model by loss, over a store of partitions that are found once.

The store has a row for each distinct graph, with the places where fragments lie in it and whether the search came to its
end within its limits. If so all its partitions count, which are summed over the places and not listed (see `sums`); a
search without limits is not run at all. Other graphs
are searched each round, over the stored places, as their best partitions change with the weights. A round hands the
model's weights to tasks as one broadcast array, adds up each task's graphs before anything is shuffled, and brings a sum
for each fragment to the driver.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import spread, written
from .kernels import all_exact_covers, fragments_of, top_exact_covers_or_all
from .mining import MAX_FRAGMENTS, each, few_rows, graph_of
from .sums import by_sets, log_losses, log_sums, shares

_FRAG = pa.struct([("id", pa.int32()), ("n", pa.int32())])
_FIELDS = [
    ("graph_id", pa.int64()),
    ("weight", pa.float64()),
    ("places", pa.list_(pa.struct([("id", pa.int32()), ("members", pa.list_(pa.int32()))]))),
    ("complete", pa.bool_()),
    ("parts", pa.list_(pa.list_(_FRAG))),
]
STORE = "graph_id bigint, weight double, places array<struct<id:int,members:array<int>>>, complete boolean, parts array<array<struct<id:int,n:int>>>"


@dataclass(frozen=True)
class Search:
    """Limits of the search for a graph's partitions; None is no limit."""

    limit: int | None = 64
    max_iter: int | None = 65536
    max_heap: int | None = 65536


@dataclass(frozen=True)
class PartitionStore:
    """The table (see STORE), how many fragments it was made for, whose ids stay what they were, and its search.

    `parts` are kept where the search has a limit of their number; without one a graph can have too many to be held.
    """

    table: DataFrame
    n: int
    search: Search

    def weights(self, model: dict[str, tuple[int, float]]) -> np.ndarray:
        """Log-weights by id; not a number where the fragment is gone."""
        out = np.full(self.n, np.nan)
        for i, w in model.values():
            out[i] = w
        return out

    def partitions(self, model: dict[str, tuple[int, float]]) -> DataFrame:
        """graph_id, part, lweight and frags of the distinct graphs' partitions into the model's fragments."""
        shared, search = self.table.sparkSession.sparkContext.broadcast(self.weights(model)), self.search

        def kernel(r):
            w = shared.value
            for k, p in enumerate(_parts_of(r, w, search)):
                yield {"graph_id": r["graph_id"], "part": k, "lweight": sum(float(w[f["id"]]) * f["n"] for f in p), "frags": p}

        fields = [("graph_id", pa.int64()), ("part", pa.int32()), ("lweight", pa.float64()), ("frags", pa.list_(_FRAG))]
        return self.table.mapInArrow(each(fields, kernel), "graph_id bigint, part int, lweight double, frags array<struct<id:int,n:int>>")


def _alive(places: list[dict], weights: np.ndarray) -> list[dict]:
    """The places of fragments that are left; none if a vertex is in none of them."""
    alive = [p for p in places if not math.isnan(weights[p["id"]])]
    return alive if {v for p in alive for v in p["members"]} == {v for p in places for v in p["members"]} else []


def _counted(alive: list[dict], cover: list[int]) -> list[dict]:
    return [{"id": i, "n": n} for i, n in sorted(Counter(alive[x]["id"] for x in cover).items())]


def _searched(places: list[dict], weights: np.ndarray, search: Search) -> tuple[list[list[dict]], bool]:
    """Partitions as counts of fragments, in search order, and whether these are all."""
    alive = _alive(places, weights)
    if not alive:
        return [], True
    found, complete = top_exact_covers_or_all([p["members"] for p in alive], [-weights[p["id"]] for p in alive], search.limit, search.max_iter, search.max_heap)
    return [_counted(alive, cover) for cover in found], complete


def _parts_of(row: dict, weights: np.ndarray, search: Search) -> Iterable[list[dict]]:
    if not row["complete"]:
        return _searched(row["places"], weights, search)[0]
    if row["parts"] is not None:
        return [p for p in row["parts"] if not any(math.isnan(weights[f["id"]]) for f in p)]
    alive = _alive(row["places"], weights)
    return (_counted(alive, cover) for cover in all_exact_covers([p["members"] for p in alive]) if alive)


def partition_store(graphs: DataFrame, model: dict[str, tuple[int, float]], most: int, search: Search = Search()) -> PartitionStore:
    """The store of the distinct graphs among `graphs` (graph_id, weight, bonds, colors).

    `model` maps fragments' texts to ids, from 0 without gaps, and log-weights; fragments have up to `most` vertices.
    Equal graphs are one, with the sum of their weights and the smallest id. A graph with a vertex that no fragment
    covers, or without vertices, is left out.
    """
    if len(model) > MAX_FRAGMENTS:
        raise ValueError(f"more than {MAX_FRAGMENTS} fragments")
    if {i for i, _ in model.values()} != set(range(len(model))):
        raise ValueError("ids must go from 0 without gaps")
    distinct = graphs.groupBy("bonds", "colors").agg(F.min("graph_id").alias("graph_id"), F.sum("weight").alias("weight"))
    shared = graphs.sparkSession.sparkContext.broadcast(model)

    def kernel(r):
        fragments = shared.value
        colors, bonds = graph_of(r)
        found = fragments_of(colors, bonds, most)
        places = sorted((m, fragments[t][0]) for t, sets in found.items() if t in fragments for m in sets)
        if not colors or {v for m, _ in places for v in m} != set(range(len(colors))):
            return
        places = [{"id": i, "members": list(m)} for m, i in places]
        weights = np.empty(len(fragments))
        for i, w in fragments.values():
            weights[i] = w
        parts, complete = (None, True) if search == Search(None, None, None) else _searched(places, weights, search)
        yield {"graph_id": r["graph_id"], "weight": r["weight"], "places": places, "complete": complete, "parts": parts if complete and search.limit is not None else None}

    return PartitionStore(written(spread(distinct).mapInArrow(each(_FIELDS, kernel), STORE), "partitions"), len(model), search)


def _log_sum(x: np.ndarray, axis: int = 0) -> np.ndarray:
    top = x.max(axis=axis)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(np.isinf(top), top, top + np.log(np.exp(x - np.where(np.isinf(top), 0, top)).sum(axis=axis)))


def losses_of(parts: list[tuple[float, list[dict]]], free: np.ndarray) -> np.ndarray:
    """What stays of one graph's likelihood without each fragment, in logarithms.

    `free` is what each fragment's absence makes every piece likelier by, less than zero. Fragments that the graph doesn't
    use see the same partitions, which are summed by their number of pieces; only for those in use is each number of
    pieces summed again without them.
    """
    by_size: dict[int, list[float]] = {}
    using: dict[int, dict[int, list[float]]] = {}
    for lweight, frags in parts:
        size = sum(f["n"] for f in frags)
        by_size.setdefault(size, []).append(lweight)
    out = np.full(len(free), -math.inf)
    for size, some in by_size.items():
        out = np.logaddexp(out, float(_log_sum(np.array(some))) - size * free)
    for i in {f["id"] for _, frags in parts for f in frags}:
        using[i] = {}
        for lweight, frags in parts:
            if all(f["id"] != i for f in frags):
                using[i].setdefault(sum(f["n"] for f in frags), []).append(lweight)
        rest = [float(_log_sum(np.array(some))) - size * free[i] for size, some in using[i].items()]
        out[i] = float(_log_sum(np.array(rest))) if rest else -math.inf
    return out


def freed(weights: np.ndarray) -> np.ndarray:
    """What each fragment's absence makes every piece likelier by, less than zero; nothing for one that is gone."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(weights < 0, np.log1p(-np.exp(weights)), np.where(np.isnan(weights), 0.0, -math.inf))


def color_costs(model: dict[str, tuple[int, float]]) -> dict[int, float]:
    """Each fragment's own log-likelihood: that of its colours, by their counts over all the fragments."""
    colors = {i: [c for c in t.partition(";")[2].split(",") if c] for t, (i, _) in model.items()}
    counts = Counter(c for cs in colors.values() for c in cs)
    total = sum(counts.values())
    return {i: sum(math.log(counts[c] / total) for c in cs) for i, cs in colors.items()}


def _totals(store: PartitionStore, model: dict[str, tuple[int, float]], losses: bool) -> tuple[np.ndarray, float]:
    """Expected counts (or losses) by fragment over all graphs by weight, and the log-likelihood of all graphs."""
    shared, search = store.table.sparkSession.sparkContext.broadcast(store.weights(model)), store.search

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        free, total, likelihood = freed(w), np.zeros(len(w)), [0.0]

        def some(r: dict) -> None:
            parts = [(sum(float(w[f["id"]]) * f["n"] for f in p), p) for p in _parts_of(r, w, search)]
            if not parts:
                return
            logs = np.array([x for x, _ in parts])
            whole = float(_log_sum(logs))
            likelihood[0] += r["weight"] * whole
            if losses:
                np.add(total, r["weight"] * losses_of(parts, free), out=total)
                return
            share = np.exp(logs - whole) if whole > -math.inf else np.full(len(logs), 1 / len(logs))
            for s, (_, p) in zip(share, parts, strict=True):
                for f in p:
                    total[f["id"]] += r["weight"] * s * f["n"]

        def every() -> Iterator[tuple]:
            for r in (r for b in batches for r in few_rows(b) if r["weight"] != 0):
                if not r["complete"]:
                    some(r)
                elif alive := _alive(r["places"], w):
                    yield r["weight"], tuple(tuple(p["members"]) for p in alive), [p["id"] for p in alive]

        for n, steps, ids in by_sets(every(), len(w) if losses else 1):
            n = np.array(n, float)
            if losses:
                likelihood[0] += float(n @ log_sums(steps, w[ids]))
                total += n @ log_losses(steps, w[ids], ids, free)
            else:
                whole, share = shares(steps, w[ids])
                likelihood[0] += float(n @ whole)
                np.add.at(total, ids, n[:, None] * share)
        likelihood = likelihood[0]
        at = np.flatnonzero(total != 0)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], likelihood))], ["id", "s"])

    rows = store.table.select("weight", "places", "complete").mapInArrow(sums, "id int, s double").groupBy("id").agg(F.sum("s").alias("s")).toLocalIterator()
    out, likelihood = np.zeros(store.n), 0.0
    for r in rows:
        if r["id"] < 0:
            likelihood = r["s"]
        else:
            out[r["id"]] = r["s"]
    return out, likelihood


def normalized(model: dict[str, tuple[int, float]]) -> dict[str, tuple[int, float]]:
    top = max((w for _, w in model.values()), default=0.0)
    norm = top + math.log(sum(math.exp(w - top) for _, w in model.values()) or 1.0) if model else 0.0
    return {t: (i, w - norm) for t, (i, w) in model.items()}


def em_round(store: PartitionStore, model: dict[str, tuple[int, float]], floor: float = -100.0) -> dict[str, tuple[int, float]]:
    """The model after one round of expectation-maximisation; no log-weight falls below the floor before all are scaled."""
    mass, _ = _totals(store, model, losses=False)
    total = mass.sum()
    return normalized({t: (i, max(math.log(mass[i] / total), floor) if mass[i] > 0 else floor) for t, (i, _) in model.items()})


def fragment_losses(store: PartitionStore, model: dict[str, tuple[int, float]]) -> tuple[dict[int, float], float]:
    """The loss of each fragment, and the log-likelihood of the graphs and of the fragments themselves.

    A loss is the weighted sum over graphs of what stays of their likelihood without the fragment (see `losses_of`), less
    the log-likelihood of the fragment's own colours. A graph that can't do without it makes it minus infinity.
    """
    total, likelihood = _totals(store, model, losses=True)
    own = color_costs(model)
    return {i: float(total[i]) - own[i] for i, _ in model.values()}, likelihood + sum(own.values())


def pruned(model: dict[str, tuple[int, float]], losses: dict[int, float], share: float, at_most: int | None = None) -> dict[str, tuple[int, float]]:
    """The model without the share of its fragments that cost least to lose, one at least, single vertices exempt.

    The next to go has the largest loss, then the smallest log-weight, then the largest id. With `at_most`, no more go
    than are above that number.
    """
    several = sorted((t for t in model if "," in t.partition(";")[2]), key=lambda t: (-losses[model[t][0]], model[t][1], -model[t][0]))
    n = max(int(len(model) * share), 1)
    if at_most is not None:
        n = min(n, max(len(model) - at_most, 0))
    gone = set(several[:n])
    return normalized({t: x for t, x in model.items() if t not in gone})


def tune(store: PartitionStore, model: dict[str, tuple[int, float]], rounds: int = 5, share: float = 0.2, floor: float = -100.0, size: int | None = None) -> dict[str, tuple[int, float]]:
    """The model after expectation-maximisation, pruned by loss and trained again as long as that makes it likelier.

    Each time the share of fragments with the largest loss goes (see `pruned`) and `rounds` rounds follow. It ends when
    the log-likelihood of graphs and fragments is less than that of the model before, which is then the result; with
    `size`, when no more than so many fragments are left, whatever the likelihood; or when only single vertices are left.
    A share of 0 prunes nothing. Ids stay what they are.
    """
    for _ in range(rounds):
        model = em_round(store, model, floor)
    if share <= 0:
        return model
    before, last = model, -math.inf
    while size is None or len(model) > size:
        losses, likelihood = fragment_losses(store, model)
        if size is None and likelihood < last:
            return before
        smaller = pruned(model, losses, share, size)
        if len(smaller) == len(model):
            return model
        before, last, model = model, likelihood, smaller
        for _ in range(rounds):
            model = em_round(store, model, floor)
    return model


def resized(model: dict[str, tuple[int, float]]) -> dict[str, tuple[int, float]]:
    """Ids from 0 in the old order."""
    at = {i: k for k, i in enumerate(sorted(i for i, _ in model.values()))}
    return {t: (at[i], w) for t, (i, w) in model.items()}

