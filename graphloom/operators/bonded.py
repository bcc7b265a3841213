"""Graphs with coloured bonds, and graphs whose vertices have labels of their own instead of a dictionary's colours."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import canonical, canonical_search
from .mining import each

BOND = "struct<src:int,trg:int,color:int>"


def bonded_search(colors: list[int], bonds: list[tuple[int, int, int]]) -> tuple[list[int], int, list[tuple[int, ...]]]:
    """Vertices in an order in which isomorphic graphs are equal, the number of automorphisms, and some that make all.

    Each bond becomes a vertex between its ends, of a colour that no vertex has.
    """
    n, top = len(colors), max(colors, default=0) + 1
    first = min((c for _, _, c in bonds), default=0)
    inner = [(v, n + k) for k, (a, b, _) in enumerate(bonds) for v in (a, b)]
    order, automorphisms, moves = canonical_search((*colors, *(top + c - first for _, _, c in bonds)), tuple(inner))
    return [v for v in order if v < n], automorphisms, [g[:n] for g in moves]


def bonded_text(colors: list[int], bonds: list[tuple[int, int, int]], order: list[int]) -> str:
    """Text `s,t,c,s,t,c,...;colors` of the graph with its vertices in the order."""
    place = {v: k for k, v in enumerate(order)}
    named = sorted((max(place[a], place[b]), min(place[a], place[b]), c) for a, b, c in bonds)
    return ",".join(f"{a},{b},{c}" for b, a, c in named) + ";" + ",".join(str(colors[v]) for v in order)


def canonical_bonded(colors: list[int], bonds: list[tuple[int, int, int]]) -> tuple[str, int]:
    """Text that isomorphic graphs with coloured bonds share, and the number of automorphisms."""
    order, automorphisms, _ = bonded_search(colors, bonds)
    return bonded_text(colors, bonds, order), automorphisms


def parse_bonded(text: str) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Colours and bonds of such a text."""
    triples, _, colors = text.partition(";")
    x = [int(i) for i in triples.split(",")] if triples else []
    return [int(c) for c in colors.split(",")] if colors else [], list(zip(x[::3], x[1::3], x[2::3], strict=True))


def canonical_typed(labels: list[str], bonds: list[tuple[int, int]]) -> str:
    """Text `bonds;[labels]` that isomorphic graphs with labels share."""
    names = sorted(set(labels))
    text, _ = canonical(tuple(names.index(x) for x in labels), tuple(bonds))
    pairs, _, colors = text.partition(";")
    return pairs + ";" + json.dumps([names[int(c)] for c in colors.split(",")] if labels else [], separators=(",", ":"))


def canonical_bonded_forms(graphs: DataFrame) -> DataFrame:
    """graph_id, canonical and automorphisms of rows (graph_id, bonds with colours, colors)."""

    def kernel(r):
        text, n = canonical_bonded(list(r["colors"] or ()), [(b["src"], b["trg"], b["color"]) for b in r["bonds"] or ()])
        yield {"graph_id": r["graph_id"], "canonical": text, "automorphisms": n}

    fields = [("graph_id", pa.int64()), ("canonical", pa.string()), ("automorphisms", pa.int64())]
    return graphs.select("graph_id", "bonds", "colors").mapInArrow(each(fields, kernel), "graph_id bigint, canonical string, automorphisms bigint")


def canonical_typed_forms(graphs: DataFrame) -> DataFrame:
    """graph_id and canonical of rows (graph_id, bonds, labels)."""

    def kernel(r):
        yield {"graph_id": r["graph_id"], "canonical": canonical_typed(list(r["labels"] or ()), [(b["src"], b["trg"]) for b in r["bonds"] or ()])}

    fields = [("graph_id", pa.int64()), ("canonical", pa.string())]
    return graphs.select("graph_id", "bonds", "labels").mapInArrow(each(fields, kernel), "graph_id bigint, canonical string")


def common_bonded(vertices: DataFrame, bonds: DataFrame, min_groups: int = 1) -> DataFrame:
    """Fragments of a vertex, or of two and their bond's colour, with weight, groups, graphs and embeddings.

    `vertices` has graph_id, v, color, group and weight, `bonds` graph_id, src, trg and color. A fragment is (first,
    bond, second), with null for what it lacks; those of two vertices need `min_groups` groups. Weight is that of the
    graphs that have it, each counted once. `growth.mine` finds larger ones, and ranks them.
    """
    ends = vertices.select("graph_id", "v", "color", "group", "weight")
    single = ends.select("graph_id", "group", "weight", F.col("color").alias("first"), F.lit(None).cast("int").alias("bond"), F.lit(None).cast("int").alias("second"))
    a, b = ends.select("graph_id", F.col("v").alias("src"), F.col("color").alias("ca"), "group", "weight"), ends.select("graph_id", F.col("v").alias("trg"), F.col("color").alias("cb"))
    pairs = bonds.join(a, ["graph_id", "src"]).join(b, ["graph_id", "trg"])
    pairs = pairs.select("graph_id", "group", "weight", F.least("ca", "cb").alias("first"), F.col("color").alias("bond"), F.greatest("ca", "cb").alias("second"))
    # one row for each graph and fragment before anything is shuffled by fragment
    seen = single.unionAll(pairs).groupBy("first", "bond", "second", "graph_id").agg(F.first("group").alias("group"), F.first("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
    found = seen.groupBy("first", "bond", "second").agg(
        F.sum("weight").alias("weight"), F.countDistinct("group").alias("n_groups"), F.count(F.lit(1)).alias("n_graphs"), F.sum("n").alias("n_embeddings")
    )
    return found.where(F.col("bond").isNull() | (F.col("n_groups") >= min_groups))
