"""Changes of graphs in long form, and fragments' places among one another."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graphs import components
from .kernels import canonical, connected_sets, induced, neighbors, overlap_clusters
from .mining import each, graph_of


def is_connected(vertices: DataFrame, bonds: DataFrame) -> DataFrame:
    """graph_id, n_components and whether it is one; a graph without vertices is not in the result."""
    n = components(vertices, bonds).groupBy("graph_id").agg(F.countDistinct("component").alias("n_components"))
    return n.withColumn("connected", F.col("n_components") == 1)


def component_graphs(vertices: DataFrame, bonds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The components as graphs of their own, named by graph_id and component (a vertex), vertices numbered anew in the old order."""
    place = F.row_number().over(Window.partitionBy("graph_id", "component").orderBy("v")) - 1
    at = components(vertices, bonds).withColumn("new", place)
    v = vertices.join(at, ["graph_id", "v"]).drop("v").withColumnRenamed("new", "v")
    b = bonds.join(at.selectExpr("graph_id", "v AS src", "component", "new AS s"), ["graph_id", "src"]).join(at.selectExpr("graph_id", "v AS trg", "new AS t"), ["graph_id", "trg"])
    return v, b.select("graph_id", "component", F.col("s").alias("src"), F.col("t").alias("trg"))


def with_vertex(vertices: DataFrame, bonds: DataFrame, label: Column, to: str) -> tuple[DataFrame, DataFrame]:
    """Each graph with one vertex more, of a label, bonded to the vertices for which the condition holds."""
    last = vertices.groupBy("graph_id").agg((F.max("v") + 1).alias("new"))
    more = last.select("graph_id", F.col("new").alias("v"), label.alias("label"))
    new = vertices.where(to).join(last, "graph_id").select("graph_id", F.col("v").alias("src"), F.col("new").alias("trg"))
    return vertices.select("graph_id", "v", "label").unionAll(more), bonds.select("graph_id", "src", "trg").unionAll(new)


def without_vertex(vertices: DataFrame, bonds: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each graph without its vertex in `gone` (graph_id, gone), the later vertices numbered down; graphs not in it stay."""
    at = F.col("gone")

    def down(v: str) -> Column:
        return F.when(F.col(v) > at, F.col(v) - 1).otherwise(F.col(v)).alias(v)

    v = vertices.join(gone, "graph_id", "left").where(at.isNull() | (F.col("v") != at))
    b = bonds.join(gone, "graph_id", "left").where(at.isNull() | ((F.col("src") != at) & (F.col("trg") != at)))
    return v.select("graph_id", down("v"), "label"), b.select("graph_id", down("src"), down("trg"))


def permuted(vertices: DataFrame, bonds: DataFrame, order: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices named anew by `order` (graph_id, v, new); bonds go from the smaller to the larger new name."""
    v = vertices.join(order, ["graph_id", "v"]).drop("v").withColumnRenamed("new", "v")
    b = bonds.join(order.selectExpr("graph_id", "v AS src", "new AS s"), ["graph_id", "src"]).join(order.selectExpr("graph_id", "v AS trg", "new AS t"), ["graph_id", "trg"])
    return v, b.select("graph_id", F.least("s", "t").alias("src"), F.greatest("s", "t").alias("trg"))


def recolored(vertices: DataFrame, colors: DataFrame) -> DataFrame:
    """Labels replaced by `colors` (label, new), which is a dictionary; a label that it lacks stays."""
    found = vertices.join(colors, "label", "left")
    return found.withColumn("label", F.coalesce("new", "label")).drop("new")


def parse_form(text: str) -> tuple[tuple[int, ...], tuple[tuple[int, int], ...]]:
    """Colours and bonds of a canonical text."""
    pairs, _, colors = text.partition(";")
    ends = [int(x) for x in pairs.split(",")] if pairs else []
    return tuple(int(c) for c in colors.split(",")) if colors else (), tuple(zip(ends[::2], ends[1::2], strict=True))


def verified_forms(forms: DataFrame) -> DataFrame:
    """fragment and whether it is the canonical text of the graph it describes."""

    def kernel(r):
        yield {"fragment": r["fragment"], "canonical": canonical(*parse_form(r["fragment"]))[0] == r["fragment"]}

    return forms.select("fragment").mapInArrow(each([("fragment", pa.string()), ("canonical", pa.bool_())], kernel), "fragment string, canonical boolean")


def fragment_tree(fragments: DataFrame) -> DataFrame:
    """fragment, size, parent and color: how each fragment comes from a parent by one vertex of a colour.

    A parent is what is left without one vertex, if that is connected; single vertices have a null parent. One row for
    each way that differs.
    """

    def kernel(r):
        colors, bonds = parse_form(r["fragment"])
        near, n = neighbors(len(colors), bonds), len(colors)
        if n == 1:
            yield {"fragment": r["fragment"], "size": 1, "parent": None, "color": colors[0]}
        ways = set()
        for v in range(n if n > 1 else 0):
            rest = tuple(w for w in range(n) if w != v)
            some = induced(rest, list(colors), near)
            if any(len(s) == n - 1 for s in connected_sets(n - 1, neighbors(n - 1, some[1]), n - 1)):
                ways.add((canonical(*some)[0], colors[v]))
        for parent, color in sorted(ways):
            yield {"fragment": r["fragment"], "size": n, "parent": parent, "color": color}

    fields = [("fragment", pa.string()), ("size", pa.int32()), ("parent", pa.string()), ("color", pa.int32())]
    return fragments.select("fragment").distinct().mapInArrow(each(fields, kernel), "fragment string, size int, parent string, color int")


def tree_steps(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """`wanted` (parent, color) with the fragments that one vertex of the colour makes of the parent; null if none."""
    return wanted.join(tree.where("parent IS NOT NULL").select("parent", "color", "fragment"), ["parent", "color"], "left")


def tree_json(tree: DataFrame) -> DataFrame:
    """fragment and node, a JSON object of its size and its ways from parents, in order."""
    ways = F.array_sort(F.collect_list(F.struct("parent", "color")))
    nodes = tree.groupBy("fragment").agg(F.first("size").alias("size"), ways.alias("from"))
    return nodes.select("fragment", F.to_json(F.struct("size", F.filter("from", lambda w: w["parent"].isNotNull()).alias("from"))).alias("node"))


def read_tree_json(nodes: DataFrame) -> DataFrame:
    """The table that `tree_json` was made of."""
    kind = "struct<size:int,from:array<struct<parent:string,color:int>>>"
    n = nodes.select("fragment", F.from_json("node", kind).alias("n"))
    way = F.explode_outer("n.from")
    found = n.select("fragment", F.col("n.size").alias("size"), way.alias("w")).select("fragment", "size", "w.parent", "w.color")
    own = F.element_at(F.split("fragment", ";"), -1).try_cast("int")
    return found.withColumn("color", F.coalesce("color", own))


def clusters_of_overlaps(graphs: DataFrame, size: int) -> DataFrame:
    """graph_id, fragment, n (connected sets of `size` vertices that make it) and n_clusters, of sets that share vertices."""
    from .kernels import fragments_of

    def kernel(r):
        colors, bonds = graph_of(r)
        for text, sets in fragments_of(colors, bonds, size).items():
            if len(sets[0]) == size:
                yield {"graph_id": r["graph_id"], "fragment": text, "n": len(sets), "n_clusters": overlap_clusters(sets)}

    fields = [("graph_id", pa.int64()), ("fragment", pa.string()), ("n", pa.int64()), ("n_clusters", pa.int64())]
    return graphs.select("graph_id", "bonds", "colors").mapInArrow(each(fields, kernel), "graph_id bigint, fragment string, n bigint, n_clusters bigint")


def _inside_pairs(graphs: DataFrame) -> DataFrame:
    """fragment, child and n of single vertices: how many lie in each bonded pair, and, with a null child, how many there are."""
    none = F.array().cast("array<struct<src:int,trg:int>>")
    ends = F.filter(F.coalesce("bonds", none), lambda b: b["src"] != b["trg"])

    def way(v: Column, w: Column) -> Column:
        a, b = F.get("colors", v), F.get("colors", w)
        child = F.concat(F.lit("0,1;"), F.least(a, b).cast("string"), F.lit(","), F.greatest(a, b).cast("string"))
        return F.struct(v.alias("v"), a.alias("color"), child.alias("child"))

    both = F.concat(F.transform(ends, lambda b: way(b["src"], b["trg"])), F.transform(ends, lambda b: way(b["trg"], b["src"])))
    pairs = graphs.select(F.explode(F.array_distinct(both)).alias("x")).select("x.color", "x.child")
    single = graphs.select(F.explode("colors").alias("color"), F.lit(None).cast("string").alias("child"))
    counts = pairs.unionByName(single).groupBy("color", "child").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.concat(F.lit(";"), F.col("color").cast("string")).alias("fragment"), "child", "n")


def _inside_larger(graphs: DataFrame, most: int) -> DataFrame:
    """The same of fragments of up to `most` vertices."""
    from .kernels import fragments_of

    def kernel(r):
        colors, bonds = graph_of(r)
        found = fragments_of(colors, bonds, most + 1)
        name = {frozenset(s): t for t, sets in found.items() for s in sets}
        grown: dict[frozenset, set[str]] = {}
        for s, t in name.items():
            if len(s) > 1:
                for v in s:
                    if (small := s - {v}) in name:
                        grown.setdefault(small, set()).add(t)
        counts: dict[tuple[str, str | None], int] = {}
        for s, t in name.items():
            if len(s) <= most:
                for key in [(t, None), *((t, c) for c in grown.get(s, ()))]:
                    counts[key] = counts.get(key, 0) + 1
        for (t, c), n in counts.items():
            yield {"fragment": t, "child": c, "n": n}

    fields = [("fragment", pa.string()), ("child", pa.string()), ("n", pa.int64())]
    return graphs.select("graph_id", "bonds", "colors").mapInArrow(each(fields, kernel), "fragment string, child string, n bigint")


def dependent_fragments(graphs: DataFrame, most: int) -> DataFrame:
    """fragment, n (its embeddings, of up to `most` vertices), dependent and in_fragments.

    A fragment is dependent if some fragment of one vertex more has all its embeddings inside it; these are in_fragments,
    sorted.
    """
    rows = _inside_pairs(graphs) if most == 1 else _inside_larger(graphs, most)
    sums = rows.groupBy("fragment", "child").agg(F.sum("n").alias("n"))
    total = sums.where("child IS NULL").select("fragment", "n")
    whole = sums.where("child IS NOT NULL").withColumnRenamed("n", "inside").join(total, "fragment").where("inside = n")
    names = whole.groupBy("fragment").agg(F.array_sort(F.collect_list("child")).alias("in_fragments"))
    out = total.join(names, "fragment", "left").withColumn("in_fragments", F.coalesce("in_fragments", F.array().cast("array<string>")))
    return out.select("fragment", "n", (F.size("in_fragments") > 0).alias("dependent"), "in_fragments")
