"""Operators on collections of graphs in long form: vertices (graph_id, v, ...) and bonds (graph_id, src, trg)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import written


def counts(vertices: DataFrame, bonds: DataFrame) -> DataFrame:
    n, m = vertices.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_vertices")), bonds.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_bonds"))
    return n.join(m, "graph_id", "left").fillna(0, ["n_bonds"])


def both_ways(bonds: DataFrame) -> DataFrame:
    """graph_id, v and its neighbour w; a loop once."""
    there = bonds.select("graph_id", F.col("src").alias("v"), F.col("trg").alias("w"))
    return there.unionAll(there.where("v <> w").selectExpr("graph_id", "w AS v", "v AS w"))


def degrees(vertices: DataFrame, bonds: DataFrame) -> DataFrame:
    d = both_ways(bonds).groupBy("graph_id", "v").agg(F.count(F.lit(1)).alias("degree"))
    return vertices.select("graph_id", "v").join(d, ["graph_id", "v"], "left").fillna(0, ["degree"])


def extensions(vertices: DataFrame, bonds: DataFrame) -> DataFrame:
    """graph_id, v, w and w's label: ways to extend the one-vertex subgraph {v}."""
    return both_ways(bonds).join(vertices.select("graph_id", F.col("v").alias("w"), "label"), ["graph_id", "w"])


def induced(vertices: DataFrame, bonds: DataFrame, keep: str) -> tuple[DataFrame, DataFrame]:
    """The subgraphs on the vertices for which the condition holds, numbered anew in the old order."""
    from pyspark.sql import Window

    new = (F.row_number().over(Window.partitionBy("graph_id").orderBy("v")) - 1).alias("new")
    kept = vertices.where(keep).withColumn("new", new)
    at = kept.select("graph_id", "v", "new")
    out = bonds.join(at.selectExpr("graph_id", "v AS src", "new AS s"), ["graph_id", "src"]).join(at.selectExpr("graph_id", "v AS trg", "new AS t"), ["graph_id", "trg"])
    return kept.drop("v").withColumnRenamed("new", "v"), out.select("graph_id", F.col("s").alias("src"), F.col("t").alias("trg"))


def parents(vertices: DataFrame, bonds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All graphs with one vertex less, as graph_id and the vertex that is gone; the others keep their numbers."""
    gone = vertices.select("graph_id", F.col("v").alias("gone"))
    return gone.join(vertices, "graph_id").where("v <> gone"), gone.join(bonds, "graph_id").where("src <> gone AND trg <> gone")


def concatenated(vertices: DataFrame, bonds: DataFrame, key: str, order: str = "graph_id") -> tuple[DataFrame, DataFrame]:
    """Disjoint unions of all graphs with one `key`: vertices are shifted by the sizes of the graphs before."""
    from pyspark.sql import Window

    sizes = vertices.groupBy(key, "graph_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.withColumn("shift", F.coalesce(F.sum("n").over(w), F.lit(0))).select(key, "graph_id", "shift")
    v = vertices.join(shift, [key, "graph_id"]).withColumn("v", F.col("v") + F.col("shift")).drop("shift")
    b = bonds.join(shift, "graph_id").select(key, (F.col("src") + F.col("shift")).alias("src"), (F.col("trg") + F.col("shift")).alias("trg"))
    return v, b


def bond_fragments(vertices: DataFrame, bonds: DataFrame) -> DataFrame:
    """Two-vertex fragments as (first, second) labels in order: number of embeddings and of graphs."""
    label = vertices.select("graph_id", "v", "label")
    ends = bonds.join(label.selectExpr("graph_id", "v AS src", "label AS a"), ["graph_id", "src"]).join(label.selectExpr("graph_id", "v AS trg", "label AS b"), ["graph_id", "trg"])
    ends = ends.select("graph_id", F.least("a", "b").alias("first"), F.greatest("a", "b").alias("second"))
    return ends.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n_embeddings"), F.countDistinct("graph_id").alias("n_graphs"))


def path_fragments(vertices: DataFrame, bonds: DataFrame) -> DataFrame:
    """Three vertices in a path by (end, middle, end) labels: each middle with two of its neighbours."""
    label = vertices.select("graph_id", "v", "label")
    near = both_ways(bonds).join(label.selectExpr("graph_id", "v AS w", "label AS lw"), ["graph_id", "w"])
    pairs = near.alias("x").join(near.alias("y"), ["graph_id", "v"]).where("x.w < y.w")
    pairs = pairs.select("graph_id", "v", F.least("x.lw", "y.lw").alias("first"), F.greatest("x.lw", "y.lw").alias("last"))
    found = pairs.join(label.selectExpr("graph_id", "v", "label AS middle"), ["graph_id", "v"])
    return found.groupBy("first", "middle", "last").agg(F.count(F.lit(1)).alias("n_embeddings"), F.countDistinct("graph_id").alias("n_graphs"))


def components(vertices: DataFrame, bonds: DataFrame) -> DataFrame:
    """graph_id, v and component, the smallest vertex it is connected with. A graph's bonds are gathered and joined in one row."""
    v = vertices.groupBy("graph_id").agg(F.collect_list("v").alias("vs"))
    b = bonds.groupBy("graph_id").agg(F.collect_list(F.struct("src", "trg")).alias("bonds"))
    kind = v.schema["vs"].dataType.elementType.simpleString()

    def join(batches):
        for batch in batches:
            out = []
            for vs, bonds in zip(batch.column("vs").to_pylist(), batch.column("bonds").to_pylist(), strict=True):
                up = {x: x for x in vs}

                def root(x, up=up):
                    while up[x] != x:
                        up[x] = x = up[up[x]]
                    return x

                for e in bonds or ():
                    a, b = sorted((root(e["src"]), root(e["trg"])))
                    up[b] = a
                out.append([{"v": x, "component": root(x)} for x in vs])
            item = batch.schema.field("vs").type.value_type
            found = pa.array(out, pa.list_(pa.struct([("v", item), ("component", item)])))
            yield pa.RecordBatch.from_arrays([batch.column("graph_id"), found], ["graph_id", "found"])

    schema = f"graph_id {v.schema['graph_id'].dataType.simpleString()}, found array<struct<v:{kind},component:{kind}>>"
    return v.join(b, "graph_id", "left").mapInArrow(join, schema).select("graph_id", F.inline("found"))


def components_at_large(vertices: DataFrame, bonds: DataFrame) -> DataFrame:
    """The same for graphs that no task holds: labels spread to neighbours and are then followed at once, round by round."""
    labels = written(vertices.select("graph_id", "v", F.col("v").alias("component")), "components")
    pairs = written(both_ways(bonds).select("graph_id", "v", "w").distinct(), "pairs")
    while True:
        near = pairs.join(labels.selectExpr("graph_id", "v AS w", "component AS c"), ["graph_id", "w"]).groupBy("graph_id", "v").agg(F.min("c").alias("c"))
        step = labels.join(near, ["graph_id", "v"], "left").select("graph_id", "v", "component", F.least("component", F.coalesce("c", "component")).alias("to"))
        jump = step.join(step.selectExpr("graph_id", "v AS to", "to AS further"), ["graph_id", "to"]).select("graph_id", "v", "component", F.least("to", "further").alias("to"))
        jump = written(jump, "components")
        labels = jump.select("graph_id", "v", F.col("to").alias("component"))
        if jump.where("component <> to").isEmpty():
            return labels


def top_with_ties(df: DataFrame, k: int, value: str, keys: list[str] | None = None) -> DataFrame:
    """The k rows with the largest `value`, in each group if keys are given, and all that tie with the last of them.

    Without keys the k-th value is found first (a limit, not a window over all rows) and then bounds the rest.
    """
    from pyspark.sql import Window

    if k <= 0:
        return df.where("1 = 0")
    if keys:
        return df.withColumn("_r", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(value)))).where(F.col("_r") <= k).drop("_r")
    bound = df.select(value).orderBy(F.desc(value)).limit(k).agg(F.min(value).alias("_least"))
    return df.crossJoin(F.broadcast(bound)).where(F.col(value) >= F.col("_least")).drop("_least")


def rings(graphs: DataFrame) -> DataFrame:
    """graph_id, src, trg (src < trg), block and ring of every bond of rows (graph_id, bonds, colors).

    block: number of the bonds' block in the graph, the largest set of bonds any two of which lie on one ring. ring: the
    smallest vertex that both ends reach without a bridge; null for a bridge, which lies on no ring.
    """
    from .kernels import ring_blocks
    from .mining import each, graph_of

    def kernel(r):
        colors, bonds = graph_of(r)
        block, least = ring_blocks(len(colors), bonds)
        sizes: dict[int, int] = {}
        for k in block.values():
            sizes[k] = sizes.get(k, 0) + 1
        for (a, b), k in sorted(block.items()):
            yield {"graph_id": r["graph_id"], "src": a, "trg": b, "block": k, "ring": least[a] if sizes[k] > 1 else None}

    fields = [("graph_id", pa.int64()), ("src", pa.int32()), ("trg", pa.int32()), ("block", pa.int32()), ("ring", pa.int32())]
    return graphs.select("graph_id", "bonds", "colors").mapInArrow(each(fields, kernel), "graph_id bigint, src int, trg int, block int, ring int")
