"""Vectors of single labels, their likelihood, and the two averages that bring partitions back to one row an input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.logs import INF, ln


def label_vectors(vertices: DataFrame, key: str = "label") -> DataFrame:
    """graph_id, key and count: each graph's only partition if fragments are single labels."""
    return vertices.groupBy("graph_id", key).agg(F.count(F.lit(1)).alias("count"))


def csr(vectors: DataFrame) -> DataFrame:
    """(graph_id, idx, count) as one sparse row a graph: data and indices in order of idx, and indptr."""
    cells = vectors.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("idx", "count"))).alias("cells"))
    return cells.select("graph_id", F.col("cells.count").alias("data"), F.col("cells.idx").alias("indices"), F.array(F.lit(0), F.size("cells")).alias("indptr"))


def label_logweights(vertices: DataFrame) -> DataFrame:
    """label and lweight, ln of its share of all vertices; one step of expectation-maximisation for single labels."""
    counts = vertices.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("label", F.ln(F.col("n") / F.col("total")).alias("lweight"))


def weighted_label_logweights(vertices: DataFrame) -> DataFrame:
    """The same with each graph counting by its weight."""
    sums = vertices.groupBy("label").agg(F.sum("weight").alias("w"))
    total = sums.agg(F.sum("w").alias("total"))
    return sums.crossJoin(F.broadcast(total)).select("label", ln(F.col("w") / F.col("total")).alias("lweight"))


def information(vertices: DataFrame, logweights: DataFrame) -> DataFrame:
    """graph_id, n_vertices and information, the sum of its labels' log-weights; null if one has none."""
    found = label_vectors(vertices).join(logweights, "label", "left")
    whole = F.bool_and(F.col("lweight").isNotNull())
    return found.groupBy("graph_id").agg(F.sum("count").alias("n_vertices"), F.when(whole, F.sum(F.col("count") * F.col("lweight"))).alias("information"))


def label_loss(vertices: DataFrame, logweights: DataFrame) -> DataFrame:
    """label and loss, what the likelihood would lose without it: graphs that lack a label gain by the mass it frees.

    A graph without the label has size n and gains n ln(1 - p); one with it is lost and adds its own likelihood. The
    result is the weighted gain of the first, and needs one pass: sizes of all graphs less those of graphs with it.
    """
    sizes = vertices.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"), F.first("weight").alias("weight"))
    total = sizes.agg(F.sum(F.col("n") * F.col("weight")).alias("every"))
    having = label_vectors(vertices).join(sizes, "graph_id").groupBy("label").agg(F.sum(F.col("n") * F.col("weight")).alias("with"))
    out = having.join(logweights, "label").crossJoin(F.broadcast(total))
    return out.select("label", (-(F.col("every") - F.col("with")) * F.log1p(-F.exp("lweight"))).alias("loss"))


def final_weights(partitions: DataFrame, least: float = 1e-9) -> DataFrame:
    """Adds final_weight, the share of a partition among its graph's times the graph's and the row's weight.

    Rows of `least` or less go. Needs group_item, group_norm, lweight_part, weight and weight_ug.
    """
    w = Window.partitionBy("group_item", "group_norm")
    top = F.max("lweight_part").over(w)
    df = partitions.withColumn("_m", top).withColumn("_e", F.when(F.col("_m") == -INF, 0.0).otherwise(F.exp(F.col("lweight_part") - F.col("_m"))))
    df = df.withColumn("_s", F.sum("_e").over(w))
    df = df.withColumn("final_weight", F.col("_e") / F.nullif(F.col("_s"), F.lit(0.0)) * F.col("weight") * F.col("weight_ug"))
    return df.where(F.col("final_weight") > least).drop("_m", "_e", "_s")


def compact(rows: DataFrame, predictions: tuple[str, ...] = (), strict: bool = True) -> DataFrame:
    """One row per (group, group_item): log-weight and predictions, over partitions and then over its graphs.

    Partitions of one graph are averaged by exp(lweight_part), and their log-weight is ln of the sum; graphs of one row
    are averaged by weight_ug. Rows whose filter isn't NONE take no part. Strictly, an input with a graph that has no
    row left gives no result at all. A null among the log-weights or predictions that are averaged makes the average null;
    a null log-weight does so to the predictions too.
    """
    item, graph = ["group", "group_item"], ["group", "group_item", "group_norm"]
    if strict:
        lost = F.bool_and(F.col("filter") != "NONE").over(Window.partitionBy(*graph))
        rows = rows.withColumn("_lost", lost)
        rows = rows.withColumn("_bad", F.bool_or("_lost").over(Window.partitionBy(*item))).where(~F.col("_bad"))
    rows = rows.where("filter = 'NONE'").withColumn("_top", F.max("lweight_part").over(Window.partitionBy(*graph)))
    e = F.when(F.col("_top") == -INF, 0.0).otherwise(F.exp(F.col("lweight_part") - F.col("_top")))
    rows = rows.withColumn("_e", e)

    def whole(c: str, value: Column) -> Column:
        """`value`, null if a row of the group has none of column c."""
        return F.when(F.count(c) == F.count(F.lit(1)), value)

    weighted = [whole(p, F.sum(F.col("_e") * F.col(p)) / F.nullif(F.sum("_e"), F.lit(0.0))) for p in predictions]
    per_graph = rows.groupBy(*graph).agg(
        whole("lweight_part", ln(F.sum("_e")) + F.max("_top")).alias("lweight_part"),
        F.max("weight_ug").alias("weight_ug"),
        *(whole("lweight_part", x).alias(p) for p, x in zip(predictions, weighted, strict=True)),
    )
    share = F.sum("weight_ug")
    averages = ((c, F.sum(F.col(c) * F.col("weight_ug")) / share) for c in ("lweight_part", *predictions))
    return per_graph.groupBy(*item).agg(*(whole(c, x).alias(c) for c, x in averages))
