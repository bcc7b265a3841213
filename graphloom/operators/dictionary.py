"""Label dictionaries under a minimum of supporting groups, and colouring by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import written


def label_support(vertices: DataFrame) -> DataFrame:
    """label, n_groups (groups with it) and n (vertices with it); null labels count for nothing."""
    return vertices.where("label IS NOT NULL").groupBy("label").agg(F.countDistinct("group").alias("n_groups"), F.count(F.lit(1)).alias("n"))


def label_dictionary(vertices: DataFrame) -> DataFrame:
    """label and idx from 0, by falling number of groups, then label. One row for each label, so one task may rank them."""
    order = Window.orderBy(F.desc("n_groups"), "label")
    return label_support(vertices).withColumn("idx", F.row_number().over(order) - 1)


def mincount_cascade(occurrences: DataFrame, min_count: int, kind: str | None = None) -> DataFrame:
    """The occurrences (label, group, item) that are left when every label is in min_count groups.

    An item goes with all its labels as soon as one of them is rare, which can make others rare; the largest set
    without rare labels is left, whatever the order. min_count of 1 or less changes nothing.
    """
    names = ["group", "item", "label"] + ([kind] if kind else [])
    left = occurrences.select(*names).distinct()
    if min_count <= 1:
        return left
    keys = ["label"] + ([kind] if kind else [])
    left = written(left, "occurrences")
    # items of each label and group; a round writes only what it takes away, and the occurrences are joined with that
    support = written(left.groupBy(*keys, "group").agg(F.count(F.lit(1)).alias("n")), "support")
    counts = support.groupBy(*keys).agg(F.count(F.lit(1)).alias("groups"))
    rare, gone, taken = written(counts.where(F.col("groups") < min_count).select(*keys), "rare-labels"), None, None
    counts = written(counts.join(rare, keys, "left_anti"), "labels")
    while not rare.isEmpty():
        bad = left.join(rare, keys, "left_semi").select("group", "item").distinct()
        bad = written(bad if gone is None else bad.join(gone, ["group", "item"], "left_anti"), "rare-items")
        gone = bad if gone is None else gone.unionAll(bad)
        now = written(left.join(bad, ["group", "item"], "left_semi").groupBy(*keys, "group").agg(F.count(F.lit(1)).alias("less")), "taken")
        taken = now if taken is None else taken.unionAll(now)
        # of the labels' groups that this round has touched, those without an item left
        touched = taken.join(now.select(*keys, "group"), [*keys, "group"], "left_semi").groupBy(*keys, "group").agg(F.sum("less").alias("less"))
        empty = touched.join(support, [*keys, "group"]).where("less = n").groupBy(*keys).agg(F.count(F.lit(1)).alias("fewer"))
        counts = counts.join(empty, keys, "left").withColumn("groups", F.col("groups") - F.coalesce("fewer", F.lit(0))).drop("fewer")
        counts = written(counts, "labels")
        rare = counts.where(F.col("groups") < min_count).select(*keys)
        counts = counts.where(F.col("groups") >= min_count)
    return left if gone is None else left.join(gone, ["group", "item"], "left_anti")


def colored(vertices: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Vertices with their color (null if the label isn't known) and whether their whole graph is known."""
    found = vertices.join(dictionary.select("label", F.col("idx").alias("color")), "label", "left")
    known = F.bool_and(F.col("color").isNotNull()).over(Window.partitionBy("graph_id"))
    return found.withColumn("known", known)


def unknown_labels(vertices: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Labels that the dictionary lacks, and how many graphs have them."""
    return vertices.join(dictionary, "label", "left_anti").groupBy("label").agg(F.countDistinct("graph_id").alias("n_graphs"))


def map_features(features: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(graph_id, name, count) to (graph_id, idx, count); a graph with an unknown feature gets none at all."""
    found = features.join(dictionary.select(F.col("label").alias("name"), "idx"), "name", "left")
    found = found.withColumn("known", F.bool_and(F.col("idx").isNotNull()).over(Window.partitionBy("graph_id")))
    return found.where("known").groupBy("graph_id", "idx").agg(F.sum("count").alias("count"))
