"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b); the component is its smallest node.

    Each round every node points to its smallest neighbour, pointers are followed once more, and edges are drawn
    between what they point to; edges inside one component vanish. A hub of any degree is only ever a grouping key.
    """
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    pairs = written(pairs, "edges")
    labels = written(pairs.selectExpr("a AS node").unionAll(pairs.selectExpr("b AS node")).distinct().selectExpr("node", "node AS component"), "labels")
    while not pairs.isEmpty():
        up = written(pairs.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")), "pointers")
        far = up.join(up.selectExpr("node AS up", "up AS higher"), "up", "left").select("node", F.coalesce("higher", "up").alias("up"))
        far = written(far, "pointers")
        labels = labels.join(far.selectExpr("node AS component", "up"), "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        labels = written(labels, "labels")
        moved = pairs.join(far.selectExpr("node AS a", "up AS ua"), "a", "left").join(far.selectExpr("node AS b", "up AS ub"), "b", "left")
        moved = moved.select(F.coalesce("ua", "a").alias("x"), F.coalesce("ub", "b").alias("y"))
        # a pointer that was cut short still joins its two ends
        links = far.join(up.selectExpr("node", "up AS first"), "node").select(F.col("up").alias("x"), F.col("first").alias("y"))
        links = links.join(far.selectExpr("node AS y", "up AS uy"), "y", "left").select("x", F.coalesce("uy", "y").alias("y"))
        both = moved.unionAll(links)
        pairs = written(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct(), "edges")
    return labels
