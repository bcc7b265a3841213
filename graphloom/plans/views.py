"""Collections of labelled graphs as views of relational tables.

A collection is two tables: vertices (graph_id, v, label, group, weight) and bonds (graph_id, src, trg) with src < trg;
vertices of a graph are numbered from 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE_ORDER = (
    "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_vertices(spark: SparkSession, sf_dir: str, label: str = "concat(l_returnflag, l_linestatus)") -> DataFrame:
    """One graph per order, a vertex per line item; the group is the customer, who has weight 1 over all orders."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("graph_id"), F.col("o_custkey").alias("group"), (1.0 / F.count(F.lit(1)).over(Window.partitionBy("o_custkey"))).alias("weight")
    )
    # renamed before it is dealt by, so that lines are shuffled and sorted by it once, for their places and for the join
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "graph_id")
    lines = lines.withColumn("v", F.row_number().over(Window.partitionBy("graph_id").orderBy(*LINE_ORDER)) - 1)
    return lines.select("graph_id", "v", F.expr(label).alias("label"), F.col("l_suppkey").alias("supplier")).join(orders, "graph_id")


def path_bonds(vertices: DataFrame) -> DataFrame:
    """Bonds between consecutive vertices."""
    return vertices.where("v > 0").select("graph_id", (F.col("v") - 1).alias("src"), F.col("v").alias("trg"))


def supplier_bonds(vertices: DataFrame) -> DataFrame:
    """Path bonds and, as chords, bonds between vertices with one supplier that aren't consecutive."""
    a, b = vertices.select("graph_id", F.col("v").alias("src"), "supplier"), vertices.select("graph_id", F.col("v").alias("trg"), "supplier")
    chords = a.join(b, ["graph_id", "supplier"]).where("trg - src > 1").select("graph_id", "src", "trg")
    return path_bonds(vertices).unionAll(chords)


def session_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One graph per user and day of events, in order of time."""
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    place = F.row_number().over(Window.partitionBy("user_id", "day").orderBy("ts", "event_id")) - 1
    graph = F.concat_ws("/", "user_id", "day")
    return events.select(graph.alias("graph_id"), place.alias("v"), F.col("event_type").alias("label"), F.col("user_id").alias("group"), F.lit(1.0).alias("weight"))


def place_bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, nation, customer and supplier as a forest of named vertices."""

    def named(kind: str, key: str):
        return F.concat(F.lit(kind), F.col(key).cast("string"))

    nation, customer, supplier = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    return (
        nation.select(named("r", "n_regionkey").alias("src"), named("n", "n_nationkey").alias("trg"))
        .unionAll(customer.select(named("n", "c_nationkey").alias("src"), named("c", "c_custkey").alias("trg")))
        .unionAll(supplier.select(named("n", "s_nationkey").alias("src"), named("s", "s_suppkey").alias("trg")))
    )
