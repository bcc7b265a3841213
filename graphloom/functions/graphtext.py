"""Graphs as text: `s,t,s,t,...;c,c,...` with integer colours, or with a JSON array of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BONDS = "array<struct<src:int,trg:int>>"


def _pairs(text: Column) -> Column:
    numbers = F.transform(F.filter(F.split(text, ","), lambda x: x != ""), lambda x: x.try_cast("int"))
    even = F.filter(numbers, lambda x, i: i % 2 == 0)
    odd = F.filter(numbers, lambda x, i: i % 2 == 1)
    return F.zip_with(even, odd, lambda a, b: F.struct(a.alias("src"), b.alias("trg")))


def parse_bonds(text: Column) -> Column:
    return F.coalesce(_pairs(F.substring_index(text, ";", 1)), F.array().cast(BONDS))


def parse_colors(text: Column) -> Column:
    body = F.substring(text, F.locate(";", text) + 1, F.length(text))
    return F.transform(F.filter(F.split(body, ","), lambda x: x != ""), lambda x: x.try_cast("int"))


def parse_labels(text: Column) -> Column:
    return F.from_json(F.substring(text, F.locate(";", text) + 1, F.length(text)), "array<string>")


def format_bonds(bonds: Column) -> Column:
    return F.array_join(F.flatten(F.transform(bonds, lambda b: F.array(b["src"].cast("string"), b["trg"].cast("string")))), ",")


def format_graph(bonds: Column, colors: Column) -> Column:
    return F.concat(format_bonds(bonds), F.lit(";"), F.array_join(F.transform(colors, lambda c: c.cast("string")), ","))


def gather(vertices: DataFrame, bonds: DataFrame, value: str) -> DataFrame:
    """graph_id, bonds (sorted by target, source) and the vertices' values in order."""
    v = vertices.groupBy("graph_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("v", value))), lambda x: x[value]).alias("values"))
    e = bonds.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("trg", "src"))).alias("e"))
    swapped = F.transform("e", lambda x: F.struct(x["src"].cast("int").alias("src"), x["trg"].cast("int").alias("trg")))
    return v.join(e, "graph_id", "left").select("graph_id", F.coalesce(swapped, F.array().cast(BONDS)).alias("bonds"), "values")
