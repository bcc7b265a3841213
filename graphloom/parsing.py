"""From a row's graph text to labels and bonds: one graph a row, or a weighted graph for each way to read it."""

from __future__ import annotations

import json
import math
from collections import Counter
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import graphtext
from .functions.features import FEATURES, STATES
from .operators.bonded import canonical_typed

#: Readings of a row, at most.
MOST_READINGS = 4096
_READINGS = f"array<struct<weight_ug:double,labels:array<string>,bonds:{graphtext.BONDS}>>"


def _tagged(rows: DataFrame, bad: Column) -> DataFrame:
    state = F.col("filter") if "filter" in rows.columns else F.lit(STATES[0])
    return rows.withColumn("filter", F.when((state == "NONE") & F.coalesce(bad, F.lit(True)), "PARSE").otherwise(state))


def _given() -> Column:
    return F.size(F.coalesce("extern_feat", F.array().cast(FEATURES))) > 0


def parsed(rows: DataFrame) -> DataFrame:
    """Labels and bonds of each row's graph text; text that names no vertex labels, or bonds beyond them, is tagged PARSE."""
    rows = rows.withColumns({"labels": graphtext.parse_labels(F.col("data")), "bonds": graphtext.parse_bonds(F.col("data"))})
    n = F.coalesce(F.size("labels"), F.lit(0))
    wrong = F.exists("bonds", lambda b: b["src"].isNull() | b["trg"].isNull() | (b["src"] >= n) | (b["trg"] >= n) | (b["src"] < 0) | (b["trg"] < 0))
    return _tagged(rows, F.when(F.col("data").isNull(), ~_given()).otherwise(F.col("labels").isNull() | (n == 0) | wrong))


def readings(data: str | None, most: int = MOST_READINGS) -> list[dict] | None:
    """The graphs that a text may mean, with their shares; None if it can't be read, or in more than `most` ways.

    A label may be a list of alternatives; every choice is as likely as any other, and choices that give isomorphic
    graphs are one graph, in its canonical order. Graphs come in the order in which choices first give them, the last
    vertex's alternatives changing first.
    """
    if data is None:
        return None
    pairs, _, labels = data.partition(";")
    try:
        ends, names = [int(x) for x in pairs.split(",") if x], json.loads(labels)
    except ValueError:
        return None
    if not isinstance(names, list) or not names or len(ends) % 2 or not all(0 <= v < len(names) for v in ends):
        return None
    choices = [x if isinstance(x, list) else [x] for x in names]
    if not all(choices) or not all(isinstance(x, str) for c in choices for x in c) or math.prod(map(len, choices)) > most:
        return None
    bonds = list(zip(ends[::2], ends[1::2], strict=True))
    found = Counter(canonical_typed(list(c), bonds) for c in product(*choices))
    out = []
    for text, n in found.items():
        pairs, _, labels = text.partition(";")
        ends = [int(x) for x in pairs.split(",") if x]
        out.append({"weight_ug": n / found.total(), "labels": json.loads(labels), "bonds": [{"src": a, "trg": b} for a, b in zip(ends[::2], ends[1::2], strict=True)]})
    return out


def parsed_alternatives(rows: DataFrame, most: int = MOST_READINGS) -> DataFrame:
    """A row for each graph that a row's text may mean: group_norm (from 0), weight_ug (shares that sum to 1), labels, bonds.

    See `readings`. A row without text, or whose text can't be read, stays one row, the latter tagged PARSE.
    """
    read = F.udf(lambda data: readings(data, most), _READINGS, useArrow=True)
    found = rows.withColumn("_found", read("data"))
    bad = F.when(F.col("data").isNull(), ~_given()).otherwise(F.col("_found").isNull())
    each = _tagged(found, bad).select("*", F.posexplode_outer("_found").alias("_norm", "_graph")).drop("_found")
    out = each.withColumns({"group_norm": F.coalesce("_norm", F.lit(0)), "weight_ug": F.coalesce("_graph.weight_ug", F.lit(1.0)), "labels": F.col("_graph.labels"), "bonds": F.coalesce("_graph.bonds", F.array().cast(graphtext.BONDS))})
    return out.drop("_norm", "_graph")
