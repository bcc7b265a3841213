"""Canonical columns of a model's input, and named features as JSON at file edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import numbered

FEATURES = "array<struct<name:string,count:bigint>>"
#: Row states in order of severity.
STATES = ("NONE", "PARSE", "COLOR", "PARTITION", "FILTER")


def state_rank(state: Column) -> Column:
    return reduce(lambda out, k: F.when(state == STATES[k], k).otherwise(out), range(len(STATES)), F.lit(None).cast("int"))


def canonical_columns(df: DataFrame, data: str, group: str | None = None, weight: str | None = None, features: str | None = None, targets: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """data, group, weight, filter, extern_feat and a value_<target> each.

    Empty data is null, a missing weight 1. Without a group column every row is a group of its own, numbered from 0 by
    `order`, a column that tells rows apart, or else by any distinct numbers.
    """
    number = F.monotonically_increasing_id()
    if order and not group:
        df, number = numbered(df, "_number", order), F.col("_number")
    feats = F.lit(None).cast(FEATURES)
    if features:
        feats = F.col(features) if df.schema[features].dataType.simpleString().startswith("array") else decode_features(F.col(features))
    return df.select(
        F.nullif(F.col(data).cast("string"), F.lit("")).alias("data"),
        (F.col(group) if group else number).cast("bigint").alias("group"),
        (F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)).alias("weight"),
        F.lit("NONE").alias("filter"),
        feats.alias("extern_feat"),
        *(F.col(t).cast("double").alias(f"value_{t}") for t in targets),
    )


def encode_features(features: Column) -> Column:
    return F.to_json(F.struct(features.alias("extern_feat")), {"ignoreNullFields": "false"})


def decode_features(text: Column) -> Column:
    return F.from_json(text, f"extern_feat {FEATURES}")["extern_feat"]
