"""Tables as files by keyword or suffix, and compressed JSON for models."""

from __future__ import annotations

import json
import zlib
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Format keywords and suffixes, and the reader's options for each.
FORMATS = {"csv": "csv", "tsv": "tsv", "parquet": "parquet", "pqt": "parquet"}


def format_of(path: str, keyword: str | None = None) -> str:
    """csv, tsv or parquet, by keyword (a leading dot and case don't matter) or by the path's suffix."""
    word = (keyword if keyword is not None else Path(path.rstrip("/")).suffix).lower().removeprefix(".")
    if word not in FORMATS:
        raise ValueError(f"no table format {word!r}; known are {', '.join(FORMATS)}")
    return FORMATS[word]


def load_table(spark: SparkSession, path: str, keyword: str | None = None) -> DataFrame:
    kind = format_of(path, keyword)
    if kind == "parquet":
        return spark.read.parquet(path)
    return spark.read.csv(path, sep="\t" if kind == "tsv" else ",", header=True, inferSchema=True, escape='"')


def save_table(df: DataFrame, path: str, keyword: str | None = None, one_file: bool = False) -> None:
    """Columns must be flat for csv and tsv. one_file brings all rows to one task: for results that are small."""
    kind = format_of(path, keyword)
    out = (df.coalesce(1) if one_file else df).write.mode("errorifexists")
    if kind == "parquet":
        out.parquet(path)
    else:
        out.csv(path, sep="\t" if kind == "tsv" else ",", header=True, escape='"')


def write_json(value: Any, path: str, spark: SparkSession | None = None) -> None:
    """One JSON value, compressed; with a session, where Spark writes (one row of a table), else in a local file."""
    data = zlib.compress(json.dumps(value).encode("utf-8"))
    if spark is None:
        Path(path).write_bytes(data)
    else:
        spark.createDataFrame([(bytearray(data),)], "value binary").coalesce(1).write.parquet(path)


def read_json(path: str, spark: SparkSession | None = None) -> Any:
    data = Path(path).read_bytes() if spark is None else bytes(spark.read.parquet(path).first()["value"])
    return json.loads(zlib.decompress(data))
