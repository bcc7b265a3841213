"""Arithmetic of log-weights as columns and over groups; ln 0 is minus infinity, as Spark's own ln gives null there."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INF = float("inf")


def ln(x: Column) -> Column:
    return F.when(x == 0, F.lit(-INF)).otherwise(F.ln(x))


def logsumexp(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """One row per group with ln of the sum of exp; a group of minus infinities gives minus infinity."""
    top = F.max(value).over(Window.partitionBy(*keys))
    shifted = df.withColumn("_top", top).withColumn("_part", F.when(F.col("_top") == -INF, 0.0).otherwise(F.exp(F.col(value) - F.col("_top"))))
    return shifted.groupBy(*keys).agg((ln(F.sum("_part")) + F.max("_top")).alias(name))


def normalized_logs(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Log-weights that sum to 1 in each group: any NaN makes all NaN, plus infinities share all, only minus infinities share alike."""
    w = Window.partitionBy(*keys)
    nan, infinite = F.max(F.isnan(value)).over(w), F.sum(F.when(F.col(value) == INF, 1).otherwise(0)).over(w)
    n, top = F.count(value).over(w), F.max(value).over(w)
    df = df.withColumns({"_nan": nan, "_inf": infinite, "_n": n, "_top": top})
    part = F.when((F.col("_top") == -INF) | (F.col("_top") == INF) | F.col("_nan"), 0.0).otherwise(F.exp(F.col(value) - F.col("_top")))
    df = df.withColumn("_sum", F.sum(part).over(w))
    out = (
        F.when(F.col("_nan"), F.lit(float("nan")))
        .when(F.col("_inf") > 0, F.when(F.col(value) == INF, -F.ln(F.col("_inf"))).otherwise(-INF))
        .when(F.col("_top") == -INF, -F.ln(F.col("_n")))
        .otherwise(F.col(value) - F.col("_top") - F.ln(F.col("_sum")))
    )
    return df.withColumn(name, out).drop("_nan", "_inf", "_n", "_top", "_sum")


def ln_bell(n: Column) -> Column:
    """The usual upper estimate of ln of the n-th Bell number."""
    return F.when(n > 0, n * (F.ln(0.792 * n) - F.ln(F.ln(n + 1)))).otherwise(0.0)


def ln_factorials(most: int) -> list[float]:
    """ln n! for n up to `most`."""
    return [math.lgamma(n + 1) for n in range(most + 1)]


def ln_bell_ratio(n: Column, m: Column, count: Column) -> Column:
    """ln_bell(n) less ln_bell(m), plus ln of a count."""
    return ln_bell(n) - ln_bell(m) + ln(count)


#: Largest n of the tables below.
LARGEST = 1000


def _looked_up(values: list[float], n: Column) -> Column:
    return F.when(n < len(values), F.element_at(F.array(*map(F.lit, values)), F.greatest(n, F.lit(0)).cast("int") + 1))


def ln_factorial(n: Column, most: int = LARGEST) -> Column:
    """ln n!; 0 below 1, null above `most`."""
    return _looked_up(ln_factorials(most), n)


def ln_odd_factorial(n: Column, most: int = LARGEST) -> Column:
    """ln (2n - 1)!!, the number of ways to pair 2n things; 0 below 2, null above `most`."""
    return _looked_up([0.0 if k < 2 else k * math.log(2) - math.log(math.pi) / 2 + math.lgamma(k + 0.5) for k in range(most + 1)], n)


# Connected graphs of 0 to 19 vertices, not told apart by names.
CONNECTED_GRAPHS = (
    1, 1, 1, 2, 6, 21, 112, 853, 11117, 261080, 11716571, 1006700565, 164059830476, 50335907869219, 29003487462848061, 31397381142761241960,
    63969560113225176176277, 245871831682084026519528568, 1787331725248899088890200576580, 24636021429399867655322650759681644,
)


def connected_graphs(n: Column) -> Column:
    """How many connected graphs of n vertices there are, as a double; null beyond the table."""
    return F.when(n >= 0, _looked_up([float(x) for x in CONNECTED_GRAPHS], n))


def shares_of_counts(df: DataFrame, value: str, name: str) -> DataFrame:
    """ln of each row's share of all rows' `value`, a count."""
    total = df.agg(F.sum(value).alias("_total"))
    return df.crossJoin(F.broadcast(total)).withColumn(name, ln(F.col(value) / F.col("_total"))).drop("_total")
