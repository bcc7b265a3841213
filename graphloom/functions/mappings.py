"""Partial index mappings as arrays: place i holds what i is mapped to, or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inverse(m: Column) -> Column:
    """Defined up to the largest value; of two sources of one target, the first."""
    top = F.coalesce(F.array_max(m), F.lit(-1))
    places = F.when(top >= 0, F.sequence(F.lit(0), top)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda t: F.nullif(F.array_position(m, t) - 1, F.lit(-1)).cast("int"))


def compose(outer: Column, inner: Column) -> Column:
    """inner first: place i holds outer[inner[i]]."""
    return F.transform(inner, lambda x: F.when(x.isNotNull() & (x < F.size(outer)), F.get(outer, x)))


def permute(m: Column, values: Column) -> Column:
    return F.transform(m, lambda x: F.get(values, x))


def is_permutation(m: Column) -> Column:
    return F.coalesce(F.array_sort(m) == F.transform(F.array_sort(m), lambda x, i: i), F.lit(False))


def identity(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def identity_minus(n: Column, i: Column) -> Column:
    """The identity of n places without the one to i."""
    return F.filter(identity(n), lambda x: x != i)


def append(m: Column, i: Column) -> Column:
    """One place more, which is mapped to i."""
    return F.concat(m, F.array(i.cast("int")))


def subst(m: Column, place: Column, i: Column) -> Column:
    """`place` mapped to i instead."""
    return F.transform(m, lambda x, k: F.when(k == place, i.cast("int")).otherwise(x))
