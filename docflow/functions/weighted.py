"""Medians over arrays of (value, weight) pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def weighted_median(pairs: Column) -> Column:
    """Median of ``array<struct<v double, n bigint>>`` where each value counts n times; the
    two middle values are averaged. Null for an empty array."""
    ordered = F.sort_array(pairs)
    total = F.aggregate(pairs, F.lit(0).cast("bigint"), lambda acc, p: acc + p["n"])
    start = F.struct(
        F.lit(0).cast("bigint").alias("seen"), total.alias("total"),
        F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
    )

    def step(acc: Column, p: Column) -> Column:
        seen = acc["seen"] + p["n"]
        pick = lambda have, rank: F.when(have.isNull() & (seen > rank), p["v"]).otherwise(have)
        return F.struct(
            seen.alias("seen"), acc["total"].alias("total"),
            pick(acc["low"], F.floor((acc["total"] - 1) / 2)).alias("low"),
            pick(acc["high"], F.floor(acc["total"] / 2)).alias("high"),
        )

    # Mostly all values are equal, and then there is nothing to count.
    values = F.transform(pairs, lambda p: p["v"])
    same = F.array_min(values) == F.array_max(values)
    counted = F.aggregate(ordered, start, step, lambda acc: (acc["low"] + acc["high"]) / 2)
    return F.when(same, F.array_min(values)).otherwise(counted)


def median(values: Column) -> Column:
    """Median of an array of doubles without nulls, null for an empty one."""
    middle = lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2
    # Bound to a name, the array is sorted once.
    return F.get(F.transform(F.array(F.sort_array(values)), middle), F.lit(0))


def breaks_to_slices(items: Column, breaks: Column) -> Column:
    """Cut an array at the given 0-based positions into an array of slices."""
    # Both are bound to a name, so that they are worked out once and not once per slice.
    known = F.array(F.struct(items.alias("i"), F.concat(F.array(F.lit(0)), breaks).alias("b")))

    def cut(z: Column) -> Column:
        end = lambda k: F.coalesce(F.get(z["b"], k), F.size(z["i"]))
        return F.transform(
            F.sequence(F.lit(1), F.size(z["b"])), lambda k: F.slice(z["i"], F.get(z["b"], k - 1) + 1, end(k) - F.get(z["b"], k - 1))
        )

    return F.get(F.transform(known, cut), F.lit(0))
