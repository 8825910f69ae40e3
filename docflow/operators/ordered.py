"""Running values over long ordered groups.

A plain window takes one shuffle and puts one key in one task, which is right for keys of
ordinary size. Where a key may hold a good part of the table, a caller names blocks of many
rows that follow the order: the window runs inside the blocks, and one row per block is
carried across them, so such a key is still spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLOCK = "__block"


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column | None = None,
    *,
    number: str | None = None,
    total: str | None = None,
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    lags: dict[str, Column] | None = None,
    leads: dict[str, Column] | None = None,
) -> DataFrame:
    """Add running columns per ``keys`` in ``order``.

    Without ``block`` this is one window per key. A ``block`` must never fall along ``order``
    and should hold thousands of rows. ``number`` counts rows from 1, ``total`` is
    the row count of the key, ``sums`` and ``maxes`` include the current row, ``lasts`` is
    the latest non-null value up to the current row, ``lags`` and ``leads`` are the
    neighbours' values. With blocks keys are not null and the input is read twice.
    """
    sums, maxes, lasts = dict(sums or {}), maxes or {}, lasts or {}
    lags, leads = lags or {}, leads or {}
    if block is None:
        return _plain(df, list(keys), order, number, total, sums, maxes, lasts, lags, leads)
    keys, position = list(keys), F.struct(*order)
    source = df.withColumn(_BLOCK, block)

    inside = Window.partitionBy(*keys, _BLOCK).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = source.select(
        "*",
        *([F.row_number().over(inside).alias("__n")] if number else []),
        *(F.sum(v).over(upto).alias(f"__s_{c}") for c, v in sums.items()),
        *(F.max(v).over(upto).alias(f"__m_{c}") for c, v in maxes.items()),
        *(F.last(v, ignorenulls=True).over(upto).alias(f"__l_{c}") for c, v in lasts.items()),
        *(F.lag(F.struct(v.alias("v"))).over(inside).alias(f"__p_{c}") for c, v in lags.items()),
        *(F.lead(F.struct(v.alias("v"))).over(inside).alias(f"__f_{c}") for c, v in leads.items()),
    )

    blocks = source.groupBy(*keys, _BLOCK).agg(
        F.count(F.lit(1)).alias("__rows"),
        *(F.sum(v).alias(f"__bs_{c}") for c, v in sums.items()),
        *(F.max(v).alias(f"__bm_{c}") for c, v in maxes.items()),
        *(F.max_by(v, F.when(v.isNotNull(), position)).alias(f"__bl_{c}") for c, v in lasts.items()),
        *(F.max_by(F.struct(v.alias("v")), position).alias(f"__bp_{c}") for c, v in lags.items()),
        *(F.min_by(F.struct(v.alias("v")), position).alias(f"__bf_{c}") for c, v in leads.items()),
    )
    across = Window.partitionBy(*keys).orderBy(_BLOCK)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carry = blocks.select(
        *keys,
        _BLOCK,
        *([F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__cn")] if number else []),
        *([F.sum("__rows").over(whole).alias(total)] if total else []),
        *(F.sum(f"__bs_{c}").over(before).alias(f"__cs_{c}") for c in sums),
        *(F.max(f"__bm_{c}").over(before).alias(f"__cm_{c}") for c in maxes),
        *(F.last(f"__bl_{c}", ignorenulls=True).over(before).alias(f"__cl_{c}") for c in lasts),
        *(F.lag(f"__bp_{c}").over(across).alias(f"__cp_{c}") for c in lags),
        *(F.lead(f"__bf_{c}").over(across).alias(f"__cf_{c}") for c in leads),
    )
    def plus(c: str) -> Column:
        own, prior = F.col(f"__s_{c}"), F.col(f"__cs_{c}")
        return F.when(prior.isNull(), own).when(own.isNull(), prior).otherwise(own + prior)

    return local.join(carry, [*keys, _BLOCK]).select(
        *df.columns,
        *([(F.col("__n") + F.col("__cn")).alias(number)] if number else []),
        *([F.col(total)] if total else []),
        *(plus(c).alias(c) for c in sums),
        *(F.greatest(f"__m_{c}", f"__cm_{c}").alias(c) for c in maxes),
        *(F.coalesce(f"__l_{c}", f"__cl_{c}").alias(c) for c in lasts),
        *(F.coalesce(f"__p_{c}", f"__cp_{c}")["v"].alias(c) for c in lags),
        *(F.coalesce(f"__f_{c}", f"__cf_{c}")["v"].alias(c) for c in leads),
    )


def _plain(df, keys, order, number, total, sums, maxes, lasts, lags, leads) -> DataFrame:
    whole = Window.partitionBy(*keys)
    line = whole.orderBy(*order)
    upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select(
        *df.columns,
        *([F.row_number().over(line).cast("bigint").alias(number)] if number else []),
        *([F.count(F.lit(1)).over(whole).alias(total)] if total else []),
        *(F.sum(v).over(upto).alias(c) for c, v in sums.items()),
        *(F.max(v).over(upto).alias(c) for c, v in maxes.items()),
        *(F.last(v, ignorenulls=True).over(upto).alias(c) for c, v in lasts.items()),
        *(F.lag(v).over(line).alias(c) for c, v in lags.items()),
        *(F.lead(v).over(line).alias(c) for c, v in leads.items()),
    )


def first_rows(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str]) -> DataFrame:
    """The first row per key. An aggregate, so map-side combining thins a hot key."""
    named = [k if isinstance(k, Column) else F.col(k) for k in keys]
    picked = df.groupBy(*named).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("__row"))
    return picked.select("__row.*")
