"""Values on a grid: scaling, bounds, smoothing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Smallest usable range, what counts as visible, widest kernel.
MIN_RANGE, VISIBLE, MAX_RADIUS = 1e-6, 8, 32


def minmax_scale(values: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Scale each group to 0..255. Broken values count as the minimum; a group without a
    range keeps its raw values, clamped to 0..1."""
    usable = F.when(~F.isnan(value), F.col(value).cast("double"))
    ends = values.groupBy(*keys).agg(F.min(usable).alias("__lo"), F.max(usable).alias("__hi"))
    spread = F.col("__hi") - F.col("__lo")
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    raw = unit(F.coalesce(usable, F.lit(0.0)))
    scaled = unit((F.coalesce(usable, F.col("__lo")) - F.col("__lo")) / spread)
    flat = spread.isNull() | (spread <= MIN_RANGE) | (spread == float("inf"))
    return values.join(ends, list(keys)).withColumn(
        "scaled", F.bround(F.when(flat, raw).otherwise(scaled) * 255).cast("int")
    ).drop("__lo", "__hi")


def visible_bounds(cells: DataFrame, keys: Sequence[str], value: str, width: int, height: int) -> DataFrame:
    """Box around the visible cells; right and bottom lie outside. Nothing visible is the whole."""
    seen = lambda c: F.when(F.col(value) > VISIBLE, F.col(c))
    return cells.groupBy(*keys).agg(
        F.coalesce(F.min(seen("x")), F.lit(0)).cast("int").alias("left"),
        F.coalesce(F.min(seen("y")), F.lit(0)).cast("int").alias("top"),
        F.coalesce(F.max(seen("x")) + 1, F.lit(width)).cast("int").alias("right"),
        F.coalesce(F.max(seen("y")) + 1, F.lit(height)).cast("int").alias("bottom"),
    )


def kernel(radius: float) -> list[float]:
    """Normalised Gauss weights from -r to r; empty when there is nothing to smooth."""
    r = min(math.ceil(radius), MAX_RADIUS)
    if r < 1:
        return []
    sigma = max(0.35, radius)
    weights = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-r, r + 1)]
    return [w / sum(weights) for w in weights]


def _smooth(cells: DataFrame, keys: Sequence[str], axis: str, length: int, value: str, weights: list[float]) -> DataFrame:
    """One pass along an axis. Every cell hands its share to the cells around it, the two
    ends also what would fall outside, and an aggregate adds the shares up."""
    r = len(weights) // 2
    at = F.col(axis)
    share = lambda target, w, on: F.when(on, F.struct(target.cast("int").alias("to"), F.lit(w).alias("w")))
    inside = [share(at - k, weights[k + r], (at - k >= 0) & (at - k < length)) for k in range(-r, r + 1)]
    ends = []
    for i in range(min(r, length)):
        ends.append(share(F.lit(i), sum(weights[k + r] for k in range(-r, -i)), at == 0))
        ends.append(share(F.lit(length - 1 - i), sum(weights[k + r] for k in range(i + 1, r + 1)), at == length - 1))
    shares = F.filter(F.array(*inside, *ends), lambda s: s.isNotNull())
    others = [k for k in keys if k != axis]
    return (
        cells.select(*others, F.col(value).alias("__v"), F.explode(shares).alias("__s"))
        .groupBy(*others, F.col("__s.to").alias(axis))
        .agg(F.sum(F.col("__v") * F.col("__s.w")).alias(value))
    )


def gaussian_smooth(cells: DataFrame, keys: Sequence[str], value: str, width: int, height: int, radius: float) -> DataFrame:
    """Smooth along x and then y, clamped at the edges, back to 0..255."""
    weights = kernel(radius)
    place = [*keys, "x", "y"]
    if not weights:
        return cells.select(*place, F.col(value).cast("int").alias(value))
    floats = cells.select(*place, F.col(value).cast("double").alias(value))
    across = _smooth(floats, place, "x", width, value, weights)
    both = _smooth(across, place, "y", height, value, weights)
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.bround(value)))
    return both.select(*keys, "x", "y", clamped.cast("int").alias(value))
