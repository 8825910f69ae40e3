"""Connected components as alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.common import steady


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for the ends of ``edges (a, b)``; the component is its least node.

    Distributed union-find: every node hangs its larger neighbours under the least of its
    neighbourhood (large star), then its smaller ones and itself (small star), until nothing
    changes. The least neighbour is an aggregate, so a node with very many links is thinned
    before it moves. Every round is checkpointed. Ends are of one type that has an order,
    and not null; self links count as no link.
    """
    ahead = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = steady(ahead(edges))
    state = _state(links)
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = steady(ahead(large))
        under = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(under, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = steady(ahead(small.unionByName(under.select("a", F.col("m").alias("b")))))
        last, state = state, _state(links)
        if last == state:
            break
    roots = links.select(F.col("b").alias("a"), "b").distinct()
    return links.unionByName(roots).select(F.col("a").alias("node"), F.col("b").alias("component"))


def _state(links: DataFrame) -> tuple:
    """Two numbers that stay the same only when the links do."""
    print_ = F.xxhash64("a", "b")
    return tuple(links.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(print_), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64(print_)), F.lit(0))).first())
