"""Searching and grouping a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.operators.ordered import running


def matches(catalog: DataFrame, text: str) -> DataFrame:
    """Rows whose title, description or category holds the text, ignoring case."""
    wanted = text.strip().lower()
    if not wanted:
        return catalog
    return catalog.where(F.lower(F.concat_ws(" ", "title", "description", "category")).contains(wanted))


def search(catalog: DataFrame, text: str) -> DataFrame:
    """Matching items per category; categories without one disappear."""
    return matches(catalog, text).groupBy("category").agg(
        F.count(F.lit(1)).alias("n_items"), F.min("id").alias("first_id")
    )


def groups(catalog: DataFrame) -> DataFrame:
    """Items in catalog order within their category, categories in order of first use.

    Categories are one row each when they are numbered, in blocks of 65,536 numbers where ids
    are numbers, of which one task sees one row each."""
    first = catalog.groupBy("category").agg(F.min("id").alias("first_id"))
    numeric = isinstance(first.schema["first_id"].dataType, T.NumericType)
    block = F.coalesce(F.floor(F.col("first_id") / 65536), F.lit(-(2**48))) if numeric else None
    ordered = running(first, [], ["first_id"], block, number="group_no")
    placed = running(catalog, ["category"], ["id"], number="position")
    return placed.join(ordered, "category").select("category", "group_no", "position", "id", "title")
