"""Jobs over plain text: cleaning, list markers, fonts, long lists, logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.functions import text as X


def clean_corpus(docs: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """What cleaning does to the texts of each group."""
    raw, clean = F.col(text), F.col("__clean")
    cleaned = docs.withColumn("__clean", X.collapse(raw))
    return cleaned.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if(clean != raw).alias("n_changed"),
        F.count_if(F.length(clean) > 4000).alias("n_cut_slide"),
        F.count_if(F.length(raw) > 32000).alias("n_cut_cell"),
        F.sum(F.length(X.slide_text(raw))).alias("slide_chars"),
        F.sum(F.length(X.cell_text(raw))).alias("cell_chars"),
        F.sum(F.length(X.shorten(clean))).alias("title_chars"),
        F.bround(F.avg((clean != raw).cast("int")), 6).alias("share_changed"),
    )


def list_markers(lines: DataFrame, text: str) -> DataFrame:
    kind = X.marker_kind(F.col(text))
    return lines.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n_lines"))


def font_usage(fonts: DataFrame, raw: str) -> DataFrame:
    return fonts.groupBy(X.font_family(F.col(raw)).alias("family")).agg(F.count(F.lit(1)).alias("n"))


def head_tail(lines: DataFrame, keys: Sequence[str], line_no: str, text: str, most: int = 14, head: int = 8, tail: int = 3) -> DataFrame:
    """Long lists as their first and last lines around a row that tells how many are left out.

    Line numbers run from 0 without a gap, so a count per list is all that is needed.
    """
    sizes = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    kept = lines.join(sizes, list(keys)).where(
        (F.col("__n") <= most) | (F.col(line_no) < head) | (F.col(line_no) >= F.col("__n") - tail)
    )
    left = sizes.where(F.col("__n") > most).select(
        *keys, F.lit(head).alias(line_no), F.concat(F.lit("… "), F.col("__n") - head - tail, F.lit(" more")).alias(text)
    )
    return kept.select(*keys, line_no, text).unionByName(left)


def log_rollup(logs: DataFrame, line: str) -> DataFrame:
    """Log lines per hour and kind of message; numbers do not make a new kind."""
    stamp = F.try_to_timestamp(
        F.regexp_extract(line, r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)  ", 1), F.lit("yyyy-MM-dd HH:mm:ss")
    )
    message = F.regexp_replace(F.regexp_extract(line, r"(?s)^\S+ \S+  (.*)$", 1), r"\d+", "#")
    return (
        logs.select(F.date_trunc("hour", stamp).alias("hour"), message.alias("kind"))
        .where("hour IS NOT NULL")
        .groupBy("hour", "kind")
        .agg(F.count(F.lit(1)).alias("n"))
    )
