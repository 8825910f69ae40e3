"""Lines packed into slides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions.text import collapse, shorten

# Rows on a slide and characters in a row.
MAX_ROWS, ROW_CHARS = 12, 95
_FULL = MAX_ROWS + 1


def row_cost(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / ROW_CHARS).cast("int"))


def _take(state: Column, cost: Column) -> Column:
    """Rows used on the current slide and slides opened, after one more line."""
    opens = (state["used"] == 0) | (state["used"] + cost > MAX_ROWS)
    used = F.when(opens, cost).otherwise(state["used"] + cost)
    return F.struct(F.least(used, F.lit(_FULL)).alias("used"), (state["opened"] + opens.cast("int")).alias("opened"))


def _state(used: Column, opened: Column) -> Column:
    return F.struct(used.alias("used"), opened.alias("opened"))


def slide_chunks(lines: DataFrame, keys: Sequence[str], line_no: str, text: str, block: int = 1024) -> DataFrame:
    """Slide number of every line, filled greedily from the top.

    A slide in progress is one of fourteen states, so a block of lines is a table from state
    to state. Blocks are worked in parallel, their tables are chained, and each block is then
    numbered from the state it really starts in.
    """
    keys = list(keys)
    line = F.struct(F.col(line_no).alias("n"), row_cost(F.col(text)).alias("cost"), F.col(text).alias("text"))
    blocks = (
        lines.withColumn("__block", F.floor(F.col(line_no) / block))
        .groupBy(*keys, "__block")
        .agg(F.sort_array(F.collect_list(line)).alias("__lines"))
    )
    costs = F.transform("__lines", lambda l: l["cost"])
    table = F.transform(
        F.sequence(F.lit(0), F.lit(_FULL)),
        lambda s: F.aggregate(costs, _state(s, F.lit(0)), _take),
    )
    # Only what later blocks start from has to be known: the last block's table is not needed,
    # and a document of one block needs none.
    chained = (
        blocks.select(*keys, "__block", F.col("__lines.cost").alias("__costs"))
        .groupBy(*keys)
        .agg(F.max("__block").alias("__last"), F.min("__block").alias("__first"))
        .where("__last > __first")
    )
    tables = (
        blocks.join(chained, keys, "left_semi")
        .select(*keys, F.struct("__block", table.alias("__table")).alias("__t"))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list("__t")).alias("__tables"))
    )
    begin = F.struct(
        _state(F.lit(0), F.lit(0)).alias("now"),
        F.array().cast("array<struct<block:bigint,used:int,opened:int>>").alias("starts"),
    )

    def chain(acc: Column, t: Column) -> Column:
        after = F.get(t["__table"], acc["now"]["used"])
        here = F.struct(t["__block"].alias("block"), acc["now"]["used"].alias("used"), acc["now"]["opened"].alias("opened"))
        return F.struct(
            _state(after["used"], acc["now"]["opened"] + after["opened"]).alias("now"),
            F.concat(acc["starts"], F.array(here)).alias("starts"),
        )

    starts = tables.select(*keys, F.explode(F.aggregate("__tables", begin, chain, lambda a: a["starts"])).alias("__s")).select(
        *keys, F.col("__s.block").alias("__block"), F.col("__s.used").alias("__used"), F.col("__s.opened").alias("__opened")
    )
    placed = blocks.join(starts, [*keys, "__block"], "left")
    replay = F.aggregate(
        costs,
        F.struct(
            F.coalesce("__used", F.lit(0)).alias("used"), F.coalesce("__opened", F.lit(0)).alias("opened"),
            F.array().cast("array<int>").alias("out"),
        ),
        lambda acc, c: F.struct(
            _take(acc, c)["used"].alias("used"), _take(acc, c)["opened"].alias("opened"),
            F.concat(acc["out"], F.array(_take(acc, c)["opened"])).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return placed.select(
        *keys, F.explode(F.arrays_zip(F.col("__lines").alias("line"), replay.alias("chunk_no"))).alias("__z")
    ).select(*keys, F.col("__z.line.n").alias(line_no), F.col("__z.line.text").alias(text), "__z.chunk_no")


def slides(lines: DataFrame, keys: Sequence[str], line_no: str, text: str, first_line_as_title: bool = True) -> DataFrame:
    """Title and lines of every slide. Line numbers start at 0 within each page."""
    keys = list(keys)
    clean = lines.withColumn(text, collapse(F.col(text)))
    if first_line_as_title:
        titles = clean.where(F.col(line_no) == 0).select(*keys, shorten(F.col(text)).alias("__title"))
        body = clean.where(F.col(line_no) > 0)
    else:
        titles = clean.select(*keys).distinct().withColumn("__title", F.concat(F.lit("page "), F.col(keys[-1])))
        body = clean
    packed = slide_chunks(body, keys, line_no, text)
    counted = packed.groupBy(*keys, "chunk_no").agg(F.count(F.lit(1)).alias("n_lines"))
    full = titles.join(counted, keys, "left")
    return full.select(
        *keys,
        F.coalesce("chunk_no", F.lit(1)).alias("chunk_no"),
        F.when(F.col("chunk_no") > 1, F.concat("__title", F.lit(" (continued)"))).otherwise(F.col("__title")).alias("title"),
        F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
    )
