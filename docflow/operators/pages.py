"""Page plans, ranges, numbering and selections over tables of pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.operators.ordered import first_rows, running


def plan_violations(plan: DataFrame, sources: DataFrame) -> DataFrame:
    """Plan rows whose source is unknown or whose index is outside it."""
    joined = plan.join(sources, "source_id", "left")
    reason = (
        F.when(F.col("page_count").isNull(), "no_source")
        .when((F.col("page_index") < 0) | (F.col("page_index") >= F.col("page_count")), "page_out_of_range")
    )
    return joined.select("plan_id", "seq", reason.alias("reason")).where("reason IS NOT NULL")


def plan_resolve(plan: DataFrame, sources: DataFrame) -> DataFrame:
    """Pages of every plan that holds no violation, in plan order, rotation added. Rows of a
    plan are together once, for its verdict and for its numbers."""
    joined = plan.join(sources, "source_id", "left")
    ok = (F.col("page_index") >= 0) & (F.col("page_index") < F.col("page_count"))
    bad = F.max((~F.coalesce(ok, F.lit(False))).cast("int")).over(Window.partitionBy("plan_id"))
    numbered = running(joined.withColumn("__bad", bad).where("__bad = 0"), ["plan_id"], ["seq"], number="out_page")
    return numbered.select(
        "plan_id", "out_page", "source_id", "page_index",
        F.pmod(F.col("base_rotation") + F.col("rotation"), F.lit(360)).alias("rotation"),
    )


def rotation_total(ops: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rotations of a page added up into 0..270; a step that is no quarter turn is refused."""
    return (
        ops.groupBy(*keys)
        .agg(
            F.sum("degrees").alias("__sum"),
            F.max((F.col("degrees") % 90 != 0).cast("int")).alias("__bad"),
        )
        .where("__bad = 0")
        .select(*keys, F.pmod(F.col("__sum"), F.lit(360)).cast("int").alias("rotation"))
    )


def parse_ranges(requests: DataFrame, keys: Sequence[str], expr: str, page_count: str | None = None) -> DataFrame:
    """One row per part of a page-range text, with first, last and the reason if it is bad."""
    dash, whole = "[-–—]", r"\+?\d{1,18}"
    bare = lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")
    parts = F.filter(F.transform(F.split(F.coalesce(expr, F.lit("")), r"[,;\n\r]"), bare), lambda p: p != "")
    listed = F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit(None).cast("string")))

    # A dash always parts two numbers, so a number never has a minus sign.
    def read(p: Column) -> Column:
        number = lambda pattern: F.regexp_extract(p, pattern, 1).try_cast("int")
        return F.struct(
            p.alias("part"),
            F.regexp_count(p, F.lit(dash)).alias("dashes"),
            number(rf"^\s*({whole})\s*(?:{dash}|$)").alias("a"),
            number(rf"{dash}\s*({whole})\s*$").alias("b"),
        )

    def check(t: Column) -> Column:
        first, last = t["a"], F.when(t["dashes"] == 1, t["b"]).otherwise(t["a"])
        reason = (
            F.when(t["part"].isNull(), "empty")
            .when(t["dashes"] > 1, "bad_range")
            .when(first.isNull() | (first < 1), "bad_number")
            .when(last.isNull() | (last < 1), "bad_last_number")
            .when(first > last, "reversed")
        )
        if page_count:
            reason = reason.when(last > F.col(page_count), "past_end")
        kept = reason.isNull() | (reason == "past_end")
        return F.struct(
            t["part"].alias("part"), F.when(kept, first).alias("first"), F.when(kept, last).alias("last"), reason.alias("reason")
        )

    # Checked before the parts become rows: a filter on the outcome then reads a value and
    # does not parse again.
    checked = F.transform(F.transform(listed, read), check)
    return requests.select(*keys, F.posexplode(checked).alias("pos", "__p")).select(*keys, "pos", "__p.*")


def range_pages(ranges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Pages of each range. Ranges unfold into pages, so overlapping and repeated ranges keep
    all their rows and no pair is ever compared. ``sources`` bounds them by page count;
    ranges that were parsed with one are bounded already."""
    bounded = ranges.where("first >= 1 AND first <= last")
    if sources is not None:
        bounded = bounded.join(sources.select("source_id", "page_count"), "source_id").where("last <= page_count")
    return bounded.select(
        "source_id", "part_no", "first", "last", F.explode(F.sequence("first", "last")).alias("page_no")
    )


def part_name(prefix: Column, first: Column, last: Column) -> Column:
    clean = F.regexp_replace(F.trim(prefix), r'[<>:"/\\|?*\x00-\x1f]', "_")
    stem = F.when(clean == "", "document").otherwise(clean)
    return F.when(first == last, F.concat(stem, F.lit("_"), first.cast("string"), F.lit(".pdf"))).otherwise(
        F.concat(stem, F.lit("_"), first.cast("string"), F.lit("-"), last.cast("string"), F.lit(".pdf"))
    )


def cascade_delete(pages: DataFrame, removed: DataFrame, source: str) -> DataFrame:
    """Drop all pages of removed sources, whatever the case of their names."""
    gone = removed.select(F.lower(source).alias("__gone")).distinct()
    return pages.join(gone, F.lower(pages[source]) == F.col("__gone"), "left_anti")


def page_numbers(pages: DataFrame, totals: DataFrame, keys: Sequence[str], start: int, skip: int, template: str) -> DataFrame:
    """Label pages ``start``, ``start+1`` ... after the first ``skip``; ``{0}`` is the number,
    ``{1}`` how many pages are numbered. ``totals`` has the page count per document."""
    shown = template if template.strip() else "{0}"
    number = F.lit(start) + F.col("page_no") - 1 - skip
    numbered = F.greatest(F.lit(0), F.col("page_count") - skip)
    label = F.replace(
        F.replace(F.lit(shown), F.lit("{0}"), number.cast("string")), F.lit("{1}"), numbered.cast("string")
    )
    return pages.join(totals, list(keys)).select(
        *keys, "page_no", F.when(F.col("page_no") > skip, label).alias("label")
    )


def merge_sequence(files: DataFrame, pages: DataFrame) -> DataFrame:
    """Page numbers of a merged document. Offsets add up over files, never over pages."""
    offsets = running(
        files, ["merge_id"], ["file_seq"], F.floor(F.col("file_seq") / 1024), sums={"__upto": F.col("page_count")}
    ).withColumn("__before", F.col("__upto") - F.col("page_count"))
    return offsets.join(pages, "source_id").select(
        "merge_id", "file_seq", "source_id", "page_no",
        (F.col("__before") + F.col("page_no")).alias("out_page"),
    )


def fixed_chunks(sources: DataFrame, size: int) -> DataFrame:
    """Chunks of ``size`` pages; the last one ends with the document."""
    if size < 1:
        raise ValueError("pages per file must be at least 1")
    starts = F.sequence(F.lit(0), F.floor((F.col("page_count") - 1) / size))
    rows = sources.where("page_count > 0").select("source_id", "page_count", F.explode(starts).alias("k"))
    return rows.select(
        "source_id",
        (F.col("k") + 1).alias("chunk_no"),
        (F.col("k") * size + 1).alias("first"),
        F.least(F.col("k") * size + size, "page_count").alias("last"),
    )


def keep_list(pages: DataFrame, keep: DataFrame, keys: Sequence[str], index: str) -> DataFrame:
    """Exactly the listed pages in list order: delete and reorder in one."""
    return keep.join(pages, [*keys, index])


def removed_pages(pages: DataFrame, keep: DataFrame, keys: Sequence[str], index: str) -> DataFrame:
    return pages.join(keep.select(*keys, index).distinct(), [*keys, index], "left_anti")


def distinct_ci(rows: DataFrame, column: str, seq: Sequence[str]) -> DataFrame:
    """Distinct values ignoring case; the first spelling stays."""
    return first_rows(rows.where(F.col(column).isNotNull()), [F.lower(column)], seq)


def mixed_sources(pages: DataFrame, keys: Sequence[str], source: str) -> DataFrame:
    """Flag pages of documents that draw on more than one source, ignoring case."""
    low = F.lower(source)
    spread = pages.groupBy(*keys).agg((F.min(low) < F.max(low)).alias("mixed"))
    return pages.join(spread, list(keys))


def invert_and_delete(pages: DataFrame) -> DataFrame:
    """Invert the selection, then delete what is selected."""
    return pages.withColumn("selected", ~F.col("selected")).where(~F.col("selected"))


def selection_summary(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    from docflow.functions.text import size_label

    return items.groupBy(*keys).agg(
        F.count_if("selected").alias("selected"),
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("selected"), F.col("size_bytes"))), F.lit(0)).alias("bytes"),
    ).withColumn("label", size_label(F.col("bytes")))


def merge_union(*parts: DataFrame) -> DataFrame:
    """All rows of all sources; duplicates stay."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def compression_report(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bytes before and after; a result that grew counts as the original."""
    summed = results.groupBy(*keys).agg(
        F.sum("original").alias("original"), F.sum(F.least("original", "packed")).alias("stored")
    )
    saved = (F.col("original") - F.col("stored")) * 100.0 / F.col("original")
    return summed.withColumn("saved_pct", F.when(F.col("original") > 0, F.bround(saved, 1)).otherwise(0.0))


def reading_order(blocks: DataFrame, keys: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """Position of each block on its page, from the top and then from the left."""
    return running(
        blocks, keys, ["top", "left", *ties], number="position"
    )
