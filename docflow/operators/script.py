"""Corpus operators over text in two scripts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions import script as S
from docflow.operators.ordered import running
from docflow.sources.placing import settle

SAMPLE_LENGTH = 4000


def script_census(docs: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Letters per script and the direction they call for, per group."""
    n_cyr, n_lat = S.script_counts(F.col(text))
    return (
        docs.groupBy(*keys)
        .agg(F.sum(n_cyr).alias("n_cyr"), F.sum(n_lat).alias("n_lat"))
        .withColumn("direction", S.direction_of(F.col("n_cyr"), F.col("n_lat")))
    )


def transliterate_corpus(
    docs: DataFrame, text: str, given: str = S.CYR_TO_LAT, auto: bool = True, style: str = "ascii"
) -> DataFrame:
    """Convert every text; without letters to judge by, the given direction stays."""
    chosen = F.lit(given)
    if auto:
        chosen = F.coalesce(S.direction_of(*S.script_counts(F.col(text))), chosen)
    return docs.withColumn("direction", chosen).select(
        *(c for c in docs.columns if c != text),
        "direction",
        S.transliterate(F.col(text), F.col("direction"), style).alias(text),
        F.length(text).alias("n_chars"),
    )


def cyrillic_documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", S.latin_to_cyrillic(F.col("text")))


def roundtrip_quality(docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of texts that come back unchanged from Latin to Cyrillic to Latin."""
    back = S.cyrillic_to_latin(F.col("__cyr"))
    same = docs.withColumn("__cyr", S.latin_to_cyrillic(F.col("text"))).withColumn(
        "__same", (back == F.col("text")).cast("int")
    )
    return (
        same.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum("__same").alias("n_equal"))
        .withColumn("share", F.bround(F.col("n_equal") / F.col("n_docs"), 6))
    )


def sample_prefix(runs: DataFrame, doc: str, order: Sequence[str], group: str, limit: int = SAMPLE_LENGTH) -> DataFrame:
    """Detection sample: leading runs until the limit is reached, a space after each group.

    ``order`` starts with the group's position. Only runs that start below the limit are
    gathered, so a sample never holds more than the limit plus one run.
    """
    spaced = running(
        runs,
        [doc],
        order,
        F.floor(F.col(order[0]) / 256),
        leads={"__next": F.col(group)},
        sums={"__upto": F.length("text")},
    )
    # Each group before this one added a space.
    ends = F.col("__next").isNull() | (F.col("__next") != F.col(group))
    counted = running(
        settle(spaced.withColumn("__ends", ends)), [doc], order, F.floor(F.col(order[0]) / 256),
        sums={"__spaces": F.col("__ends").cast("int")},
    )
    before = F.col("__upto") + F.col("__spaces") - F.length("text") - F.col("__ends").cast("int")
    reached = F.col("__upto") + F.col("__spaces") - F.col("__ends").cast("int") >= limit
    piece = F.concat("text", F.when(F.col("__ends") & ~reached, " ").otherwise(""))
    # Pieces without a letter or space add nothing, so what is gathered is as long as the sample.
    pieces = F.collect_list(F.when(F.length(piece) > 0, F.struct(*order, piece.alias("piece"))))
    return (
        counted.where(before < limit)
        .groupBy(doc)
        .agg(F.sort_array(pieces).alias("p"))
        .select(doc, F.array_join(F.col("p.piece"), "").alias("sample"))
    )


def convert_runs(runs: DataFrame, keys: Sequence[str], seq: str, direction: str, style: str = "ascii") -> DataFrame:
    """Convert each paragraph as a whole and hand the pieces back to its runs.

    A paragraph is one line of a document, so its runs fit one row.
    """
    before = Window.partitionBy(*keys, direction).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    size = F.coalesce(F.length("text"), F.lit(0))
    places = runs.withColumn("__at", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("int"))
    cells = F.sort_array(F.collect_list(F.struct(F.col(seq).alias("seq"), "text", F.col("__at").alias("at"), size.alias("n"))))
    joined = places.groupBy(*keys, direction).agg(cells.alias("__runs")).withColumn(
        "__all", F.array_join(F.col("__runs.text"), "")
    )
    aligned, finish = S.slice_converter(F.col("__all"), F.col(direction), style)
    # The text is converted once per paragraph and cut there; only finished pieces become rows.
    converted = joined.select(*keys, direction, aligned.alias("__cells"), "__runs")
    piece = lambda r: F.struct(r["seq"].alias("seq"), finish(F.col("__cells"), r["at"], r["n"]).alias("text"))
    rows = converted.select(*keys, F.explode(F.transform("__runs", piece)).alias("__r"))
    return rows.select(*keys, F.col("__r.seq").alias(seq), F.col("__r.text").alias("text"))


def segments_to_runs(segments: DataFrame, runs: DataFrame, keys: Sequence[str], block: int = 4096) -> DataFrame:
    """Backward as-of join: each segment goes to the last run that starts at or before it."""
    both = segments.select(
        *keys, F.col("start").alias("__at"), F.lit(1).alias("__side"),
        F.col("text"), F.lit(None).cast(runs.schema["run_id"].dataType).alias("__run"),
    ).unionByName(
        runs.select(
            *keys, F.col("start").alias("__at"), F.lit(0).alias("__side"),
            F.lit(None).cast("string").alias("text"), F.col("run_id").alias("__run"),
        )
    )
    found = running(
        both, keys, ["__at", "__side", "__run"], F.floor(F.col("__at") / block), lasts={"run_id": F.col("__run")}
    )
    return found.where("__side = 1").select(*keys, F.col("__at").alias("start"), "run_id", "text")
