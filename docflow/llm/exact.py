"""Exact dedup: runs of digests merged level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm.common import LOWER, UPPER, documents, lower_ascii, query, row_key, steady

_TEXT = ["digest", "size", "check"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, SHA-256 of its text with A-Z in lower case, and the
    length and a second hash that confirm equality of digests. Null counts as empty."""
    text = docs.select(F.col(id_col).alias("doc_id"), lower_ascii(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    return text.select(
        "doc_id", F.unhex(F.sha2("t", 256)).alias("digest"), F.octet_length("t").alias("size"), F.xxhash64("t").alias("check")
    )


def merge_runs(rows: DataFrame, runs: int = 512, fan_in: int = 8) -> DataFrame:
    """One row per distinct text with the id that stays and the number of rows.

    Every input partition is a run. A run is sorted by digest and holds a digest once. At
    each level ``fan_in`` runs meet and are merged in digest order, which keeps one row per
    digest with its largest id, until one logical run is left. A level is dealt by digest
    within its group of runs, so also the last one is spread over all tasks, and a text that
    makes up a third of the table is one row per run after the first level. Digests only
    count as equal with equal length and second hash.
    """
    level = rows.select((F.spark_partition_id() % runs).alias("run"), *_TEXT, F.struct("doc_id").alias("best"), F.lit(1).cast("bigint").alias("n"))
    groups = runs
    # An aggregate over a struct is planned as sort and merge, as runs ask for.
    level = level.groupBy("run", *_TEXT).agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    while groups > 1:
        groups = -(-groups // fan_in)
        met = level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        level = met.groupBy("run", *_TEXT).agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    return level.select(*_TEXT, F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 512, fan_in: int = 8) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row
    with the largest id stays, a null id only among nulls. Rows that repeat an id and its
    text count in group_size each and share their verdict. An empty table gives no rows;
    further columns of the input are not read.
    """
    rows = steady(digests(docs, id_col, text_col))
    groups = merge_runs(rows, runs, fan_in)
    return rows.join(groups, _TEXT).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns. Of rows that repeat an id and a text
    one stays."""
    keep = exact_dedup(docs, id_col, text_col).where("kept").select(row_key("doc_id").alias("key"), F.col("text_sha256").alias("sha")).distinct()
    sha = F.sha2(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), 256)
    keyed = docs.select(F.struct(*docs.columns).alias("row"), row_key(id_col).alias("key"), sha.alias("sha"))
    return keyed.join(keep, ["key", "sha"], "left_semi").dropDuplicates(["key", "sha"]).select("row.*")


@query(
    "op6_exact_dedup",
    f"""
    with t as (select doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) as h from documents)
    select doc_id, max(doc_id) over (partition by h) as keep_id, count(*) over (partition by h) as group_size,
           doc_id is not distinct from max(doc_id) over (partition by h) as kept, h as text_sha256
    from t
    """,
)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))
