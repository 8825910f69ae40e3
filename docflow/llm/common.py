"""What the operators share: registering, input rows, checkpoints, sources of text rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.sources.placing import shared_folder

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# What counts as a word, and as space between words, in every contract.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``key`` with the equivalent SQL, where SQL can say it."""

    def register(build: Query) -> Query:
        QUERIES[key] = build
        if sql is not None:
            ORACLES[key] = sql
        return build

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def steady(df: DataFrame) -> DataFrame:
    """Write what several steps read to the folder of ``spark.checkpoint.dir`` and cut the
    lineage there, so that a lost executor takes nothing with it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else. Text of one byte a character has no other capitals."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Words of a text as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def bucket(doc_id: Column, parts: int) -> Column:
    """The fold of a document: CRC-32 of its id as text. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def version(text_col: str) -> Column:
    """Tells texts apart that share an id or have none. Null counts as empty text."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def row_key(id_col: str) -> Column:
    """An id as text that joins, null included and unlike any other."""
    return F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit(""))


def text_key(id_col: str, text_col: str) -> Column:
    """A key of an id and its text that is never null and has an order: null ids rank last."""
    return F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), version(text_col).alias("version"))
