"""Quality rules: how far a document's characters and common words are from its language's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docflow.llm.common import WORD, documents, query, steady, words

# Fixed values of the base rules.
_SYMBOLS = "[#*$%&|<>]"
_BASE_WORDS, _REPEAT_SHARE = 50, 50

_CLASSES = ("space", "small", "other_small", "large", "digit", "stop", "other")
_BROADCAST_ROWS = 10_000


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms that sum up to one, between 0 and 1."""
    def part(x, y):
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    terms = F.zip_with(p, q, lambda x, y: (part(x, y) + part(y, x)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)))


def letter_words(text: Column) -> Column:
    """Words as runs of letters, in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), "")


def common_words(docs: DataFrame, most: int = 30) -> DataFrame:
    """``lang, common``: the most frequent words of each language, counted over all texts."""
    seen = docs.select("lang", F.explode(letter_words(F.col("text"))).alias("word"))
    counts = seen.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "word"))
    top = counts.select("lang", "word", place.alias("place")).where(F.col("place") <= most)
    ranked = top.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("w"))
    return steady(ranked.select("lang", F.col("w.word").alias("common")))


def _shipped(side: DataFrame) -> DataFrame:
    """A side of one row per language goes to all tasks if it is small; otherwise Spark joins
    as it sees fit."""
    return F.broadcast(side) if side.count() <= _BROADCAST_ROWS else side


def measures(docs: DataFrame, common: DataFrame) -> DataFrame:
    """Base counts and both histograms, as counts, per document. No text is carried on."""
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = docs.join(_shipped(common.withColumnRenamed("lang", "l")), F.col("lang").eqNullSafe(F.col("l")), "left").select(
        "doc_id", "lang", text.alias("text"), words(text).alias("w"), letter_words(text).alias("lw"),
        F.coalesce("common", F.array().cast("array<string>")).alias("common"),
    )
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    at = lambda i: F.get("w", i)
    windows = F.when(
        F.size("w") > 3,
        F.sort_array(F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.struct(F.xxhash64(at(i), at(i + 1), at(i + 2)).alias("h"), i.alias("i")))),
    )
    counted = cut.select(
        "doc_id", "lang", F.length("text").alias("n_chars"), F.size("w").cast("bigint").alias("n_words"),
        F.array_join("w", "").alias("ink"), lines.alias("lines"), windows.alias("win"),
        F.size("common").alias("n_common"), F.size("lw").alias("n_lw"),
        # The place of each word in the list of common words; those outside are dropped.
        F.array_remove(F.transform("lw", lambda x: F.array_position("common", x)), 0).alias("hits"),
    )
    # Windows are in order of their hash, so equal ones are neighbours.
    twice = F.filter("win", lambda x, j: (x["h"] == F.get("win", j - 1)["h"]) | (x["h"] == F.get("win", j + 1)["h"]))
    places = counted.select(
        "*", F.sort_array(F.transform(twice, lambda x: x["i"])).alias("places"),
        F.regexp_replace("ink", "[a-z]+", "").alias("odd"), F.size("lines").cast("bigint").alias("n_lines"),
    )
    covered = F.transform("places", lambda p, j: F.coalesce(F.least(F.lit(3), F.get("places", j + 1) - p), F.lit(3)))
    count = lambda pattern: F.regexp_count("odd", F.lit(pattern)).cast("bigint")
    long = lambda c: c.cast("bigint")
    rest = places.select(
        "doc_id", "lang", "n_words", long(F.length("ink")).alias("word_chars"), count(_SYMBOLS).alias("n_symbols"),
        (F.col("n_lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(F.aggregate(covered, F.lit(0), lambda acc, x: acc + x), F.lit(0)).cast("bigint").alias("n_repeat_words"),
        long(F.col("n_chars") - F.length("ink")).alias("space"), long(F.length("ink") - F.length("odd")).alias("small"),
        count(r"\p{Ll}").alias("other_small"), count(r"\p{Lu}").alias("large"), count(r"\p{Nd}").alias("digit"),
        count(r"[.,;:?'\"()-]").alias("stop"), F.length("odd").alias("n_odd"), "n_common", "n_lw", "hits",
    )
    other = F.col("n_odd") - F.col("other_small") - F.col("large") - F.col("digit") - F.col("stop")
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.col("n_common"), F.lit(1))), lambda k: F.size("hits") - F.size(F.array_remove("hits", k.cast("bigint"))))
    return rest.withColumn("other", long(other)).select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lw",
        F.array(*_CLASSES).alias("chars"), F.concat(each, F.array(F.col("n_lw") - F.size("hits"))).alias("common"),
    )


def shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return F.transform(counts, lambda x: x / F.greatest(total, F.lit(1)))


def divergence_rules(
    docs: DataFrame, max_chars: float = 0.13, max_words: float = 0.55, min_words: int = 50, most: int = 30,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, char_divergence, word_divergence.

    The reference of a language is the mean of the histograms of its documents that pass the
    base rules and have ``min_words`` letter words; common words are the ``most`` frequent of
    the language. All counts are over all documents. A document fails when its characters or
    its common words are farther from the reference than the thresholds (Jensen-Shannon
    distance); one with fewer than ``min_words`` letter words is too short to judge by the
    words, and one without a reference is not judged. Documents without a language share a
    reference of their own. Null text has no words and fails the base rules; repeated rows
    are judged alike and counted each; an empty table gives no rows; further columns are not
    read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counted = measures(rows, common_words(rows, most))
    failed = (F.col("n_words") < _BASE_WORDS) | (100 * F.col("n_repeat_words") > _REPEAT_SHARE * F.col("n_words"))
    known = steady(counted.select("*", failed.alias("base_failed"), shares(F.col("chars")).alias("p"), shares(F.col("common")).alias("q")).drop("chars", "common"))

    sound = known.where(~F.col("base_failed") & (F.col("n_lw") >= min_words))
    mean = lambda c, n: F.array(*(F.coalesce(F.avg(F.get(c, F.lit(i))), F.lit(0.0)) for i in range(n)))
    reference = steady(sound.groupBy("lang").agg(mean("p", len(_CLASSES)).alias("rp"), mean("q", most + 1).alias("rq")).withColumnRenamed("lang", "l"))
    judged = known.join(_shipped(reference), F.col("lang").eqNullSafe(F.col("l")), "left").select(
        "*", divergence(F.col("p"), F.col("rp")).alias("char_divergence"),
        # A language with few words has a shorter list; what is missing counts as nothing.
        divergence(_padded(F.col("q"), most + 1), F.col("rq")).alias("word_divergence"),
    )
    far = (F.col("char_divergence") > max_chars) | ((F.col("n_lw") >= min_words) & (F.col("word_divergence") > max_words))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept"), "char_divergence", "word_divergence",
    )


def _padded(values: Column, n: int) -> Column:
    return F.slice(F.concat(values, F.array_repeat(F.lit(0.0), n)), 1, n)


@query("op3_divergence")
def op3_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_rules(documents(spark, sf_dir))
