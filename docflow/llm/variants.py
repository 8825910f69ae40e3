"""Spelling variants: words one edit apart, found through a variable-length gram index."""

from __future__ import annotations

import sys
from math import ceil, log2

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm.common import documents, lower_ascii, query, steady

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_LETTERS = r"A-Za-zÀ-ÿ"
_SHORTEST, _LONGEST = 2, 8  # lengths of grams
_LIST = 400  # a gram of more words than this is too frequent and grows by a character
_FREQUENT = 50_000  # frequent grams of one length at most: the list grows where there would be more
_LONG = 64  # words of more characters, ^ and $ included, stand under their two halves
_POSTING = "gram string, at int, size int, kind int, word string, n long, letters long, lo int, hi int, start int, stop int"


# ---- words -----------------------------------------------------------------------------------


def words(docs: DataFrame, min_length: int = 5, min_count: int = 3, spoil: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: runs of letters with A-Z in lower case, counted over all texts. A run whose
    checksum with the document's id is divisible by ``spoil`` loses a letter first; a null
    id counts as empty text."""
    run = F.col("run")
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.split(lower_ascii(F.col(text_col)), f"[^{_LETTERS}]+")).alias("run"),
    ).where(F.length("run") >= min_length)
    hashed = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (hashed % F.length(run)).cast("int")
    spoilt = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    word = F.when(hashed % spoil == 0, spoilt).otherwise(run)
    counted = runs.select(word.alias("word")).where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= min_count)


# ---- the gram dictionary ---------------------------------------------------------------------


def frequent_grams(vocabulary: DataFrame, least: int, shortest: int = _SHORTEST, longest: int = _LONGEST) -> dict[str, int]:
    """Grams of more than ``least`` places in the words, with their number of places.

    Length by length, and only where the gram without its last character is frequent too. A
    word stands between ^ and $. The dictionary of the index is what this table implies: a
    gram that is not frequent, but frequent without its last character. ``least`` is raised
    so that no length has more than 50,000 of them, which bounds what is sent to the tasks.
    """
    padded = vocabulary.select(F.concat(F.lit("^"), "word", F.lit("$")).alias("w"))
    places = padded.agg(F.coalesce(F.sum(F.length("w")), F.lit(0))).first()[0]
    least, found, last = max(least, ceil(places / _FREQUENT)), {}, None
    for q in range(shortest, longest + 1):
        starts = F.when(F.length("w") >= q, F.sequence(F.lit(1), F.length("w") - (q - 1))).otherwise(F.array().cast("array<int>"))
        grams = padded.select(F.explode(F.transform(starts, lambda i: F.substring(F.col("w"), i, F.lit(q)))).alias("gram"))
        if last is not None:
            grams = grams.join(last, F.substring("gram", 1, q - 1) == F.col("head"), "left_semi")
        rows = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).collect()
        if not rows:
            break
        found |= {r["gram"]: r["n"] for r in rows}
        last = vocabulary.sparkSession.createDataFrame([(r["gram"],) for r in rows], "head string")
    return found


def decompose(word: str, frequent: dict[str, int], shortest: int = _SHORTEST, longest: int = _LONGEST) -> list[tuple[int, int]]:
    """(start, stop) of the variable-length grams of ^word$, rarest first. The gram at a place
    grows while it is frequent, so it depends on its own characters only."""
    from zlib import crc32

    w, out = f"^{word}$", []
    for i in range(len(w) - shortest + 1):
        j = i + shortest
        while j < len(w) and j - i < longest and w[i:j] in frequent:
            j += 1
        gram = w[i:j]
        out.append((frequent.get(gram, 0), crc32(gram.encode()), gram, i, j))
    return [(i, j) for *_, i, j in sorted(out)]


def post(word: str, frequent: dict[str, int]) -> list[tuple]:
    """Entries of a word in the index: (gram, place, size, kind, lo, hi, start, stop).

    An edit at place e touches the grams that hold e. Two near words share all others, at
    places counted from the start or, behind the edit, from the end; so they meet at the
    rarest gram that the edit leaves alone. Grams are taken from the rarest on, while some
    place lies in all that were taken: this is the word's bound, after which an edit has left
    one alone. ``lo <= e < hi`` are the places that touch every rarer gram, so a pair counts
    in one list only. Kinds: 0 meets words of its own size and shorter ones; 1 and 2 are the
    shorter words, with the edit behind the gram and before it.

    A gram that stays frequent at its greatest length or at the word's end has no short
    list. There, and where a place lies in all grams, words meet by what is left without the
    character at e (kind 0) or as they are (kind 3), for the few places e that are open.
    Long words have two grams, their halves, so their entries stay few.
    """
    w = f"^{word}$"
    n, out = len(w), []
    lo, hi = 1, n - 1  # where a character may be replaced or taken away
    first, last = 1, n  # before which a character may be put in
    middle, next_middle = n // 2, (n + 1) // 2
    if n > _LONG:
        out += [(w[:middle], 0, n, 0, lo, hi, 0, middle), (w[middle:], middle, n, 0, lo, middle, middle, n)]
    if n >= _LONG:
        out += [(w[:next_middle], 0, n + 1, 1, 0, 0, 0, 0), (w[next_middle - 1 :], next_middle, n + 1, 2, 0, 0, 0, 0)]

    def by_rest(start, stop):
        if n <= _LONG:
            for e in range(lo, hi):
                if not start <= e < stop:
                    out.append((w[:e] + "\0" + w[e + 1 :], e, n, 0, e, e + 1, 0, 0))
        if n < _LONG:
            for e in range(first, last):
                if not start < e < stop:
                    out.append((w[:e] + "\0" + w[e:], e, n + 1, 3, e, e + 1, 0, 0))

    for i, j in decompose(word, frequent) if n <= _LONG else ():
        if lo >= hi and first >= last:
            return out
        gram = w[i:j]
        if gram in frequent:
            by_rest(i, j)
        else:
            out.append((gram, i, n, 0, lo, hi, i, j))
            if n < _LONG and last > j and last > first:
                out.append((gram, i, n + 1, 1, lo, hi, i, j))
            if n < _LONG and first <= i and last > first:
                out.append((gram, i + 1, n + 1, 2, lo, hi, i, j))
        lo, hi, first, last = max(lo, i), min(hi, j), max(first, i + 1), min(last, j)
    by_rest(0, 0)
    return out


def postings(vocabulary: DataFrame, frequent: dict[str, int]) -> DataFrame:
    """The index: one row per word and list it stands in."""
    table = vocabulary.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        import pyarrow as pa

        names = [c.split(" ")[0] for c in _POSTING.split(", ")]
        types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), *[pa.int32()] * 4]
        for batch in batches:
            rows = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                letters = 0
                for c in word:
                    letters |= 1 << ord(c) % 63
                rows += [(g, at, size, kind, word, n, letters, *rest) for g, at, size, kind, *rest in post(word, table.value)]
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return vocabulary.select("word", "n").mapInArrow(run, _POSTING)


def near_words(vocabulary: DataFrame, least: int = _LIST) -> DataFrame:
    """``word, n, near, near_n``: every pair of words exactly one edit apart, once each way.

    Lists of one gram, place and size are merged by a join. What can be told from sets of
    letters is told first; then the edit distance is computed, and whether the edit lies
    where this list answers for it.
    """
    index = postings(vocabulary, frequent_grams(vocabulary, least)).withColumn("key", F.xxhash64("gram", "at", "size")).drop("gram", "at", "size")
    a = index.where("kind = 0").select("key", *(F.col(c).alias(f"a_{c}") for c in ("word", "n", "letters", "lo", "hi", "start", "stop")))
    b = index.select("key", "kind", *(F.col(c).alias(f"b_{c}") for c in ("word", "n", "letters")))
    like = (
        ((F.col("kind") > 0) | (F.col("a_word") < F.col("b_word")))
        & (F.bit_count(F.col("a_letters").bitwiseXOR(F.col("b_letters"))) <= 2)
    )
    met = a.join(b, "key").where(like).where(F.levenshtein("a_word", "b_word", 1) == 1)
    # Place of the first difference, counted from the ^ in front.
    differs = F.zip_with(F.split("a_word", ""), F.split("b_word", ""), lambda x, y: ~x.eqNullSafe(y))
    at = met.withColumn("e", F.array_position(differs, True).cast("int"))
    before, behind = F.col("e") < F.col("a_start"), F.col("e") >= F.col("a_stop")
    side = F.when(F.col("kind") == 1, behind).when(F.col("kind") == 2, before).otherwise(before | behind)
    pairs = at.where((F.col("e") >= F.col("a_lo")) & (F.col("e") < F.col("a_hi")) & side)
    both = F.explode(F.array(
        F.struct(F.col("a_word").alias("word"), F.col("a_n").alias("n"), F.col("b_word").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b_word").alias("word"), F.col("b_n").alias("n"), F.col("a_word").alias("near"), F.col("a_n").alias("near_n")),
    ))
    return pairs.select(both.alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where the chain of forms of each word with a form ends.

    Every form is at least twice as frequent as its word, so a chain has at most 63 steps, as
    many as doublings from the rarest to the most frequent; each round doubles the steps that
    are known."""
    steps = steady(forms.select("word", F.col("form").alias("root")))
    span = forms.agg(F.max("form_n") / F.min("n")).first()[0] or 1
    for _ in range(ceil(log2(max(2.0, log2(span) + 1)))):
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("on"))
        steps = steady(steps.join(ahead, "root", "left").select("word", F.coalesce("on", "root").alias("root")))
    return steps


def variant_groups(docs: DataFrame, least: int = _LIST, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n.

    Words are runs of letters of at least ``min_length`` code points and ``min_count``
    occurrences over all texts. The form of a word is the most frequent word one edit away,
    if that is at least twice as frequent; of equal ones the smallest in code-point order.
    The root is the last form along the chain, the word itself where it has none. Null and
    empty texts have no words; very long texts are read word by word; repeated rows count
    each; an empty table gives no rows; further columns are not read.
    """
    vocabulary = steady(words(docs, id_col=id_col, text_col=text_col, **options))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_words(vocabulary, least).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    chosen = vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))
    good = F.coalesce(F.col("form_n") >= 2 * F.col("n"), F.lit(False))
    known = steady(chosen.withColumn("form", F.when(good, F.col("form"))).withColumn("form_n", F.when(good, F.col("form_n"))))
    last = roots(known.where("form IS NOT NULL"))
    return known.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


@query("op12_spelling_variants")
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_groups(documents(spark, sf_dir))
