"""Substring dedup: sentences and lines hashed, repeats found across the corpus."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docflow.llm.common import documents, query

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_UNIT_WORDS = 4  # a unit of fewer words says too little by itself and is hashed with its neighbours
_LONG_WORD = 8  # code points that count as a word, in URLs, code and scripts without spaces
_LONG_SENTENCE = 24  # from so many words a sentence is compared in parts too
_PART_WORDS = 8  # parts of sentences under this stay beside whole ones that go
_CUT = 4  # of so many words one may end a part
_UNIT = "doc_id {kind}, version bigint, key bigint, seq int, code int, at array<bigint>"
_WHOLE, _PART, _SENTENCE, _WINDOW = range(4)  # a unit by itself, a part by itself, a sentence of parts, short units in their place


class Ends(dict):
    """Whether a word may end a part, remembered for words seen before."""

    def __missing__(self, word: str) -> bool:
        from zlib import crc32

        if len(self) >= 200_000:
            self.clear()
        self[word] = out = word[-1] in "，、；：" or crc32(word.encode("utf-8", "replace")) % _CUT == 0
        return out


def cut_units(text: str, ends: Ends | None = None) -> list[tuple[int, int, str, int, int]]:
    """Units of a text: start and stop in code points, the normalised unit (lower case,
    single spaces), its number of words, and the number of its sentence.

    A sentence is a line, cut further behind full stops. One of 24 words and more is cut into
    parts of four words and more behind words whose checksum says so, so that equal passages
    are cut alike wherever they begin: of any 50 words in a row, either a sentence is whole
    or 24 lie in one that is cut. Every character but white space lies in one unit. Words are what
    white space divides or, if that is more, stretches of eight code points, of two where
    the script has no spaces (Chinese, Japanese, Thai, Lao, Burmese, Khmer)."""
    import re

    ends = Ends() if ends is None else ends
    # Most scripts with spaces keep their places in lower case, and white space alone divides them.
    low = text.lower() if text.isascii() or not re.search("[\u0e00-\U0010ffffΣİ]", text) else None
    out = []
    unspaced = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
    tokens = re.compile(r"[^\s，、；：]+[，、；：]*|[，、；：]+")

    def size(words):
        unit = " ".join(words)
        n = max(len(words), len(unit) // _LONG_WORD)
        return unit, n if low is not None or max(unit) < "\u0e00" else max(n, len(unspaced.findall(unit)) // 2)

    def placed(words, lo, hi):
        if low is None:
            for t in tokens.finditer(text, lo, hi):
                yield t.start(), t.end(), t[0].lower()
            return
        for word in words:
            at = low.index(word, lo)
            yield at, (lo := at + len(word)), word

    nth = 0
    for m in re.finditer(r"[^\n.!?。！？｡]*+(?:[.!?]++(?![\s。！？｡]|\Z)[^\n.!?。！？｡]*+)*+[.!?。！？｡]*+", text):
        lo, hi = m.span()
        words = (m[0].lower() if low is None else low[lo:hi]).split()
        if not words:
            continue
        unit, n = size(words)
        if n < _LONG_SENTENCE:
            out.append((hi - len(m[0].lstrip()), lo + len(m[0].rstrip()), unit, n, nth))
            nth += 1
            continue
        found = list(placed(words, lo, hi))
        parts, since = [], 0
        for i, (_, _, word) in enumerate(found):
            if ends[word] and (i - since >= _UNIT_WORDS - 1 or size([w for _, _, w in found[since : i + 1]])[1] >= _UNIT_WORDS):
                parts.append((since, i + 1))
                since = i + 1
        if since < len(found):
            if parts and size([w for _, _, w in found[since:]])[1] < _UNIT_WORDS:
                since = parts.pop()[0]
            parts.append((since, len(found)))
        for lo, hi in parts:
            out.append((found[lo][0], found[hi - 1][1], *size([w for _, _, w in found[lo:hi]]), nth))
        nth += 1
    return out


def keyed(found: list[tuple[int, int, str, int, int]]) -> list[tuple[bytes, int, int, list[int]]]:
    """What units are compared by: (digest, seq, code, at). A unit of enough words is its own
    key, and the parts of a sentence have one more together, for the sentence they stand in.
    A short unit is read in its place: by every window that reaches enough words, of the units
    from it on or up to it, which is one key for all short units in it. So short ones are
    equal only where what stands around them is equal too. Sentences and windows are digests
    of their units' digests, so keys take no more room than the text has units.

    ``seq`` is the number of the first unit, ``code`` the kind in its lowest two bits. Above
    them are the words of a unit, the number of a sentence's parts, or four bits for each short
    unit of a window: its place in the window and its words, both under four as a window has four
    units at most. ``at`` has start and length of each unit in one number; a sentence has none,
    as its parts have keys of their own that are shared where it is.

    A part by itself is not read as a whole; the first occurrence of a key is not removed for
    another key, unless it is that of a sentence."""
    from hashlib import blake2b

    own = [blake2b(unit.encode("utf-8", "replace"), digest_size=8).digest() for _, _, unit, _, _ in found]
    sizes = [n for _, _, _, n, _ in found]
    at = [start << 32 | stop - start for start, stop, *_ in found]
    together = lambda kind, lo, hi: blake2b(kind + b"".join(own[lo:hi]), digest_size=8).digest()
    windows, out = set(), []
    for i, n in enumerate(sizes):
        if n < _UNIT_WORDS:
            hi, words = i, n
            while words < _UNIT_WORDS and hi + 1 < len(sizes):
                hi += 1
                words += sizes[hi]
            if words >= _UNIT_WORDS:
                windows.add((i, hi))
            lo, words = i, n
            while words < _UNIT_WORDS and lo > 0:
                lo -= 1
                words += sizes[lo]
            if words >= _UNIT_WORDS:
                windows.add((lo, i))
    lo, end = 0, len(found)
    while lo < end:
        hi = lo + 1
        while hi < end and found[hi][4] == found[lo][4]:
            hi += 1
        if hi == lo + 1:
            if sizes[lo] >= _UNIT_WORDS:
                out.append((own[lo], lo, sizes[lo] << 2 | _WHOLE, at[lo : lo + 1]))
        else:
            out.extend((own[i], i, sizes[i] << 2 | _PART, at[i : i + 1]) for i in range(lo, hi) if sizes[i] >= _UNIT_WORDS)
            out.append((together(b"sentence", lo, hi), lo, hi - lo << 2 | _SENTENCE, []))
        lo = hi
    for lo, hi in windows:
        code, short = _WINDOW, []
        for i in range(lo, hi + 1):
            if sizes[i] < _UNIT_WORDS:
                code |= (i - lo << 2 | sizes[i]) << 2 + 4 * len(short)
                short.append(at[i])
        out.append((together(b"window", lo, hi + 1), lo, code, short))
    return out


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per key of a text, with the digest and the units that it is for (see ``keyed``). ``version`` tells texts apart that share an id."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    schema = _UNIT.format(kind=rows.schema["doc_id"].dataType.simpleString())

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def pack(ids, versions, found):
            digests, seq, code, places = zip(*found)
            offsets = np.cumsum([0, *map(len, places)])
            at = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([x for p in places for x in p], pa.int64()))
            return pa.RecordBatch.from_arrays(
                [ids, versions, pa.array(np.frombuffer(b"".join(digests), "<i8")), pa.array(seq, pa.int32()), pa.array(code, pa.int32()), at],
                ["doc_id", "version", "key", "seq", "code", "at"],
            )

        ends = Ends()
        for batch in batches:
            owner, found = [], []
            for row, text in enumerate(batch.column(2)):
                keys = keyed(cut_units(text.as_py() or "", ends))
                owner.extend([row] * len(keys))
                found.extend(keys)
                if len(found) >= 50_000 or (row == batch.num_rows - 1 and found):
                    rows_of = pa.array(owner, pa.int64())
                    yield pack(batch.column(0).take(rows_of), batch.column(1).take(rows_of), found)
                    owner, found = [], []

    return rows.mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, min_words: int = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans to remove: doc_id, version, start, stop (code points, stop exclusive), n_words,
    first_doc_id, first_start.

    Units are compared by digest over the whole corpus. The occurrence of the smallest
    (doc_id, place) is kept, all others repeat it; null ids rank last. Repeated units that
    follow each other make a run. Lines and sentences that repeat whole are removed from
    four words on, shorter ones with what repeats around them. Parts of sentences are
    removed where the run has ``min_words`` words and the parts that follow each other have
    eight, so a passage set into other text goes but for some words at its ends, and a stock
    phrase inside a sentence stays. A short sentence stays where it is part of an occurrence
    that is kept; a unit that is not repeated ends the span. Where the first unit of the
    span is kept is returned with it. Rows that repeat an id and its text are the same
    occurrence and share its verdict. Null and empty texts have no units, an empty table
    gives no rows, further columns are not read.
    """
    # Keys meet once, in the order of their occurrences; what occurs once goes no further.
    met = Window.partitionBy("key").orderBy(F.col("doc_id").asc_nulls_last(), "version", "seq")
    first = F.first(F.struct("doc_id", "version", "seq", "at")).over(met)
    found = units(docs, id_col, text_col).withColumns({"first": first, "next": F.lead(F.lit(1)).over(met), "nth": F.row_number().over(met)})
    again = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("version") == F.col("first.version")) & (F.col("seq") == F.col("first.seq")))
    shared = found.where("nth > 1 or next is not null").select("doc_id", "version", "seq", "code", "at", "first", again.alias("again"))
    # One shuffle brings a text's units together, for all that follows.
    mine = shared.repartition("doc_id", "version").select("*", (F.col("code").bitwiseAND(3)).alias("kind"), F.shiftright("code", 2).alias("rest"))
    mine = mine.withColumn("i", F.explode(F.sequence(F.lit(0), F.when(F.col("kind") == _SENTENCE, F.col("rest")).otherwise(F.size("at")) - 1)))
    in_window = F.expr("shiftright(rest, 4 * i)")
    step = F.when(F.col("kind") == _WINDOW, F.shiftright(in_window, 2).bitwiseAND(3)).otherwise(F.col("i"))
    n_words = F.when(F.col("kind") == _WINDOW, in_window.bitwiseAND(3)).when(F.col("kind") != _SENTENCE, F.col("rest"))
    at, start = F.get("at", F.col("i")), lambda at: F.shiftright(at, 32).cast("int")
    mark = F.struct(F.col("first.doc_id").isNull().alias("last"), F.col("first.doc_id").alias("doc_id"), F.col("first.version").alias("version"),
                    (F.col("first.seq") + step).alias("seq"), start(F.get("first.at", F.col("i"))).alias("start"))
    each = mine.select(
        "doc_id", "version", (F.col("seq") + step).alias("seq"), start(at).alias("start"), (start(at) + at.bitwiseAND(0xFFFFFFFF).cast("int")).alias("stop"), n_words.alias("n_words"),
        ((F.col("kind") != _SENTENCE) & ~F.col("again")).alias("held"), ((F.col("kind") != _PART) & F.col("again")).alias("gone"),
        F.when(F.col("kind") != _SENTENCE, mark).alias("mark"))
    met = each.groupBy("doc_id", "version", "seq").agg(
        F.max("start").alias("start"), F.max("stop").alias("stop"), F.max("n_words").alias("n_words"),
        F.max("held").alias("kept"), F.max("gone").alias("whole"), F.min("mark").alias("first"),
    ).where("not kept and start is not null").select("doc_id", "version", "seq", "start", "stop", "n_words", "whole", F.col("first.doc_id").alias("fd"), F.col("first.start").alias("fs"))
    in_row = lambda *keys: F.col("seq") - F.row_number().over(Window.partitionBy("doc_id", "version", *keys).orderBy("seq"))
    words = lambda *keys: F.sum("n_words").over(Window.partitionBy("doc_id", "version", *keys))
    runs = met.withColumn("run", in_row()).withColumn("like", in_row("run", "whole"))
    sized = runs.withColumn("all", words("run")).withColumn("own", words("run", "whole", "like"))
    enough = F.when(F.col("whole"), F.col("own") >= _UNIT_WORDS).otherwise((F.col("all") >= min_words) & (F.col("own") >= _PART_WORDS))
    spans = sized.where(enough).withColumn("run", in_row())
    return spans.groupBy("doc_id", "version", "run").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n_words").alias("n_words"),
        F.min_by("fd", "seq").alias("first_doc_id"), F.min_by("fs", "seq").alias("first_start"),
    ).drop("run")


def substring_dedup(docs: DataFrame, min_words: int = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, text without its repeated spans, and ``removed``, the spans with
    their offsets in the original text. Texts without a repeat come out as they are."""
    spans = repeated_spans(docs, min_words, id_col, text_col)
    listed = spans.groupBy(F.col("doc_id").alias("d"), F.col("version").alias("v")).agg(
        F.sort_array(F.collect_list(F.struct("start", "stop", "n_words", "first_doc_id", "first_start"))).alias("removed"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    joined = rows.join(listed, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")), "left")
    empty = F.array().cast(joined.schema["removed"].dataType)
    known = joined.select("doc_id", "text", F.coalesce("removed", empty).alias("removed"))
    # What is kept lies between the spans: from the end of one to the start of the next.
    ends = F.concat(F.array(F.lit(0)), F.col("removed.stop"))
    starts = F.concat(F.col("removed.start"), F.array(F.length("text")))
    kept = F.zip_with(ends, starts, lambda a, b: F.substring(F.col("text"), a + 1, b - a))
    return known.select("doc_id", F.when(F.size("removed") == 0, F.col("text")).otherwise(F.array_join(kept, "")).alias("text"), "removed")


@query("op1_substring_dedup")
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(documents(spark, sf_dir)).drop("version")
