"""Language ID by cross-parsing: how few phrases of a language's text make up a document."""

from __future__ import annotations

import sys
from functools import cache

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docflow.llm.common import bucket, documents, query, row_key, version

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_BLOCK = 1024  # bytes parsed in one go; a phrase ends at the end of its block
_GROUP = 4_000_000  # bytes parsed together


@cache
def _numerals(wide: bool):
    """A pattern of numerals that are no digits, such as fractions and Roman numbers: no letters
    either. Characters of 16 bits are looked up in a table, wide ones in a list."""
    import re
    import unicodedata

    return re.compile("[" + "".join(c for c in map(chr, range(0x110000 if wide else 0x10000)) if unicodedata.category(c) in ("No", "Nl")) + "]+")


def plain(text: str) -> bytes:
    """Letters in lower case, everything else as one space."""
    import re

    letters = re.sub(r"[\W\d_]+", " ", text.lower())
    if not letters.isascii():
        numerals = _numerals(max(letters) > "\uffff")
        if numerals.search(letters):
            letters = re.sub(" +", " ", numerals.sub(" ", letters))
    return letters.strip().encode("utf-8", "replace")


def suffix_automaton(data: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence of symbols, state 0 first. It reads
    exactly the substrings of the sequence."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in data:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and symbol not in step[at]:
            step[at][symbol] = new
            at = link[at]
        if at >= 0:
            to = step[at][symbol]
            if length[at] + 1 == length[to]:
                link[new] = to
            else:
                copy = len(step)
                step.append(dict(step[to]))
                link.append(link[to])
                length.append(length[at] + 1)
                while at >= 0 and step[at].get(symbol) == to:
                    step[at][symbol] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    return step


class Parser:
    """One table for the automata of all languages. A step that the automaton has not ends
    the phrase and starts the next one with the same symbol."""

    def __init__(self, samples: dict[str, bytes]):
        import numpy as np

        self.langs = sorted(samples)
        used = sorted(set(b"".join(samples.values())))
        self.width = len(used) + 1  # the last symbol stands for all bytes no sample has
        self.symbol = np.full(256, len(used), dtype=np.int32)
        self.symbol[used] = np.arange(len(used), dtype=np.int32)
        tables, self.roots, self.bits, offset = [], [], [], 0
        for lang in self.langs:
            data = self.symbol[np.frombuffer(samples[lang], dtype=np.uint8)].tolist()
            step = suffix_automaton(data)
            root = offset * self.width
            # An entry is the place of the next state times two, plus one where a phrase ends.
            fresh = np.full(self.width, root * 2 + 1, dtype=np.int32)
            for symbol, to in step[0].items():
                fresh[symbol] = (offset + to) * self.width * 2 + 1
            table = np.tile(fresh, (len(step), 1))
            for state, moves in enumerate(step):
                for symbol, to in moves.items():
                    table[state, symbol] = (offset + to) * self.width * 2
            tables.append(table.ravel())
            self.roots.append(root)
            self.bits.append(np.log2(len(data) + 2))
            offset += len(step)
        self.table = np.concatenate(tables)

    def phrases(self, texts: list[bytes]):
        """Number of phrases per text and language. All blocks are read in step."""
        import numpy as np

        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        counts = np.zeros((len(texts), len(self.langs)), dtype=np.int64)
        data = self.symbol[np.frombuffer(b"".join(texts), dtype=np.uint8)]
        parts = -(-sizes // _BLOCK)
        owner = np.repeat(np.arange(len(texts)), parts)
        if not len(owner):
            return counts
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = np.repeat(np.cumsum(sizes) - sizes, parts) + nth * _BLOCK
        length = np.minimum(_BLOCK, sizes[owner] - nth * _BLOCK)
        order = np.argsort(-length, kind="stable")
        owner, begin, length = owner[order], begin[order], length[order]
        running = np.searchsorted(-length, -np.arange(int(length[0])), side="left")  # blocks longer than the step
        state = np.tile(np.array(self.roots, dtype=np.int32)[:, None], (1, len(owner)))
        ends = np.ones((len(self.langs), len(owner)), dtype=np.int32)
        for at in range(int(length[0])):
            many = running[at]
            code = self.table[state[:, :many] + data[begin[:many] + at]]
            ends[:, :many] += code & 1
            state[:, :many] = code >> 1
        for k in range(len(self.langs)):
            counts[:, k] = np.bincount(owner, weights=ends[k], minlength=len(texts)).astype(np.int64)
        return counts

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and score of each text. Phrases are weighed by the bits that a place in
        the language's sample takes; the score is by how much the second best needs more."""
        import numpy as np

        clean = [plain(t) for t in texts]
        needed = self.phrases(clean) * np.array(self.bits)
        best = needed.argmin(axis=1)
        least = needed[np.arange(len(texts)), best]
        if len(self.langs) > 1:
            second = np.partition(needed, 1, axis=1)[:, 1]
            score = 1 - least / np.maximum(second, 1e-9)
        else:
            score = np.ones(len(texts))
        empty = [not c for c in clean]
        return (["und" if e else self.langs[b] for e, b in zip(empty, best.tolist())],
                [0.0 if e else float(min(1, max(0, s))) for e, s in zip(empty, score.tolist())])


def samples(docs: DataFrame, docs_per_lang: int = 60, chars_per_doc: int = 1000) -> dict[str, bytes]:
    """Labelled text per language: up to ``docs_per_lang`` documents outside the held-out
    fold in hash order, ``chars_per_doc`` characters of each from a place that its hash picks. This bounded sample is what
    the driver and every task hold."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (bucket(F.col("doc_id"), 3) != 1))
    key = F.md5(F.concat(F.lit("lang:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    spare = F.greatest(F.length("text") - chars_per_doc, F.lit(0))
    start = F.pmod(F.xxhash64("text"), spare.cast("bigint") + 1).cast("int") + 1
    ranked = known.select("lang", F.substring(F.col("text"), start, F.lit(chars_per_doc)).alias("t"), key.alias("k"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("k", "t"))
    rows = ranked.select("lang", "t", place.alias("n")).where(F.col("n") <= docs_per_lang).orderBy("lang", "n").collect()
    out: dict[str, list[bytes]] = {}
    for row in rows:
        out.setdefault(row["lang"], []).append(plain(row["t"]))
    return {lang: text for lang, parts in out.items() if (text := b" ".join(p for p in parts if p))}


def identify(
    docs: DataFrame, docs_per_lang: int = 60, chars_per_doc: int = 1000,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, version (a hash of the text).

    Learns from text and language of documents whose CRC-32 of the id is not 1 modulo 3.
    Whole texts are parsed, in blocks of 1024 bytes, by the suffix automaton of every
    language; the fewest weighted phrases win, ties go to the first language by name. A text
    that is null or has no letter is ``und`` with score 0, as is every text when nothing is
    labelled. Repeated rows come out as often as they come in, an empty table gives no rows,
    further columns of the input are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    learnt = docs.sparkSession.sparkContext.broadcast(samples(rows, docs_per_lang, chars_per_doc))

    def run(batches):
        import pyarrow as pa

        parser = Parser(learnt.value) if learnt.value else None
        for batch in batches:
            texts, size, done = [], 0, 0
            for i, value in enumerate(batch.column(1)):
                text = value.as_py() or ""
                texts.append(text)
                size += len(text)
                if size >= _GROUP or i == batch.num_rows - 1:
                    langs, scores = parser.predict(texts) if parser else (["und"] * len(texts), [0.0] * len(texts))
                    ids, versions = (batch.column(c).slice(done, len(texts)) for c in (0, 2))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(langs), pa.array(scores), versions], ["doc_id", "lang_pred", "score", "version"])
                    done += len(texts)
                    texts, size = [], 0

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.select("doc_id", "text", version("text").alias("version")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, version long")
    return found.select("doc_id", (bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "version")


def drop_unknown(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents whose language is identified, with all their columns. Rows that share an id or
    have none are judged by their own text each; one row in is one row out or none."""
    unknown = identify(docs, id_col=id_col, text_col=text_col).where("lang_pred = 'und'").select(row_key("doc_id").alias("key"), "version").distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("row"), row_key(id_col).alias("key"), version(text_col).alias("version"))
    return keyed.join(unknown, ["key", "version"], "left_anti").select("row.*")


@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir)).drop("version")
