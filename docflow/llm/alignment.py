"""Cross-tokenizer alignment: which tokens of two vocabularies lie on the same bytes."""

from __future__ import annotations

import json
import sys
from itertools import chain

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm.common import documents, query, steady

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SHARDS = 64  # pairs are dealt out by their B id
_FAN_IN = 16  # vectors summed at a time on each level of the tree
_GAMMA = 1.5  # places a key has on each level of the hash
_CACHE = 250_000  # stretches of text a task remembers before it starts anew
_GROUP = 2_000_000  # characters of texts that are cut together
_B = 1 << 20  # a pair is A id * _B + B id; both vocabularies are smaller
_TABLE_LIMIT = 16_000_000  # pairs of a table that is sent to every task; about 13 bytes each
# Fixed value: how A cuts text into words.
_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PLAIN = "!-~À-ÖØ-öø-ÿ"  # never white space, for either tokenizer


class Stretches:
    """Texts cut into stretches that both tokenizers treat alike wherever they stand, each
    encoded and aligned once.

    A stretch starts at a space between two plain characters. No token of A reaches over such
    a place, because words are cut there before merging, and none of B, whose pieces hold a
    space in front only. So a text's tokens, groups and links are those of its stretches.
    """

    def __init__(self, spec: dict):
        import re

        import numpy as np
        import sentencepiece
        import tiktoken

        vocab = json.loads(spec["a"])
        special = {t["id"] for t in vocab["added_tokens"]}
        letters = {letter: byte for byte, letter in enumerate(_letters())}
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab["model"]["vocab"].items() if i not in special}
        # The file lists merges in the order of their ids, which are then the ranks.
        self.encode_a = tiktoken.Encoding("a", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.b = sentencepiece.SentencePieceProcessor(model_proto=spec["b"])
        pieces = (self.b.id_to_piece(i) for i in range(self.b.get_piece_size()))
        as_byte = re.compile(r"<0x([0-9A-F]{2})>")
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := as_byte.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        self.a_size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.a_size[list(ranks.values())] = [len(x) for x in ranks]
        self.width = max(len(self.a_size), len(self.b_size))
        self.signs = np.array([f"{i}{sep}" for sep in ",|;\n" for i in range(self.width)], object)
        self.cut = re.compile(rf"(?<=[{_PLAIN}])(?= [{_PLAIN}])").split
        self.clear()

    def clear(self):
        import numpy as np

        self.at, self.groups = {}, []
        self.links = np.zeros(0, np.int64)
        self.bad, self.sizes = np.zeros(0, bool), np.zeros((0, 4), np.int64)

    def _align(self, flat_a, flat_b, owner_a, owner_b, count: int):
        """Groups as text, linked pairs in order, and how many groups and links, per stretch.

        All stretches lie in one row of bytes. A link is what lies between two ends of tokens
        that follow each other, a group what lies between two that both sides share."""
        import numpy as np

        size_a, size_b = self.a_size[flat_a], self.b_size[flat_b]
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
        stop = np.cumsum(np.bincount(owner_a, size_a, count).astype(np.int64))
        ends, cuts = np.union1d(end_a, end_b), np.intersect1d(end_a, end_b, assume_unique=True)
        links = flat_a[np.searchsorted(end_a, ends)] * _B + flat_b[np.searchsorted(end_b, ends)]
        per = lambda places: np.bincount(np.searchsorted(stop, places), minlength=count)
        # Tokens by group, first those of A; behind each what divides it from the next.
        key = np.concatenate([np.searchsorted(cuts, end_a) * 2, np.searchsorted(cuts, end_b) * 2 + 1])
        order = np.argsort(key, kind="stable")
        key, ids = key[order], np.concatenate([flat_a, flat_b])[order]
        last = np.append(key[1:] != key[:-1], True)
        final = np.isin(cuts, stop, assume_unique=True)[key // 2]
        sign = np.where(~last, 0, np.where(key % 2 == 0, 1, np.where(final, 3, 2)))
        return "".join(self.signs[sign * self.width + ids].tolist()).split("\n")[:-1], links, per(cuts), per(ends)

    def learn(self, new: list[str]) -> None:
        import numpy as np

        if not new:
            return
        a, b = [self.encode_a(t) for t in new], self.b.encode([t[1:] for t in new], num_threads=1)
        same = b"".join([self.b_bytes[i] for ids in b for i in ids]) == "".join(new).encode()
        good = [same or b"".join([self.b_bytes[i] for i in ids]) == t.encode() for t, ids in zip(new, b)]
        kept_a, kept_b = ([ids for ids, y in zip(x, good) if y] for x in (a, b))
        flat = lambda lists: np.fromiter(chain.from_iterable(lists), np.int64)
        many_a, many_b = (np.array([len(x) for x in lists], np.int64) for lists in (kept_a, kept_b))
        owner = lambda many: np.repeat(np.arange(len(many)), many)
        if kept_a:
            groups, links, n_groups, n_links = self._align(flat(kept_a), flat(kept_b), owner(many_a), owner(many_b), len(kept_a))
        else:
            groups, links, n_groups, n_links = [], np.zeros(0, np.int64), many_a, many_a
        good = np.array(good)
        sizes = np.zeros((len(new), 4), np.int64)
        sizes[good] = np.stack([many_a, many_b, n_groups, n_links], 1)
        each = iter(groups)
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
        self.groups += [next(each) if y else "" for y in good]
        self.links = np.concatenate([self.links, links])
        self.bad, self.sizes = np.concatenate([self.bad, ~good]), np.concatenate([self.sizes, sizes])

    def read(self, texts: list[str]):
        """(places of the stretches of all texts, where each text starts among them). Texts are
        not empty."""
        import numpy as np

        cut = [self.cut(" " + t) for t in texts]
        flat = [s for c in cut for s in c]
        self.learn([s for s in dict.fromkeys(flat) if s not in self.at])
        return np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat)), np.cumsum([0] + [len(c) for c in cut[:-1]])


def _letters() -> list[str]:
    """The printable letter that stands for each byte in A: itself where it is printable, else
    the next letter from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def _text_groups(column):
    """Runs of rows of a batch whose texts together are not too long."""
    texts, size = [], 0
    for value in column:
        text = value.as_py() or ""
        if texts and size + len(text) > _GROUP:
            yield texts
            texts, size = [], 0
        texts.append(text)
        size += len(text)
    if texts:
        yield texts


def _good(stretches: Stretches, texts: list[str]):
    """(rows that have tokens, stretches of those rows in a row, start of each row)."""
    import numpy as np

    rows = [k for k, t in enumerate(texts) if t]
    if not rows:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    places, starts = stretches.read([texts[k] for k in rows])
    bad = np.add.reduceat(stretches.bad[places].astype(np.int64), starts) > 0
    sizes = np.diff(np.append(starts, len(places)))
    kept = np.repeat(~bad, sizes)
    sizes = sizes[~bad]
    return [k for k, b in zip(rows, bad) if not b], places[kept], np.cumsum(np.append(0, sizes))[:-1][: len(sizes)]


# ---- distinct pairs, a perfect hash of them, and their counts -------------------------------


def local_counts(docs: DataFrame, spec, text_col: str = "text") -> DataFrame:
    """``shard, task, pair, n``: links of each pair as every task sees them."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        stretches, seen, task = Stretches(spec.value), np.zeros(0, np.int64), TaskContext.get().partitionId()

        def flush():
            pairs, inverse = np.unique(stretches.links, return_inverse=True)
            weight = np.repeat(seen, stretches.sizes[:, 3])
            n = np.bincount(inverse, weight, len(pairs)).astype(np.int64)
            some = n > 0
            pairs, n = pairs[some], n[some]
            return pa.RecordBatch.from_arrays(
                [pa.array((pairs % _B % _SHARDS).astype(np.int32)), pa.array(np.full(len(pairs), task, np.int32)), pa.array(pairs), pa.array(n)],
                ["shard", "task", "pair", "n"])

        for batch in batches:
            for texts in _text_groups(batch.column(0)):
                _, places, _ = _good(stretches, texts)
                count = np.bincount(places, minlength=len(stretches.groups))
                seen = count + np.pad(seen, (0, len(count) - len(seen)))
                if len(stretches.groups) > _CACHE:
                    yield flush()
                    stretches.clear()
                    seen = np.zeros(0, np.int64)
        if stretches.groups:
            yield flush()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "shard int, task int, pair long, n long")


def mix(keys, level: int):
    """Another 64-bit hash of the keys for each level."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def perfect_hash(keys):
    """(64-bit words of all levels, words per level, keys by their number).

    On every level the keys that are left go to places of a bit array; those alone at their
    place are numbered by its rank among the set bits, the others go to the next level.
    Distinct keys end up with the numbers 0 to n - 1.
    """
    import numpy as np

    words, sizes, order, left = [], [], [], np.asarray(keys, np.int64)
    while len(left):
        size = max(1, int(len(left) * _GAMMA) // 64 + 1)
        place = (mix(left, len(sizes)) % np.uint64(size * 64)).astype(np.int64)
        alone = np.bincount(place, minlength=size * 64) == 1
        words.append(np.packbits(alone, bitorder="little").view(np.uint64))
        sizes.append(size)
        taken = alone[place]
        order.append(left[taken][np.argsort(place[taken])])
        left = left[~taken]
    none = np.zeros(0, np.int64)
    return np.concatenate(words) if words else none.astype(np.uint64), sizes, np.concatenate(order) if order else none


class PairTable:
    """Counts of pairs by perfect hash, shard after shard, with the keys that verify them."""

    def __init__(self, shards: list[tuple]):
        import numpy as np

        depth = max((len(levels) for _, levels, *_ in shards), default=0)
        self.first = np.zeros((depth, _SHARDS), np.int64)
        self.size = np.zeros((depth, _SHARDS), np.int64)
        words, at = [], 0
        for shard, levels, data, *_ in shards:
            for level, size in enumerate(levels):
                self.first[level, shard], self.size[level, shard] = at, size
                at += size
            words.append(np.frombuffer(data, np.uint64))
        join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
        self.words = join(words, np.uint64)
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        # A count is not negative; the sign says that it is the highest of its B id.
        self.keys = join([np.frombuffer(x[3], np.int64) for x in shards], np.int64)
        self.counts = join([np.frombuffer(x[4], np.int64) for x in shards], np.int64)

    def find(self, pairs):
        """(count, whether it is the highest of its B id) of each pair; 0 where it is none."""
        import numpy as np

        shard, number = pairs % _B % _SHARDS, np.full(len(pairs), -1, np.int64)
        open_ = np.arange(len(pairs))
        for level in range(len(self.size)):
            open_ = open_[self.size[level, shard[open_]] > 0]
            size = self.size[level, shard[open_]]
            place = (mix(pairs[open_], level) % (size * 64).astype(np.uint64)).astype(np.int64)
            word, bit = self.first[level, shard[open_]] + place // 64, (place % 64).astype(np.uint64)
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            number[open_[hit]] = (self.rank[word] + np.bitwise_count(below))[hit]
            open_ = open_[~hit]
        known = number >= 0
        known[known] = self.keys[number[known]] == pairs[known]
        found = np.where(known, self.counts[np.where(known, number, 0)] if len(self.counts) else 0, 0)
        return np.abs(found), found < 0


def _numbered(local: DataFrame) -> DataFrame:
    """``shard, levels, words, keys``: a perfect hash of the distinct pairs of each shard."""

    def build(frame):
        import numpy as np
        import pandas as pd

        words, sizes, keys = perfect_hash(np.sort(frame["pair"].to_numpy()))
        return pd.DataFrame({"shard": [frame["shard"].iloc[0]], "levels": [sizes], "words": [words.tobytes()], "keys": [keys.tobytes()]})

    distinct = local.select("shard", "pair").distinct()
    return steady(distinct.groupBy("shard").applyInPandas(build, "shard int, levels array<int>, words binary, keys binary"))


def pair_counts(local: DataFrame) -> DataFrame:
    """``shard, levels, words, keys, counts``: the hash with the counts of all pairs, negative
    where a count is the highest of its B id.

    Sixteen tasks' counts become one dense vector per shard, indexed by the hash; sixteen
    vectors are summed at a time until one is left. A group never holds more than that.
    """
    hashed = _numbered(local)
    lanes = (local.agg(F.max("task")).first()[0] or 0) // _FAN_IN + 1

    def dense(key, rows, table):
        import numpy as np
        import pandas as pd

        known = PairTable([(int(key[0]), table["levels"].iloc[0], table["words"].iloc[0], table["keys"].iloc[0], table["keys"].iloc[0])])
        # With its keys as counts, the table numbers pairs: keys lie in the order of numbers.
        order = np.argsort(known.keys)
        vector = np.zeros(len(order), np.int64)
        pairs = rows["pair"].to_numpy()
        np.add.at(vector, order[np.searchsorted(known.keys, pairs, sorter=order)], rows["n"].to_numpy())
        return pd.DataFrame({"shard": [key[0]], "lane": [key[1]], "vector": [vector.tobytes()]})

    def add(key, rows):
        import numpy as np
        import pandas as pd

        return pd.DataFrame({"shard": [key[0]], "lane": [key[1]], "vector": [sum(np.frombuffer(v, np.int64) for v in rows["vector"]).tobytes()]})

    def mark(frame):
        import numpy as np

        out = []
        for keys, vector in zip(frame["keys"], frame["vector"]):
            b, n = np.frombuffer(keys, np.int64) % _B, np.frombuffer(vector, np.int64)
            most = np.zeros(int(b.max()) + 1 if len(b) else 0, np.int64)
            np.maximum.at(most, b, n)
            out.append(np.where(n == most[b], -n, n).tobytes())
        return frame.assign(counts=out).drop(columns=["vector"])

    laned = local.withColumn("lane", F.floor(F.col("task") / _FAN_IN).cast("int"))
    tables = laned.select("shard", "lane").distinct().join(hashed, "shard").withColumnsRenamed({"shard": "of", "lane": "at"})
    schema = "shard int, lane int, vector binary"
    summed = laned.groupBy("shard", "lane").cogroup(tables.groupBy("of", "at")).applyInPandas(dense, schema)
    while lanes > 1:
        summed = summed.withColumn("lane", F.floor(F.col("lane") / _FAN_IN).cast("int")).groupBy("shard", "lane").applyInPandas(add, schema)
        lanes = (lanes - 1) // _FAN_IN + 1
    joined = hashed.join(summed.select("shard", "vector"), "shard")
    return steady(joined.mapInPandas(lambda frames: map(mark, frames), "shard int, levels array<int>, words binary, keys binary, counts binary"))


# ---- documents -------------------------------------------------------------------------------

_RESULT = "n_a long, n_b long, n_groups long, n_links long"


def _aligned(docs: DataFrame, spec, table, id_col: str, text_col: str) -> DataFrame:
    """Documents aligned again. With a table their counts are looked up; without one every
    distinct pair of a document is a row, with the row number that tells documents apart."""

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        stretches = Stretches(spec.value)
        scored = np.zeros((0, 2), np.int64)

        def score():
            """Sums over the links of stretches that are new."""
            many = stretches.sizes[len(scored) :, 3]
            count, best = table.value.find(stretches.links[len(stretches.links) - many.sum() :])
            stop = np.cumsum(many)
            up_to = lambda x: np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], stop])]
            return np.concatenate([scored, np.stack([np.diff(up_to(best.astype(np.int64))), np.diff(up_to(count))], 1)])

        for batch in batches:
            done = 0
            for texts in _text_groups(batch.column(2)):
                good, places, starts = _good(stretches, texts)
                if table is not None:
                    scored = score()
                per = np.concatenate([stretches.sizes, scored], 1) if table is not None else stretches.sizes
                wide = np.zeros((len(texts), per.shape[1]), np.int64)
                digests = [""] * len(texts)
                if good:
                    wide[good] = np.add.reduceat(per[places], starts)
                    listed = list(map(stretches.groups.__getitem__, places.tolist()))
                    for k, lo, hi in zip(good, starts.tolist(), [*starts[1:].tolist(), len(places)]):
                        digests[k] = hashlib.sha256(";".join(listed[lo:hi]).encode()).hexdigest()
                rows = [batch.column(0).slice(done, len(texts)), batch.column(1).slice(done, len(texts)), *(pa.array(c) for c in wide.T), pa.array(digests)]
                if table is None:
                    owner, pairs, n = [], [], []
                    many = stretches.sizes[:, 3]
                    stop = np.cumsum(many)
                    for k, lo, hi in zip(good, starts, np.append(starts[1:], len(places))):
                        of = places[lo:hi]
                        # Links of a document: those of its stretches, one stretch after another.
                        steps = np.arange(many[of].sum()) - np.repeat(np.cumsum(many[of]) - many[of], many[of])
                        each = np.unique(stretches.links[np.repeat(stop[of] - many[of], many[of]) + steps], return_counts=True)
                        owner += [k] * len(each[0])
                        pairs.append(each[0])
                        n.append(each[1])
                    rest = sorted(set(range(len(texts))) - set(good))
                    take = pa.array(owner + rest, pa.int64())
                    rows = [c.take(take) for c in rows]
                    empty = np.zeros(len(rest), np.int64)
                    rows += [pa.array(np.concatenate([*pairs, empty - 1]), pa.int64()), pa.array(np.concatenate([*n, empty]), pa.int64())]
                yield pa.RecordBatch.from_arrays(rows, names)
                done += len(texts)
                if len(stretches.groups) > _CACHE:
                    stretches.clear()
                    scored = np.zeros((0, 2), np.int64)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, row long, {_RESULT}"
    schema += (", n_best long, count_sum long" if table is not None else "") + ", groups_sha256 string" + ("" if table is not None else ", pair long, n long")
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    return rows.mapInArrow(run, schema)


def align(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", table_limit: int = _TABLE_LIMIT) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Texts are encoded by a byte-level vocabulary (A, with a space in front) and by a
    vocabulary of pieces (B), and aligned by bytes. A first pass counts linked pairs over the
    corpus: distinct pairs get numbers from a perfect hash, and dense vectors of counts
    are summed as a tree. A second pass aligns texts again and looks counts up; keys beside
    the counts verify each number. A table of more than ``table_limit`` pairs is not sent to
    the tasks: documents' pairs are then joined with it.

    Null and empty texts, and texts whose tokens do not give back the text's bytes, have no
    tokens: zeros and an empty digest. Texts of any length take linear time. Ties for the
    highest count of a B id all count as best. Repeated rows each count and come out as often as they come in; an
    empty table gives no rows; further columns are not read. Both files are read on the
    driver and sent to the tasks (2 MB).
    """
    spark = docs.sparkSession
    if byte_path is None or piece_path is None:
        import public_tokenizers

        byte_path, piece_path = byte_path or public_tokenizers.path("byte_bpe_50k.json"), piece_path or public_tokenizers.path("piece_bpe_32k.model")
    with open(byte_path, encoding="utf-8") as a, open(piece_path, "rb") as b:
        spec = spark.sparkContext.broadcast({"a": a.read(), "b": b.read()})
    counted = pair_counts(steady(local_counts(docs, spec, text_col)))
    pairs = counted.agg(F.coalesce(F.sum(F.octet_length("keys") / 8), F.lit(0))).first()[0]
    last = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if pairs <= table_limit:
        rows = counted.select("shard", "levels", "words", "keys", "counts").orderBy("shard").collect()
        table = spark.sparkContext.broadcast(PairTable([tuple(r) for r in rows]))
        return _aligned(docs, spec, table, id_col, text_col).select(*last)

    def unfold(frames):
        import numpy as np
        import pandas as pd

        for frame in frames:
            for keys, counts in zip(frame["keys"], frame["counts"]):
                n = np.frombuffer(counts, np.int64)
                yield pd.DataFrame({"pair": np.frombuffer(keys, np.int64), "count": np.abs(n), "best": n < 0})

    known = counted.select("keys", "counts").mapInPandas(unfold, "pair long, count long, best boolean")
    each = _aligned(docs, spec, None, id_col, text_col).join(known, "pair", "left")
    same = [F.first(c).alias(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
    return each.groupBy("row").agg(
        *same, F.coalesce(F.sum(F.when(F.col("best"), F.col("n"))), F.lit(0)).alias("n_best"),
        F.coalesce(F.sum(F.col("n") * F.col("count")), F.lit(0)).alias("count_sum"),
    ).select(*last)


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir))
