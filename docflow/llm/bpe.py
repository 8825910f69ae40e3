"""Byte-pair encoding and decoding of whole texts with a vocabulary file."""

from __future__ import annotations

import json
import sys
from itertools import chain

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm.common import documents, query

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# How the vocabulary's format cuts text into words.
_PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_VECTOR_LIMIT = 64  # longest word, in symbols, that is merged together with others
_CACHE_LIMIT = 400_000  # words a task remembers before it starts anew
_NONE = 2**62


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it is printable, else the
    next letter from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, spare = [], 256
    for byte in range(256):
        letters.append(chr(byte if byte in plain else spare))
        spare += byte not in plain
    return letters


def load(path: str) -> dict:
    """Vocabulary, merges and special tokens of a tokenizer file, as plain values."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    model = data["model"]
    return {
        "vocab": model["vocab"], "merges": [tuple(m) for m in model["merges"]],
        "end": model["end_of_word_suffix"], "special": {t["content"]: t["id"] for t in data["added_tokens"]},
    }


class Codec:
    """Encodes and decodes on one task. ``merge_words`` holds the method: a segment tree
    over the ranks of adjacent pairs, whose root is the leftmost pair of the lowest rank."""

    def __init__(self, spec: dict):
        import numpy as np
        import regex

        vocab, end = spec["vocab"], spec["end"]
        self.special = {t: np.int32(i).tobytes() for t, i in spec["special"].items()}
        letters = byte_letters()
        self.inner = np.array([vocab.get(c, -1) for c in letters], dtype=np.int64)
        self.last = np.array([vocab.get(c + end, -1) for c in letters], dtype=np.int64)
        self.base = 1 + max(vocab.values())
        pairs = {}
        for rank, (left, right) in enumerate(spec["merges"]):
            pairs[vocab[left] * self.base + vocab[right]] = (rank, vocab[left + right])
        keys = np.array(sorted(pairs), dtype=np.int64)
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.ranks = np.array([pairs[k][0] for k in keys.tolist()] + [0], dtype=np.int64)
        self.made = np.zeros(len(pairs) + 1, dtype=np.int64)  # by rank
        for rank, token in pairs.values():
            self.made[rank] = token
        self.pairs = pairs
        self.cut = regex.compile(_PIECE)
        self.mark = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}  # ids of a word, four bytes each

    def normal(self, text: str) -> str:
        """NFC and lower case letter by letter. White space only parts words, so its runs may
        stay as they are."""
        import unicodedata

        if text.isascii():
            return text.lower()
        # Lower case that looks at neighbours exists for one letter only, the sigma.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def pair_ranks(self, left, right):
        """Ranks of pairs of symbols, ``_NONE`` where no merge exists."""
        import numpy as np

        key = left * self.base + right
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], _NONE)

    def merge_words(self, symbols):
        """Merge a matrix of words of one length until no mergeable pair remains. Returns the
        symbols and which of them are left."""
        import numpy as np

        many, n = symbols.shape
        alive = np.ones((many, n), dtype=bool)
        if n == 1:
            return symbols, alive
        width = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = np.full((many, 2 * width), _NONE, dtype=np.int64)
        ranks = self.pair_ranks(symbols[:, :-1], symbols[:, 1:])
        tree[:, width : width + n - 1] = np.where(ranks < _NONE, ranks * width + np.arange(n - 1), _NONE)
        for i in range(width - 1, 0, -1):
            tree[:, i] = np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1])
        after = np.tile(np.arange(1, n + 1), (many, 1))
        before = np.tile(np.arange(-1, n - 1), (many, 1))

        def put(rows, leaf, value):
            node = leaf + width
            tree[rows, node] = value
            while width > 1 and node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        def set_pair(rows, left, right):
            rank = self.pair_ranks(symbols[rows, left], symbols[rows, right])
            put(rows, left, np.where(rank < _NONE, rank * width + left, _NONE))

        while len(rows := np.flatnonzero(tree[:, 1] < _NONE)):
            best = tree[rows, 1]
            left = best % width
            right = after[rows, left]
            symbols[rows, left] = self.made[best // width]
            alive[rows, right] = False
            beyond = after[rows, right]
            after[rows, left] = beyond
            dead = right < n - 1  # the last symbol starts no pair
            if dead.any():
                put(rows[dead], right[dead], _NONE)
            inner = beyond < n
            before[rows[inner], beyond[inner]] = left[inner]
            if inner.any():
                set_pair(rows[inner], left[inner], beyond[inner])
            if not inner.all():
                put(rows[~inner], left[~inner], _NONE)
            prior = before[rows, left]
            led = prior >= 0
            if led.any():
                set_pair(rows[led], prior[led], left[led])
        return symbols, alive

    def merge_long(self, symbols: list[int]) -> list[int]:
        """The same for one long word, without arrays."""
        n = len(symbols)
        width = 1 << (n - 2).bit_length()
        tree = [_NONE] * (2 * width)

        def key(left: int, right: int) -> int:
            found = self.pairs.get(symbols[left] * self.base + symbols[right]) if symbols[left] >= 0 <= symbols[right] else None
            return found[0] * width + left if found else _NONE

        def put(leaf: int, value: int) -> None:
            node = leaf + width
            tree[node] = value
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        for i in range(n - 1):
            tree[width + i] = key(i, i + 1)
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        while tree[1] < _NONE:
            rank, left = divmod(tree[1], width)
            right = after[left]
            symbols[left], alive[right] = int(self.made[rank]), False
            beyond = after[left] = after[right]
            if right < n - 1:
                put(right, _NONE)
            if beyond < n:
                before[beyond] = left
            put(left, key(left, beyond) if beyond < n else _NONE)
            if before[left] >= 0:
                put(before[left], key(before[left], left))
        return [s for s, a in zip(symbols, alive) if a]

    def learn(self, words) -> None:
        """Encode words into the cache, all of one length at once."""
        import numpy as np

        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            data = word.encode("utf-8", "surrogatepass")
            by_length.setdefault(len(data), []).append((word, data))
        for n, group in by_length.items():
            for start in range(0, len(group), 8192):
                some = group[start : start + 8192]
                raw = np.frombuffer(b"".join(d for _, d in some), dtype=np.uint8).reshape(len(some), n)
                symbols = self.inner[raw]
                symbols[:, -1] = self.last[raw[:, -1]]
                if n > _VECTOR_LIMIT:
                    for (word, _), row in zip(some, symbols.tolist()):
                        self.cache[word] = np.array([s for s in self.merge_long(row) if s >= 0], dtype="<i4").tobytes()
                    continue
                symbols, alive = self.merge_words(symbols)
                alive &= symbols >= 0
                flat, ends = symbols[alive].astype("<i4").tobytes(), (4 * np.cumsum(alive.sum(axis=1))).tolist()
                begin = 0
                for (word, _), stop in zip(some, ends):
                    self.cache[word] = flat[begin:stop]
                    begin = stop

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token ids of whole texts, packed in four bytes each. Special tokens in a text are
        found before anything else."""
        cut, special = self.cut, self.special
        pieces = []  # per text: lists of words, and packed ids of special tokens
        for text in texts:
            parts = self.mark.split(text) if self.mark and any(s in text for s in special) else [text]
            pieces.append([special[p] if p in special else cut.findall(self.normal(p)) for p in parts])
        if len(self.cache) > _CACHE_LIMIT:
            self.cache.clear()
        lists = [p for parts in pieces for p in parts if isinstance(p, list)]
        self.learn(set(chain.from_iterable(lists)).difference(self.cache))
        known = self.cache.__getitem__
        return [b"".join([b"".join(map(known, p)) if isinstance(p, list) else p for p in parts]) for parts in pieces]


class Names:
    """Decodes: tokens joined by one space, as the file has no decoder that would join words.
    Ids outside the vocabulary are left out."""

    def __init__(self, spec: dict):
        import pyarrow as pa

        names = {i: t for t, i in spec["vocab"].items()} | {i: t for t, i in spec["special"].items()}
        self.table = pa.array([names.get(i) for i in range(max(names) + 1)], pa.string())

    def decode(self, ids):
        """Texts of an array of lists of ids; a null list gives empty text."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        flat = ids.flatten().to_numpy(zero_copy_only=False)
        there = (flat >= 0) & (flat < len(self.table))
        tokens = self.table.take(pa.array(np.where(there, flat, 0), pa.int32(), mask=~there))
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        starts = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        joined = pc.binary_join(pa.ListArray.from_arrays(starts, _plain(tokens)), " ") if there.all() else None
        if joined is None:  # rare: leave out what has no name, list by list
            lists = pa.ListArray.from_arrays(starts, tokens).to_pylist()
            joined = pa.array([" ".join(t for t in some if t is not None) for some in lists], pa.string())
        return joined


def _plain(tokens):
    return tokens.combine_chunks() if hasattr(tokens, "combine_chunks") else tokens


def _lists(packed: list[bytes]):
    """Packed ids as an array of lists."""
    import numpy as np
    import pyarrow as pa

    starts = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])])
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(np.frombuffer(b"".join(packed), dtype="<i4"), pa.int32()))


def _groups(texts, most: int = 2_000_000):
    """Runs of texts of bounded length together, so that a batch of long texts is no batch."""
    group, size = [], 0
    for text in texts:
        value = text.as_py() or ""
        if group and size + len(value) > most:
            yield group
            group, size = [], 0
        group.append(value)
        size += len(value)
    if group:
        yield group


def _spread_spec(spark: SparkSession, path: str | None):
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return spark.sparkContext.broadcast(load(path))


def _encoded(docs: DataFrame, path: str | None, id_col: str, text_col: str, decoded: bool) -> DataFrame:
    spec = _spread_spec(docs.sparkSession, path)

    def run(batches):
        import pyarrow as pa

        codec, names = Codec(spec.value), Names(spec.value)
        for batch in batches:
            done = 0
            for group in _groups(batch.column(1)):
                ids = _lists(codec.encode(group))
                columns = [batch.column(0).slice(done, len(group)), ids] + ([names.decode(ids)] if decoded else [])
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])
                done += len(group)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>"
    return rows.mapInArrow(run, schema + ", decoded string" * decoded)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the token ids of every whole text, null as empty text, without added
    special tokens.

    ``path`` names the vocabulary file; it is read on the driver and sent to the tasks. Empty
    texts have no ids. Repeated rows come out as often as they come in, an empty table gives
    no rows, further columns of the input are not read.
    """
    return _encoded(docs, path, id_col, text_col, decoded=False)


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids, decoded``: the text of every list of ids. Null ids decode to empty text,
    ids outside the vocabulary are left out."""
    spec = _spread_spec(tokens.sparkSession, path)

    def run(batches):
        import pyarrow as pa

        names = Names(spec.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), names.decode(batch.column(1))], ["doc_id", "ids", "decoded"])

    rows = tokens.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256. Ids are decoded where they
    are made, so a task holds one vocabulary."""
    return _encoded(docs, path, id_col, text_col, decoded=True).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op8_bpe")
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir))
