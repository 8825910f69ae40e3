"""Token alignment against both libraries and a plain walk over bytes."""

import hashlib
from collections import Counter
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from docflow.llm import alignment

ODD = [
    (None, None), (1, ""), (2, " "), (3, "  a\n b  c \n\n d"), (4, "a▁b c"), (5, "<|endoftext|> <s> x</s>"), (7, "y" * 30_000), (7, "�\x00 a"),
    (6, "中文字 测试 x 。😀 é́ \x1f y\x1c z  q  r"), (8, "one two"), (8, "one two"),
]


def plain(rows):
    a = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = {c: i for i, c in enumerate(alignment._letters())}
    found, count = {}, Counter()
    for k, (_, text) in enumerate(rows):
        if not text:
            continue
        raw, e, ids = (" " + text).encode(), a.encode(" " + text, add_special_tokens=False), b.encode(text)
        of_a = [bytes(letters[c] for c in t) for t in e.tokens]
        of_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids]
        if b"".join(of_a) != raw or b"".join(of_b) != raw:
            continue
        ends_a, ends_b = list(accumulate(map(len, of_a))), list(accumulate(map(len, of_b)))
        links, at = [], 0
        for i, end in enumerate(ends_a):
            while ends_b[at] <= end - len(of_a[i]):
                at += 1
            j = at
            while j < len(ids) and ends_b[j] - len(of_b[j]) < end:
                links.append((e.ids[i], ids[j]))
                j += 1
        groups, x, y = [], 0, 0
        for cut in sorted({*ends_a} & {*ends_b}):
            side_a, side_b = [], []
            while x < len(ends_a) and ends_a[x] <= cut:
                side_a.append(str(e.ids[x]))
                x += 1
            while y < len(ends_b) and ends_b[y] <= cut:
                side_b.append(str(ids[y]))
                y += 1
            groups.append(",".join(side_a) + "|" + ",".join(side_b))
        found[k] = len(of_a), len(of_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()
        count.update(links)
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    out = []
    for k, (doc, _) in enumerate(rows):
        if k not in found:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        na, nb, ng, links, digest = found[k]
        out.append((doc, na, nb, ng, len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), digest))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [16_000_000, 0])
def test_as_the_libraries(spark, limit):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + ODD
    # 40 pieces: the tree of count vectors has more than one level.
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    got = sorted((tuple(r) for r in alignment.align(df, table_limit=limit).collect()), key=str)
    assert got == plain(rows)


def test_no_rows_and_clashing_names(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(none).collect() == []
    df = spark.createDataFrame([(1, "one two", 1, 2, "x")], "doc_id long, text string, n_a int, pair int, row string")
    assert alignment.align(df).first()["n_links"] >= 2


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**40, 20_000) * alignment._B)  # B id 0: one shard
    words, sizes, order = alignment.perfect_hash(keys)
    assert sorted(order) == sorted(keys)
    table = alignment.PairTable([(0, sizes, words.tobytes(), order.tobytes(), np.arange(len(order)).tobytes())])
    assert (table.find(order)[0] == np.arange(len(order))).all()
    strange = order + 1_000 * alignment._SHARDS
    assert not table.find(strange[~np.isin(strange, order)])[0].any()
