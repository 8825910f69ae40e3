"""Spelling variants against all pairs of words that share a deletion."""

import re
from collections import Counter, defaultdict
from zlib import crc32

import pytest

from docflow.llm import variants

LETTERS = "abcdefghijklmnopqrstuvwxyz"
ODD = [
    (None, None), (None, "Straße Straße straße straß strasse"), (4, ""), (5, "\n 12 _ "),
    (1, " ".join(f"abcdefghijklmnop{a}{b} " * 3 for a in LETTERS[:8] for b in LETTERS + "éü")),  # one gram in every word
    (2, " ".join((a * k + " ") * 3 for a in "abz" for k in range(5, 40))),
    (3, "aaaab aaaab aaaab aaaaab aaaaab aaaaab abaaab abaaab abaaab"),
    (6, ("y" * 20_000 + " ") * 4 + ("y" * 20_001 + " ") * 9),
    (7, " ".join((("qwe" * k)[:m] + a + "rty ") * 3 for a in "abc" for k in (20, 22, 30) for m in range(52, 70))),
    (8, "Tiger tiger TIGER tigers tigers tigers liger liger liger"), (8, "Tiger tiger TIGER tigers tigers tigers liger liger liger"),
]


def plain(rows):
    count, lower = Counter(), {i: i + 32 for i in range(65, 91)}
    for doc, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = word.translate(lower)
            h = crc32(f"{'' if doc is None else doc}:{word}".encode())
            count[word[: h % len(word)] + word[h % len(word) + 1 :] if h % 97 == 0 else word] += 1
    n = {w: k for w, k in count.items() if len(w) >= 5 and k >= 3}
    near, same = defaultdict(set), defaultdict(list)
    for w in n:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            same[crc32(rest.encode()), rest[:50], i].append(w)
            if rest in n:
                near[w].add(rest)
                near[rest].add(w)
    for group in same.values():
        for a in group:
            near[a] |= {b for b in group if a != b and len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1}
    form = {w: f for w in n if near[w] for f in [min(near[w], key=lambda x: (-n[x], x))] if n[f] >= 2 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [400, 6])
def test_as_all_pairs(spark, least):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + ODD
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in variants.variant_groups(df, least=least).collect()]
    assert sorted(got, key=str) == plain(rows)


def test_no_rows_and_clashing_names(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert variants.variant_groups(none).collect() == []
    df = spark.createDataFrame([(1, "tiger " * 9 + "tigre " * 3 + "tigers " * 4, "x", 1)], "doc_id long, text string, word string, n int")
    assert {r["word"]: r["form"] for r in variants.variant_groups(df).collect()} == {"tiger": None, "tigre": None, "tigers": "tiger"}


def test_entries_of_a_word_stay_few():
    frequent = {"yy": 999, "yyy": 999, "yyyy": 999, "yyyyy": 999, "yyyyyy": 999, "yyyyyyy": 999, "yyyyyyyy": 999}
    assert len(variants.post("y" * 100_000, frequent)) == 4
    assert len(variants.post("y" * 60, frequent)) < 300
