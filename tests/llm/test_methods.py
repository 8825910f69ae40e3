"""Each operator against a plain loop, a library or held-out labels, on the small tables."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from docflow.llm import bpe, components, crf, divergence, exact, langid, lines, mixing, pii, repeats, simhash

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Sets:
    """Union-find of a plain loop."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def test_components(spark):
    import random

    random.seed(3)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 2000 + i) for i in range(200)]
    sets = Sets()
    for a, b in edges:
        sets.join(a, b)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: sets.find(x) for x in {x for e in edges if e[0] != e[1] for x in e}}


def test_simhash_links(spark):
    """All links at up to three bits, and none at four, whatever the parity and the bits."""
    import random

    random.seed(5)
    prints = set()
    for _ in range(40):
        base = random.getrandbits(64)
        prints.add(base)
        for bits in (1, 2, 3, 4, 5):
            flipped = base
            for bit in random.sample(range(64), bits):
                flipped ^= 1 << bit
            prints.add(flipped)
    sets, prints = Sets(), sorted(prints)
    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                sets.join(a, b)
    signed = spark.createDataFrame([(simhash._signed(x),) for x in prints], "fp long")
    for source in (signed, simhash.with_partner(signed)):
        mine = Sets()
        for r in simhash.ball_links(source).collect():
            mine.join(r["a"] % 2**64, r["b"] % 2**64)
        assert {x: mine.find(x) for x in prints} == {x: sets.find(x) for x in prints}


def test_near_dedup(spark, docs, texts):
    import xxhash

    def fingerprint(text):
        words = WORD.findall(text.translate(ASCII))
        parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0

    want = {d: fingerprint(t) for d, t in texts.items()}
    sets, ids = Sets(), sorted(want)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (want[a] ^ want[b]).bit_count() <= 3:
                sets.join(a, b)
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.near_dedup(docs).collect()}
    assert got == {d: (want[d], sets.find(d)) for d in ids}


def test_merge_runs_of_any_fan_in(docs):
    want = sorted(map(tuple, exact.exact_dedup(docs).collect()))
    for runs, fan_in in ((1, 2), (5, 2), (64, 3)):
        assert sorted(map(tuple, exact.exact_dedup(docs.repartition(7), runs=runs, fan_in=fan_in).collect())) == want


def test_mix_meets_targets(docs):
    rows = mixing.mix(docs).collect()
    taken, most = defaultdict(int), defaultdict(int)
    for r in rows:
        taken[r["source"]] += r["taken"]
        most[r["source"]] = max(most[r["source"]], r["size"])
        assert r["taken"] <= 3 * r["size"]
    target = {r["source"]: r["target"] for r in rows}
    size = {r["source"]: r["source_size"] for r in rows}
    for source in target:
        assert abs(taken[source] - target[source]) <= most[source] / 2 + 1e-6
        assert target[source] <= 3 * size[source]
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6 * sum(size.values())


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 1000, 1000, 1], [0, 5, 7], [0, 0], [100], [1, 2, 3, 4, 5, 6, 7, 8]])
def test_targets_by_rounds(spark, sizes):
    """Against sharing again and again until no target is above its cap."""
    total, weight = float(sum(sizes)), [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    fixed, target = set(), [0.0] * len(sizes)
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        rest = total - sum(3 * sizes[i] for i in fixed)
        for i in free:
            target[i] = rest * weight[i] / sum(weight[j] for j in free)
        over = [i for i in free if target[i] > 3 * sizes[i] + 1e-9]
        if not over:
            break
        for i in over:
            target[i] = 3.0 * sizes[i]
            fixed.add(i)
    table = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(table).collect()}
    assert got == pytest.approx({f"s{i}": t for i, t in enumerate(target)})


def test_bpe_as_the_library(spark, docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = [
        "", " ", "<|endoftext|>a<|startoftext|> B", "x" * 700, "ab" * 3000, "World's they'll I'D 'S", "İΣΑΣ ς ẞ ﬃ ½", "日本語 🙂👍🏽 é",
        "a\u0085b\x1cc　d​e", "".join(chr(i) for i in range(1, 0x530)), "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa!!!!!!!!!!!!!!",
    ]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    known = texts | {10**6 + i: t for i, t in enumerate(odd)}
    for r in bpe.decode(bpe.encode(table)).collect():
        ids = library.encode(known[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids, known[r["doc_id"]][:50]
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_language_of_held_out_documents(docs):
    labels = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in langid.identify(docs).collect() if r["held_out"]]
    assert len(held) > 30
    assert sum(r["lang_pred"] == labels[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in held)


def test_automaton_reads_substrings_only():
    data = [1, 2, 1, 1, 2, 3, 1, 2]
    step = langid.suffix_automaton(data)
    there = {tuple(data[i:j]) for i in range(len(data)) for j in range(i, len(data) + 1)}

    def walk(state, word):
        assert word in there
        for symbol in (1, 2, 3, 4):
            assert (symbol in step[state]) == (word + (symbol,) in there)
            if symbol in step[state]:
                walk(step[state][symbol], word + (symbol,))

    walk(0, ())


def test_phrases_by_a_plain_parse():
    samples = {"a": b"the cat sat on the mat", "b": b"der hund und die katze"}
    parser = langid.Parser(samples)
    texts = [b"the cat and the hund", b"", b"xyz", b"katze katze sat", b"the mat " * 300]
    got = parser.phrases(texts)
    for i, text in enumerate(texts):
        for k, lang in enumerate(parser.langs):
            phrases = 0
            for start in range(0, len(text), 1024):
                block, at, phrases = text[start : start + 1024], 0, phrases + 1
                while at < len(block):
                    size = 0
                    while at + size < len(block) and block[at : at + size + 1] in samples[lang]:
                        size += 1
                    at += size
                    if at < len(block):  # the next symbol starts a phrase, known or not
                        phrases += 1
                        at += bytes([block[at]]) not in samples[lang]
            assert got[i, k] == phrases, (text, lang)


def test_quality_of_held_out_documents(spark):
    big = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{big}/labels.parquet")
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [r for r in crf.classify(spark.read.parquet(f"{big}/documents.parquet"), labels).collect() if r["held_out"] and r["doc_id"] in quality]
    good = [r["score"] for r in rows if quality[r["doc_id"]] == 1]
    bad = [r["score"] for r in rows if quality[r["doc_id"]] == 0]
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) >= 0.95 * len(good) * len(bad)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_marginals_by_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    chain = crf.Chain(None, rng.normal(size=(2, 2)), None, None)
    lengths = np.array([4, 3, 1])
    scores = rng.normal(size=(3, 4))
    good, moved, norm = chain.marginals(scores, lengths)
    total_moves = np.zeros((2, 2))
    for row, n in enumerate(lengths):
        weights = {}
        for path in itertools.product((0, 1), repeat=int(n)):
            weights[path] = np.exp(sum(scores[row, t] * y for t, y in enumerate(path)) + sum(chain.moves[a, b] for a, b in zip(path, path[1:])))
        z = sum(weights.values())
        assert np.isclose(np.log(z), norm[row])
        for t in range(n):
            assert np.isclose(sum(w for p, w in weights.items() if p[t]) / z, good[row, t])
        for path, w in weights.items():
            for a, b in zip(path, path[1:]):
                total_moves[a, b] += w / z
    assert np.allclose(total_moves, moved)


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _base(text):
    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "phone" and 9 <= len(digits) <= 15
                    or kind == "card" and 13 <= len(digits) <= 19 and _luhn(digits)):
                out.append((pii.KINDS.index(kind), m.start(), m.end()))
    return out


def test_personal_data(spark, docs):
    odd = [
        "a@b.c+x@d.e", "1.2.3.4.5.6.7.8 300.1.2.3 001.002.003.004 1.2.3", "4111 1111-1111 1111", "+1+2+3 4 5 6 7 8 9 0", "é😀 a@b.co +49 30 1234567.",
        "", None, "1" * 20000, "a@" + "b." * 3000 + "c", "7 " * 5000, "8-" * 100 + "12.1.1.1", "1.1.1.1 " * 500, "x" * 3000 + "@y.z", "@@ a@ @b a@b",
        "call +1 (269) 555-3296 4524132264652876 now",
    ]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    known = {r["doc_id"]: r["text"] or "" for r in table.collect()}
    found = pii.find_pii(table).collect()
    assert len(found) == len(known)
    for r in found:
        base, spans = [tuple(x) for x in r["base"]], [tuple(x) for x in r["spans"]]
        assert base == _base(known[r["doc_id"]]), known[r["doc_id"]][:60]
        assert set(base) <= set(spans) and spans == sorted(spans)


def test_trees_find_what_runs_on(spark):
    """A phone number and a card that one base match swallows, learnt from the others."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    text = "the +1 (269) 555-3296 4524132264652876 end, id 4524132264652875"
    more = spark.createDataFrame([(10**6, text)], "doc_id long, text string")
    row = pii.find_pii(docs.unionByName(more)).where("doc_id = 1000000").first()
    assert row["base"] == [] and [(x["kind"], text[x["start"] : x["end"]]) for x in row["spans"]] == [(2, "4524132264652876"), (3, "+1 (269) 555-3296")]
    clean = pii.redact(docs.unionByName(more)).where("doc_id = 1000000").first()
    assert clean["text"] == "the [phone] [card] end, id 4524132264652875"


def test_rare_kinds_beside_a_common_one(spark):
    """Kinds that are few among very many e-mails keep their threshold."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    text = "the +1 (269) 555-3296 4524132264652876 end, id 4524132264652875"
    mails = "concat_ws(' ', transform(sequence(1, 200), k -> concat('u', id, 'x', k, '@host', k, '.org')))"
    lists = spark.range(2_000_000, 2_004_000).selectExpr("id doc_id", f"{mails} text")
    more = spark.createDataFrame([(10**6, text)], "doc_id long, text string")
    row = pii.find_pii(docs.unionByName(more).unionByName(lists)).where("doc_id = 1000000").first()
    assert [(x["kind"], text[x["start"] : x["end"]]) for x in row["spans"]] == [(2, "4524132264652876"), (3, "+1 (269) 555-3296")]


def test_base_rules(docs, texts):
    for r in divergence.divergence_rules(docs).collect():
        text = texts[r["doc_id"]]
        words = WORD.findall(text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        times, covered = Counter(windows), set()
        for i, w in enumerate(windows):
            if times[w] > 1:
                covered |= {i, i + 1, i + 2}
        worded = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(worded) - len(set(worded)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r["base_failed"] and r["kept"])


def test_junk_is_far_from_its_language(spark):
    big = "/root/testdata/sf0.01"
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    rows = [r for r in divergence.divergence_rules(spark.read.parquet(f"{big}/documents.parquet")).collect() if r["doc_id"] in quality and not r["base_failed"]]
    good = [r["kept"] for r in rows if quality[r["doc_id"]] == 1]
    bad = [r["kept"] for r in rows if quality[r["doc_id"]] == 0]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_passages_across_documents(spark, docs, texts):
    passage = "Anon the first of it. " + " ".join(f"W{i} said x{i % 7} to y{i} and went." for i in range(9)) + " So it is told"
    hosts = [(10**6 + i, f"Host {i} begins here with {i} words. Then {i} comes {passage} by number {i} and ends so{i}. Last words {i}.") for i in range(4)]
    clean = [(2 * 10**6, "Nothing here is said twice. It is a text of its own, written for once and for all, with care.")]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(hosts + clean, "doc_id long, text string"))
    spans = [r for r in repeats.repeated_spans(table).collect() if r["doc_id"] >= 10**6]
    assert {r["doc_id"] for r in spans} == {10**6 + i for i in (1, 2, 3)}
    for r in spans:
        cut = hosts[r["doc_id"] - 10**6][1][r["start"] : r["stop"]]
        assert cut.startswith("W0 said") and cut.endswith("went.") and r["first_doc_id"] == 10**6
        first = hosts[0][1][r["first_start"] :]
        assert first.startswith("W0 said")
    out = {r["doc_id"]: r for r in repeats.substring_dedup(table).collect()}
    for d, text in hosts[1:]:
        span = out[d]["removed"][0]
        assert out[d]["text"] == text[: span["start"]] + text[span["stop"] :]
    assert out[2 * 10**6]["text"] == clean[0][1]


def test_unique_lines_between_repeats_stay(spark):
    """A header and a footer are shared, what stands between them is not, or is."""
    head, foot = "this page was made for all who read it here today", "all of the text above is free to use by any one who asks for it"
    own = {1: "alpha one\nbeta\ngamma three", 2: "delta\nepsilon two\nzeta", 3: "alpha one\nbeta\ngamma three"}
    table = spark.createDataFrame([(d, f"{head}\n{body}\n{foot}") for d, body in own.items()], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in repeats.substring_dedup(table).collect()}
    assert own[1] in out[1] and own[2] in out[2]
    assert "alpha" not in out[3]


def test_copies_without_spaces(spark):
    """Copies of texts whose lines are one word each, or whose sentences are short."""
    chinese = "".join(f"第{chr(0x4E00 + 7 * i)}次他们走到{chr(0x5E00 + 11 * i)}边去看。" for i in range(30))
    thai = "\n".join("".join(chr(0x0E01 + (i * j) % 40) for j in range(1, 30)) for i in range(1, 12))
    short = " ".join(f"Go {chr(97 + i % 26)}{i}!" for i in range(40))
    mine = {1: chinese, 2: thai, 3: short}
    table = spark.createDataFrame([(d + at, t) for d, t in mine.items() for at in (0, 10)] + [(20, chinese[:5] + "，别的话都没有。")], "doc_id long, text string")
    spans = {(r["doc_id"], r["start"], r["stop"]) for r in repeats.repeated_spans(table).collect()}
    assert spans == {(d + 10, 0, len(t)) for d, t in mine.items()}
    for text in (chinese, thai, short, "...a b\n!!! x?y。z！ .. \n?"):
        cut = repeats.cut_units(text)
        assert "".join("".join(text[a:b].split()) for a, b, *_ in cut) == "".join(text.split())


def test_short_and_partly_shared_passages(spark):
    """Repeated lines under 25 words go, and passages that share no sentence whole."""
    import random

    random.seed(4)
    word = lambda: "".join(random.choices("abcdefghijklmnoprstuvw", k=6))
    some = lambda n: " ".join(word() for _ in range(n))
    line = "all rights are reserved here"
    pages = [(i, f"{some(30)}.\n{line}\n{some(12)}") for i in range(3)]
    passages = [some(50) for _ in range(100)]
    hosts = [(100 * at + i, f"{some(9)} {p} {some(9)}") for at in (1, 2) for i, p in enumerate(passages)]
    table = spark.createDataFrame(pages + hosts, "doc_id long, text string")
    spans = {(r["doc_id"], hosts_text[r["start"] : r["stop"]]) for r in repeats.repeated_spans(table).collect() for hosts_text in [dict(pages + hosts)[r["doc_id"]]]}
    assert {s for s in spans if s[0] < 100} == {(1, line), (2, line)}
    assert all(d >= 200 and text in passages[d - 200] for d, text in spans if d >= 100)
    assert len({d for d, _ in spans if d >= 200}) >= 90
    assert sum(len(text.split()) for d, text in spans if d >= 200) >= 0.6 * 50 * len(passages)


def test_line_groups(spark, docs, texts):
    occ = [(d, i, x.strip(" ").lower()) for d, t in texts.items() for i, x in enumerate(t.split("\n")) if x.strip(" ")]

    def shingles(line):
        p = re.findall(r"[^\s]{1,4}\s?", line)
        return frozenset(zip(p, p[1:], p[2:])) if len(p) >= 3 else frozenset([tuple(p)])

    sets, shapes = Sets(), {x: shingles(x) for x in {o[2] for o in occ}}
    index = defaultdict(set)
    for x, s in shapes.items():
        for h in s:
            index[h].add(x)
    for x, s in shapes.items():
        for y in {y for h in s for y in index[h]}:
            k = len(s & shapes[y])
            if x < y and k >= 0.8 * (len(s) + len(shapes[y]) - k):
                sets.join(x, y)
    first = {}
    for d, i, x in sorted(occ):
        first.setdefault(sets.find(x), (d, i))
    want = {(d, i): first[sets.find(x)] for d, i, x in occ}
    got = {(r["doc_id"], r["line_no"]): (r["keep_doc_id"], r["keep_line_no"]) for r in lines.line_verdicts(docs).collect()}
    assert got.keys() == want.keys()
    assert sum(got[k] != want[k] for k in want) <= 0.01 * len(want)


def test_shingles_at_every_position(spark):
    """A letter put into text without spaces changes five shingles and moves no other."""
    chinese = "".join(chr(0x4E00 + 37 * i) for i in range(60))
    url = "://example.org/" + "".join(chr(97 + i * i % 23) + str(i) for i in range(35))
    mine = [chinese, chinese[:30] + "新" + chinese[30:], "http" + url, "https" + url, "🙂👍🏽é" * 3 + "ab", "abc", "abcde", "abcdef"]
    rows = spark.createDataFrame(list(enumerate(mine)), "doc_id long, text string")
    sizes = {r["doc_id"]: r["n"] for r in rows.selectExpr("doc_id", "text").select("doc_id", lines.F.size(lines.F.array_distinct(lines.shingles(lines.F.col("text")))).alias("n")).collect()}
    assert sizes == {i: len({x[k : k + 5] for k in range(max(1, len(x) - 4))}) for i, x in enumerate(mine)}
    kept = {r["doc_id"]: r["kept"] for r in lines.line_verdicts(rows).collect()}
    assert [kept[i] for i in range(4)] == [True, False, True, False]


def test_pipeline(spark, docs, texts):
    """Every stage's effect by plain loops on what the stages before it kept."""
    import corpus_pipeline as pipeline

    assert [name for name, _ in pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "encode_decode"]
    rows = pipeline.run(spark, SF_DIR).collect()
    kept = {r["doc_id"] for r in langid.identify(docs).collect() if r["lang_pred"] != "und"}
    best = {}
    for d in sorted(kept):
        best[texts[d].translate(ASCII)] = d
    kept = set(best.values())
    some = docs.where(docs.doc_id.isin(sorted(kept)))
    near = {r["doc_id"]: r["component_id"] for r in simhash.near_dedup(some).collect()}
    some = docs.where(docs.doc_id.isin(sorted(set(near.values()))))
    epochs = Counter({r["doc_id"]: r["epochs"] for r in mixing.mix(some).collect() if r["epochs"]})
    assert Counter(r["doc_id"] for r in rows) == epochs
    tokens = {r["doc_id"]: r["ids"] for r in bpe.encode(docs).collect()}
    for r in rows:
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, tokens[r["doc_id"]])).encode()).hexdigest()
