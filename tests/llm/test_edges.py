"""Every operator and stage on what no table should hold but some do: nulls, empty and very
long texts, ties, repeated rows, no rows, and columns named like those of results."""

from collections import Counter

import pytest

from docflow.llm import bpe, crf, divergence, exact, langid, lines, mixing, pii, repeats, simhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "kept boolean, fp string, component_id string, size string, key string, `end` int, line string, id int, __key int, words array<string>, label int, p string, target int, first int, n int, version string, digest string"
LONG = "Anon the word of it was here. " * 4000

ROWS = [
    (1, "Anon the one of it was here today.", "en", "a", 10),
    (2, "Anon the one of it was here today.", "en", "a", 10),
    (2, "Anon the one of it was here today.", "en", "a", 10),
    (3, "ANON the one of it was here today.", None, None, None),
    (4, "", "en", "a", 0),
    (5, None, "en", None, None),
    (6, None, None, "b", 0),
    (7, " \n\t \n", "fr", "b", 5),
    (8, LONG, "en", "b", len(LONG)),
    (9, "x" * 200_000, "en", "c", 200_000),
    (10, "12345 +++ ?!", "de", "c", 12),
    (None, "A text without an id has its say as well, one supposes.", "en", "a", 1),
    (None, None, None, None, None),
    (11, "\x00́ é😀   a\u0085b", "fr", "", 3),
    (12, "La une de fr.\nLa une de fr.\nle la", "fr", "", 3),
]
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, None), (3, None, 1), (8, 1, 0), (9, 0, 0), (None, 1, 1), (77, 0, 0), (4, 0, 0), (12, 1, 0)], LABELS)


def clash(df):
    """The same table with further columns named like those of results and of steps."""
    names = [c.strip() for c in CLASHING.split(", ")]
    return df.selectExpr("*", *(f"cast(null as {c.split(' ', 1)[1]}) as {c.split(' ', 1)[0]}" for c in names))


OPERATORS = {
    "repeats": lambda d, y: repeats.repeated_spans(d),
    "substring": lambda d, y: repeats.substring_dedup(d),
    "lines": lambda d, y: lines.line_verdicts(d),
    "line_dedup": lambda d, y: lines.line_dedup(d),
    "divergence": lambda d, y: divergence.divergence_rules(d),
    "simhash": lambda d, y: simhash.near_dedup(d),
    "pii": lambda d, y: pii.find_pii(d),
    "exact": lambda d, y: exact.exact_dedup(d),
    "crf": lambda d, y: crf.classify(d, y),
    "bpe": lambda d, y: bpe.encode_decode(d),
    "mixing": lambda d, y: mixing.mix(d),
    "langid": lambda d, y: langid.identify(d),
}
PER_ROW = ("divergence", "simhash", "pii", "exact", "crf", "bpe", "mixing", "langid", "substring", "line_dedup")


def rows(df):
    return Counter(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd, none, labels, name):
    run = OPERATORS[name]
    got = rows(run(odd, labels))
    if name in PER_ROW:
        assert sum(got.values()) == len(ROWS)
    assert rows(run(clash(odd), labels)) == got
    assert rows(run(none, labels)) == Counter()


def test_odd_results(odd, labels):
    by = lambda df: {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}
    copies = by(exact.exact_dedup(odd))
    assert copies[1]["keep_id"] == copies[3]["keep_id"] == 3 and copies[1]["group_size"] == 4
    assert copies[4]["keep_id"] == 6 and copies[5]["group_size"] == 4
    near = by(simhash.near_dedup(odd))
    assert near[2]["component_id"] == 1 and near[4]["fp"] == 0 and near[7]["component_id"] == near[5]["component_id"] == 4
    langs = by(langid.identify(odd))
    assert [langs[i]["lang_pred"] for i in (4, 5, 7, 10)] == ["und"] * 4 and langs[5]["score"] == 0.0
    tokens = by(bpe.encode(odd))
    assert tokens[4]["ids"] == tokens[5]["ids"] == [] and tokens[7]["ids"] == []
    rules = by(divergence.divergence_rules(odd))
    assert rules[5]["n_words"] == 0 and rules[5]["base_failed"] and rules[12]["n_dup_lines"] == 1
    assert rules[8]["n_repeat_words"] == rules[8]["n_words"] == 28000
    scores = by(crf.classify(odd, labels))
    assert all(0 <= r["score"] <= 1 for r in scores.values()) and scores[4]["score"] == scores[5]["score"]
    mix = by(mixing.mix(odd))
    assert mix[4]["size"] == mix[5]["taken"] == 0
    assert all(r["source_size"] >= r["size"] for r in mix.values())
    kept = {(r["doc_id"], r["line_no"]): r["kept"] for r in lines.line_verdicts(odd).collect()}
    assert kept[1, 0] and not kept[2, 0] and not kept[3, 0] and kept[12, 0] and not kept[12, 1]


def test_without_labels(spark, odd, labels):
    got = crf.classify(odd, labels.where("false")).collect()
    assert {r["score"] for r in got} == {0.5}
    assert {r["lang_pred"] for r in langid.identify(odd.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def test_stages(spark, odd, none):
    import corpus_pipeline as pipeline

    for name, stage in pipeline.STAGES:
        got = stage(spark, odd, "")
        if name != pipeline.STAGES[-1][0]:
            assert got.columns == odd.columns
            assert stage(spark, clash(odd), "").columns == clash(odd).columns
        counts = Counter(r["doc_id"] for r in got.collect())
        assert Counter(r["doc_id"] for r in stage(spark, clash(odd), "").collect()) == counts
        assert stage(spark, none, "").count() == 0
        if name == "language_id":
            assert not counts.keys() & {4, 5, 6, 7, 10} and counts[2] == 2
        if name == "exact_dedup":
            assert counts[3] == 1 and not counts.keys() & {1, 2, 4, 5}
        if name == "near_dedup":
            assert counts[1] == 1 and not counts.keys() & {2, 3, 5, 6, 7}
        if name == "mix_sources":
            assert counts[2] <= 6 and max(n for d, n in counts.items() if d not in (2, None)) <= 3


def test_every_row_alike(spark):
    """One text a thousand times, and one source."""
    same = spark.range(1000).selectExpr("id as doc_id", "'Anon the one of it was here today.\nNo.' as text", "'en' as lang", "'a' as source")
    assert {(r["keep_id"], r["group_size"]) for r in exact.exact_dedup(same).collect()} == {(999, 1000)}
    assert {r["component_id"] for r in simhash.near_dedup(same).collect()} == {0}
    assert lines.line_verdicts(same).where("kept").count() == 2
    assert {r["taken"] for r in mixing.mix(same).collect()} == {9}
