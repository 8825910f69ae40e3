"""Rows that share an id, or have none, are judged by their own text."""

import pytest

from docflow.llm import langid, lines, mixing, pii, simhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "a", 1) for i, t in texts], COLUMNS)


def test_redact(spark):
    texts = [(1, "write to ann.lee@example.com now"), (1, "nothing of interest here"), (None, "call ben@example.org"), (None, "plain"), (2, None), (2, "")]
    got = sorted(((r.doc_id, r.text) for r in pii.redact(table(spark, texts)).collect()), key=str)
    assert got == sorted([(1, "write to [email] now"), (1, "nothing of interest here"), (None, "call [email]"), (None, "plain"), (2, None), (2, "")], key=str)


def test_line_dedup(spark):
    shared = "A line that is shared by many of the documents here"
    texts = [(None, f"{shared}\nFirst text alone has this one"), (None, f"Second text alone has that line\n{shared}"), (3, shared), (3, f"{shared}\nThird and last, unlike all of the others")]
    got = sorted(r.text for r in lines.line_dedup(table(spark, texts)).collect())
    whole = "\n".join(got)
    assert len(got) == 4 and whole.count(shared) == 1
    assert all(x in whole for x in ("First text alone has this one", "Second text alone has that line", "Third and last, unlike all of the others"))


def test_unknown_languages(spark):
    texts = [(i, "the cat sat on the mat and the dog ran") for i in range(6)] + [(None, "the dog and the cat"), (None, "½ ²³ Ⅷ 12"), (7, "Ⅷ"), (7, "the mat")]
    got = sorted(((r.doc_id, r.text) for r in langid.drop_unknown(table(spark, texts)).collect()), key=str)
    assert got == sorted([(i, t) for i, t in texts if "the" in t], key=str)


def test_near_copies(spark):
    a, b = "one two three four five six seven eight nine ten", "quite another text that has nothing to do with it at all"
    texts = [(5, a), (5, b), (3, b), (None, a), (None, "yet something else, which only this row says to us"), (9, "last of all texts in this small table"), (9, "last of all texts in this small table")]
    got = sorted(((r.doc_id, r.text[:5]) for r in simhash.drop_near_copies(table(spark, texts)).collect()), key=str)
    assert got == sorted([(5, "one t"), (3, "quite"), (None, "yet s"), (9, "last ")], key=str)


@pytest.mark.parametrize("same_text", [False, True])
def test_mix(spark, same_text):
    texts = [(None, "w " * 40 + ("" if same_text else f"x{i}")) for i in range(20)] + [(i, "v " * 100) for i in range(30)]
    docs = spark.createDataFrame([(i, t, "en", "a" if i is None else "b", 1) for i, t in texts], COLUMNS)
    planned = mixing.mix(docs).selectExpr("sum(taken)").first()[0]
    taken = sum(len(r.text.split()) for r in mixing.mixed(docs).collect())
    assert taken == planned


def test_a_part_far_into_a_text_is_learned(spark):
    """Training texts open with a stretch in another language."""
    head, en, fr = "0123 " * 400, "the cat and the dog sat upon that mat with them " * 60, "le chat et le chien sont assis sur ce tapis avec eux " * 60
    rows = [(i, head + (en if i % 2 else fr), "en" if i % 2 else "fr", "a", 1) for i in range(60)]
    got = langid.identify(spark.createDataFrame(rows, COLUMNS)).collect()
    assert all(r.lang_pred == ("en" if r.doc_id % 2 else "fr") for r in got)
