"""HTML extraction: reading pages, decoding without contradictions, pages in layouts not seen."""

from itertools import product

import numpy as np
import pytest

from docflow.llm import html

PAGES = "/root/testdata/sf0.001/pages.parquet"


def test_reading():
    tree = html.Tree('<div>a &amp; b<br>c<p>x<b>y</b> z<p>w</div>tail<script>var t="</p>";</script>&lt;q <td>u<!-- no --><style>p{}</style><ul><li>1<li>2</ul>')
    assert [t for t in tree.texts if t] == ["a & b c", "xy z", "w", "tail<q", "u", "1", "2"]
    assert [t for t in html.Tree("<p>one &am two\n\t three &copy 3 < 4 <a href='x").texts if t] == ["one &am two three © 3 < 4"]
    assert html.Tree("").texts == [None]


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "x" + "</span>" * 1000, '<a="' * 100_000, "<p><li>" * 30_000 + "<" * 30_000, "<!--" * 100_000, "<ul><li><div>" * 20_000])
def test_any_page_ends(page):
    tree = html.Tree(page)
    assert all(up < i for i, up in enumerate(tree.parent)) and tree.stop[0] == len(tree.parent)
    assert html.features([tree]).shape[0] == len(tree.parent)


def test_best_choice_by_enumeration():
    tree = html.Tree("<div>a<p>b</p><div><p>c</p>d</div></div><p>e</p>")
    rng = np.random.default_rng(3)
    for _ in range(20):
        odds = rng.normal(size=len(tree.parent))
        fits = [c for c in product([False, True], repeat=len(odds)) if all(not y or up < 0 or c[up] for y, up in zip(c, tree.parent))]
        want = max(sum(odds[np.array(c, bool)]) for c in fits)
        got = np.array(html.choose(tree, odds))
        assert tuple(got) in {tuple(c) for c in fits} and abs(odds[got].sum() - want) < 1e-9


@pytest.fixture(scope="module")
def model(spark):
    return html.fit(spark.read.parquet(PAGES))


def test_articles_of_the_pages(spark, model):
    pages = spark.read.parquet(PAGES)
    got = {r["page_id"]: r for r in html.extract(pages, model).collect()}
    assert len(got) == pages.count()
    right = 0
    for page, text in pages.select("page_id", "html").collect():
        tree, main = html._labelled(text)
        right += got[page]["text"] == "\n\n".join(t for t, y in zip(tree.texts, main) if y)
        assert got[page]["n_chars"] == len(got[page]["text"])
    assert right >= 0.95 * len(got)


def test_layouts_not_seen(spark, model):
    pages = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("page_id >= 150").select("html").collect()]
    found = html.layouts(pages, 2, seed=99)[len(pages) :]
    scores, at, missed, extra, whole = model.odds(html.features([t for t, _ in found])), 0, 0, 0, 0
    for tree, main in found:
        chosen = html.choose(tree, scores[at : at + len(main)])
        at += len(main)
        for text, y, kept in zip(tree.texts, main, chosen):
            missed += len(text or "") * (y and not kept)
            extra += len(text or "") * (kept and not y)
            whole += len(text or "") * y
    assert missed < 0.1 * whole and extra < 0.1 * whole


def test_odd_rows(spark, model):
    rows = [(1, "u", None), (2, None, ""), (None, None, None), (3, "u", "<p>"), (3, "u", "<p>"), (4, "u", "plain text"), (5, "u", "<article>" + "<p>Long enough text of a page.</p>" * 20_000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "'x' as n_chars", "0 as label")
    got = [tuple(r) for r in html.extract(df, model).collect()]
    assert len(got) == len(rows) and all(g[2] == "" and g[3] == 0 for g in got if g[0] in (1, 2, 3, None))
    assert html.extract(df.limit(0), model).collect() == []
    # Without a page that marks its article there is nothing to learn from.
    bare = spark.createDataFrame([(1, "u", "<div>" + "A sentence of prose. " * 9 + "</div><ul><li><a href='/'>Home</a></li></ul>")], "page_id long, url string, html string")
    assert html.extract(bare).first()["text"].startswith("A sentence")
