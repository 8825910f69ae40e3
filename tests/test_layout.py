"""Lines, tables and paragraphs on words with awkward places, against plain loops."""

import random
from statistics import median

from pyspark.sql import functions as F

from docflow.operators import layout as L

WORDS = (
    "doc_id int, page_no int, word_no int, text string, left double, right double, top double, bottom double, "
    "baseline double, font_size double, n_letters int, n_bold int"
)


def word(doc, no, text, left, bottom, height=10.0, size=11.0, bold=False):
    n = len(text)
    left, bottom = float(left), float(bottom)
    return (doc, 1, no, text, left, left + 6.0 * n, bottom + height, bottom, bottom, size, n, n if bold else 0)


def slow_lines(words):
    words = sorted((w for w in words if w[3].strip()), key=lambda w: (-(w[6] + w[7]) / 2, w[4], w[2]))
    groups, centre, height = [], 0.0, 0.0
    for w in words:
        c, h = (w[6] + w[7]) / 2, abs(w[6] - w[7])
        if groups and abs(c - centre) <= 0.5 * max(1.0, height, h):
            groups[-1].append(w)
            centre = (centre * (len(groups[-1]) - 1) + c) / len(groups[-1])
            height = max(height, h)
        else:
            groups.append([w])
            centre, height = c, h
    return [sorted(g, key=lambda w: w[4]) for g in groups]


def test_lines_match_a_loop(spark):
    rng = random.Random(4)
    rows = []
    for doc in range(6):
        for no in range(120):
            height = rng.choice([4.0, 8.0, 10.0, 14.0])
            rows.append(word(doc, no, "w" * rng.randint(1, 6), float(rng.randint(0, 4000)) / 8, rng.randint(0, 3200) / 4, height))
    built = L.build_lines(spark.createDataFrame(rows, WORDS))
    got = {(r.doc_id, r.line_no): [w.word_no for w in r.words] for r in built.collect()}
    for doc in range(6):
        want = slow_lines([r for r in rows if r[0] == doc])
        mine = [got[doc, i + 1] for i in range(len(want))]
        assert [sorted(x) for x in mine] == [sorted(w[2] for w in g) for g in want]
        assert (doc, len(want) + 1) not in got


def test_line_stats_and_metrics(spark):
    rows = [
        word(1, 0, "Big", 50, 700, size=20.0, bold=True), word(1, 1, "title", 80, 700, size=20.0, bold=True),
        word(1, 2, "one", 50, 680), word(1, 3, "two", 74, 680), word(1, 4, "three", 100, 680), word(1, 5, "  ", 300, 680),
    ]
    lines = L.line_stats(L.build_lines(spark.createDataFrame(rows, WORDS)))
    first, second = lines.orderBy("line_no").collect()
    assert (first.text, first.font_size, first.is_bold, first.left, first.right) == ("Big title", 20.0, True, 50.0, 110.0)
    assert (second.text, second.is_bold, second.top, second.bottom) == ("one two three", False, 690.0, 680.0)
    page = L.page_metrics(lines).collect()[0]
    assert page.body_size == median([20.0] * 8 + [11.0] * 11)
    assert (page.min_left, page.max_right, page.max_top) == (50.0, 130.0, 710.0)
    assert page.median_gap == median([12.0, 6.0, 8.0])
    kinds = [r.kind for r in L.classify_lines(lines, L.page_metrics(lines)).orderBy("line_no").collect()]
    assert kinds == ["Heading1", "Paragraph"]


def slow_runs(gaps):
    runs, i = [], 0
    while i < len(gaps):
        j = i + 1
        while gaps[i] and j < len(gaps) and len(gaps[j]) == len(gaps[i]) and all(abs(a - b) <= 5 for a, b in zip(gaps[i], gaps[j])):
            j += 1
        if j - i >= 2:
            runs.append((i, j))
            i = j
        else:
            i += 1
    return runs


def test_tables_match_a_loop(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for doc in range(8):
        gaps, drift = [], 0.0
        for n in range(40):
            drift = rng.choice([drift, drift + 3, drift - 4, 0.0])
            columns = rng.choice([0, 1, 1, 2, 2])
            gaps.append([100.0 + drift + 80 * k for k in range(columns)])
            rows.append((doc, 1, n + 1, gaps[-1]))
        want[doc] = slow_runs(gaps)
    frame = spark.createDataFrame(rows, "doc_id int, page_no int, line_no int, gaps array<double>")
    got = {(r.doc_id, r.line_no): (r.table_no, r.row_no) for r in L.detect_tables(frame).collect()}
    for doc, runs in want.items():
        mine = {(i + 1): (None, None) for i in range(40)}
        for number, (a, b) in enumerate(runs, 1):
            mine.update({i + 1: (number, i - a + 1) for i in range(a, b)})
        assert {n: got[doc, n] for n in mine} == mine


def slow_paragraphs(lines):
    out, group = [], []
    for line in lines:
        no, left, base, size, kind, table = line
        if table:
            group = []
            out.append(None)
            continue
        stays = False
        if group and group[0][4] == kind and kind != "ListItem":
            prev = group[-1]
            tall, gap = max(1.0, prev[3], size), prev[2] - base
            body = group[1][1] if len(group) > 1 else prev[1]
            stays = 0 < gap <= 1.6 * tall and (
                abs(left - body) <= max(8, 1.2 * tall)
                or (len(group) == 1 and left < prev[1] and prev[1] - left <= 3 * tall)
            )
        group = [*group, line] if stays else [line]
        number = max((p for p in out if p), default=0)
        out.append(number if stays else number + 1)
    return out


def test_paragraphs_match_a_loop(spark):
    rng = random.Random(21)
    rows = []
    for doc in range(6):
        base = 800.0
        for n in range(60):
            base -= rng.choice([14.0, 14.0, 14.0, 14.0, 20.0, 0.0])
            rows.append((doc, 1, n + 1, 50.0 + rng.choice([0, 0, 0, 9, 20, 34, -15]), base, rng.choice([11.0, 11.0, 12.0]),
                         rng.choice(["Paragraph"] * 6 + ["ListItem", "Heading3"]), rng.choice([None] * 8 + [1])))
    frame = spark.createDataFrame(
        rows, "doc_id int, page_no int, line_no int, left double, baseline double, font_size double, kind string, table_no int")
    got = {(r.doc_id, r.line_no): r.para_no for r in L.paragraph_groups(frame).collect()}
    for doc in range(6):
        want = slow_paragraphs([r[2:] for r in rows if r[0] == doc])
        assert [got[doc, n + 1] for n in range(60)] == want


def test_end_of_line_hyphens_are_taken_out(spark):
    line = lambda n, text: (1, 1, n, text, 50.0, 100.0, 800.0 - 14 * n, 790.0 - 14 * n, "Paragraph", 1, 50.0, 500.0)
    frame = spark.createDataFrame(
        [line(1, "exam-"), line(2, "ple 5-"), line(3, "6 end")],
        "doc_id int, page_no int, line_no int, text string, left double, right double, top double, bottom double, kind string, "
        "para_no int, min_left double, max_right double")
    assert L.paragraph_build(frame).collect()[0].text == "example 5- 6 end"


def test_cells_are_padded_and_spans_leave_blanks(spark):
    cells = spark.createDataFrame(
        [(1, 1, 1, "a", 2), (1, 1, 2, "b", 1), (1, 2, 1, "c", 1), (1, 3, 1, None, 1)],
        "t int, row_no int, cell_no int, text string, span int")
    got = {(r.row_no, r.col_no): r.text for r in L.complete_cells(cells, ["t"]).collect()}
    assert [got[r, c] for r in (1, 2, 3) for c in (1, 2, 3)] == ["a", "", "b", "c", "", "", "", "", ""]


def test_half_point_sizes(spark):
    frame = spark.createDataFrame([(10.24,), (10.25,), (2.0,), (200.0,), (float("nan"),), (-1.0,)], "s double")
    assert [r[0] for r in frame.select(L.font_half_points(F.col("s"))).collect()] == [10.0, 10.5, 4.0, 96.0, 11.0, 11.0]
