"""Queries from positioned words to lines, tables, paragraphs and slides."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.functions.text import BULLETS, DASHES, line_count
from docflow.operators import layout as L
from docflow.operators import slides as SL
from docflow.plans.registry import query, table
from docflow.plans.values import LINES_SQL, doc_lines
from docflow.sources.files import write_parts
from docflow.sources.placing import dealt, scratch, settle, spread

# ---- words of the documents -----------------------------------------------------------

DOCS_SQL = "SELECT doc_id, replace(text, 'e' || chr(10), 'e-' || chr(10)) AS text FROM documents"
RAW_WORDS_SQL = f"""
t AS (SELECT doc_id, line_no, unnest(range(0, len(toks)))::INTEGER AS word_no, unnest(toks) AS text FROM (
  SELECT doc_id, unnest(range(0, len(ls)))::INTEGER AS line_no, string_split(unnest(ls), ' ') AS toks
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM ({{docs}})))),
a AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ofs FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY word_no)::INTEGER - 1 AS k FROM a WHERE text <> ''),
w0 AS (SELECT doc_id, (line_no // 50 + 1)::INTEGER AS page_no, line_no, k AS word_no, text, (50 + 6 * ofs)::DOUBLE AS lft,
  (50 + 6 * ofs + 6 * length(text))::DOUBLE AS rgt, (810 - 14 * (line_no % 50))::DOUBLE AS top, (800 - 14 * (line_no % 50))::DOUBLE AS bottom,
  (800 - 14 * (line_no % 50))::DOUBLE AS baseline, CASE WHEN line_no = 0 THEN 18.0::DOUBLE ELSE 11.0 END AS font_size, false AS is_bold,
  length(text)::INTEGER AS n_letters, 0 AS n_bold FROM r)"""
# Words off their line by up to a point, some lines bold, some indented.
WORDS_SQL = RAW_WORDS_SQL.format(docs=DOCS_SQL) + """,
w AS (SELECT doc_id, page_no, line_no AS src_line, word_no, text, lft + CASE WHEN line_no % 5 = 3 THEN 20 ELSE 0 END AS lft,
  rgt + CASE WHEN line_no % 5 = 3 THEN 20 ELSE 0 END AS rgt, top + (word_no % 3) * 0.5::DOUBLE AS top, bottom + (word_no % 3) * 0.5::DOUBLE AS bottom,
  baseline, font_size, n_letters, CASE WHEN line_no % 7 = 3 THEN n_letters ELSE 0 END AS n_bold,
  dense_rank() OVER (PARTITION BY doc_id, page_no ORDER BY line_no)::INTEGER AS line_no FROM w0)"""
STATS_SQL = WORDS_SQL + """,
l AS (SELECT doc_id, page_no, line_no, string_agg(text, ' ' ORDER BY lft) AS text, min(lft) AS lft, max(rgt) AS rgt, max(top) AS top,
  min(bottom) AS bottom, median(baseline) AS baseline, max(font_size) AS font_size, sum(n_bold) >= 0.7 * sum(n_letters) AS is_bold FROM w GROUP BY ALL)"""
METRICS_SQL = STATS_SQL + """,
g0 AS (SELECT doc_id, page_no, lft - lag(rgt) OVER (PARTITION BY doc_id, page_no, line_no ORDER BY lft) AS gap FROM w),
g AS (SELECT doc_id, page_no, median(gap) AS gap FROM g0 WHERE gap > 0 AND gap < 100 GROUP BY ALL),
z AS (SELECT doc_id, page_no, sum(n_letters) FILTER (WHERE font_size = 11) AS n11, sum(n_letters) FILTER (WHERE font_size = 18) AS n18 FROM w GROUP BY ALL),
b AS (SELECT doc_id, page_no, CASE WHEN coalesce(n18, 0) > coalesce(n11, 0) THEN 18 WHEN coalesce(n18, 0) < coalesce(n11, 0) THEN 11 ELSE 14.5 END::DOUBLE AS body_size FROM z),
m AS (SELECT l.doc_id, l.page_no, any_value(body_size) AS body_size, min(lft) AS min_left, max(rgt) AS max_right, max(top) AS max_top, coalesce(any_value(gap), 2.0) AS median_gap
  FROM l JOIN b USING (doc_id, page_no) LEFT JOIN g USING (doc_id, page_no) GROUP BY ALL)"""


def words(spark, sf):
    """Words of the documents, in pieces: some lines further right, some words higher, some lines bold."""
    docs = dealt(table(spark, sf, "documents").select("doc_id", "text"), 2_000, "doc_id")
    hyphened = docs.withColumn("text", F.replace("text", F.lit("e\n"), F.lit("e-\n")))
    return L.pieces_from_text(
        hyphened, "doc_id", "text", shift=lambda line: F.when(line % 5 == 3, 20.0).otherwise(0.0), lifts=(0.0, 0.5, 1.0),
        bold=lambda line: line % 7 == 3,
    )


def lines(spark, sf):
    return L.line_stats(L.build_lines(words(spark, sf)))


@query("words_from_text", f"WITH {RAW_WORDS_SQL.format(docs='SELECT * FROM documents')} SELECT * RENAME (lft AS \"left\", rgt AS \"right\") FROM w0")
def words_from_text(spark, sf):
    return L.words_from_text(spread(table(spark, sf, "documents")), "doc_id", "text")


@query("build_lines", f"WITH {WORDS_SQL} SELECT doc_id, page_no, line_no, word_no, text, lft AS \"left\" FROM w")
def build_lines(spark, sf):
    built = L.build_lines(words(spark, sf))
    return built.select("doc_id", "page_no", "line_no", F.explode("words").alias("w")).select(
        "doc_id", "page_no", "line_no", "w.word_no", "w.text", "w.left"
    )


@query("line_stats", f"WITH {STATS_SQL} SELECT * RENAME (lft AS \"left\", rgt AS \"right\") FROM l")
def line_stats(spark, sf):
    return lines(spark, sf).drop("words")


@query("page_metrics", f"WITH {METRICS_SQL} SELECT * FROM m")
def page_metrics(spark, sf):
    return L.page_metrics(lines(spark, sf))


KIND_SQL = METRICS_SQL + """,
k AS (SELECT l.*, m.min_left, m.max_right, CASE WHEN regexp_matches(text, '^\\s*([""" + BULLETS + "]|[" + DASHES + """]\\s|\\(?\\d{1,3}\\s*[.)]\\s|\\(?[a-zA-Zа-яА-Я]\\s*[.)]\\s)') THEN 'ListItem'
  WHEN length(text) > 200 THEN 'Paragraph' WHEN font_size / body_size >= 1.6 THEN 'Heading1' WHEN font_size / body_size >= 1.3 THEN 'Heading2'
  WHEN font_size / body_size >= 1.15 OR (is_bold AND length(text) <= 120) THEN 'Heading3' ELSE 'Paragraph' END AS kind
  FROM l JOIN m USING (doc_id, page_no))"""


def classified(spark, sf):
    return L.classify_lines(lines(spark, sf))


@query("classify_lines", f"WITH {KIND_SQL} SELECT doc_id, page_no, line_no, kind FROM k")
def classify_lines(spark, sf):
    return classified(spark, sf).select("doc_id", "page_no", "line_no", "kind")


ALIGN_SQL = (
    "CASE WHEN abs((lft + rgt) / 2 - 297.5) <= 595 * 0.035::DOUBLE AND lft - min_left > 595 * 0.06::DOUBLE THEN 'Center' "
    "WHEN max_right - rgt <= 2 AND lft - min_left > 595 * 0.12::DOUBLE THEN 'Right' ELSE 'Left' END"
)


@query("alignment", f"""
WITH {RAW_WORDS_SQL.format(docs='SELECT * FROM documents')},
l0 AS (SELECT doc_id, page_no, line_no, min(lft) AS lft, max(rgt) AS rgt FROM w0 GROUP BY ALL),
l AS (SELECT doc_id, page_no, line_no, lft + 40 * (line_no % 4) AS lft, rgt + 40 * (line_no % 4) AS rgt FROM l0),
m AS (SELECT *, min(lft) OVER p AS min_left, max(rgt) OVER p AS max_right FROM l WINDOW p AS (PARTITION BY doc_id, page_no))
SELECT doc_id, page_no, line_no, {ALIGN_SQL} AS alignment FROM m""")
def alignment(spark, sf):
    flat = words_from_text(spark, sf).groupBy("doc_id", "page_no", "line_no").agg(
        F.min("left").alias("left"), F.max("right").alias("right")
    )
    shift = 40.0 * (F.col("line_no") % 4)
    boxes = flat.withColumn("left", F.col("left") + shift).withColumn("right", F.col("right") + shift)
    margins = boxes.groupBy("doc_id", "page_no").agg(F.min("left").alias("min_left"), F.max("right").alias("max_right"))
    return boxes.join(margins, ["doc_id", "page_no"]).select(
        "doc_id", "page_no", "line_no", L.alignment(F.col("left"), F.col("right")).alias("alignment")
    )


PARA_SQL = KIND_SQL + """,
c AS (SELECT *, lag(kind) OVER p AS pk, lag(baseline) OVER p AS pb, lag(font_size) OVER p AS pf FROM k WINDOW p AS (PARTITION BY doc_id, page_no ORDER BY line_no)),
d AS (SELECT *, pk IS NULL OR pk <> kind OR kind = 'ListItem' OR pb - baseline <= 0 OR pb - baseline > 1.6 * greatest(1, pf, font_size) AS cut,
  greatest(1, coalesce(pf, 0), font_size) AS tall FROM c),
f AS (SELECT doc_id, page_no, line_no, lft AS prev, 0.0::DOUBLE AS second, 1 AS n, 1 AS para_no FROM d WHERE line_no = 1
  UNION ALL SELECT d.doc_id, d.page_no, d.line_no, d.lft, CASE WHEN s.keep AND s.n + 1 = 2 THEN d.lft WHEN s.keep THEN s.second ELSE 0.0 END,
    CASE WHEN s.keep THEN s.n + 1 ELSE 1 END, s.para_no + CASE WHEN s.keep THEN 0 ELSE 1 END
  FROM (SELECT f.*, x.line_no AS nl, NOT x.cut AND (abs(x.lft - CASE WHEN f.n >= 2 THEN f.second ELSE f.prev END) <= greatest(8, 1.2 * x.tall)
          OR (f.n = 1 AND x.lft < f.prev AND f.prev - x.lft <= 3 * x.tall)) AS keep
        FROM f JOIN d x ON x.doc_id = f.doc_id AND x.page_no = f.page_no AND x.line_no = f.line_no + 1) s
  JOIN d ON d.doc_id = s.doc_id AND d.page_no = s.page_no AND d.line_no = s.nl)"""


def grouped(spark, sf):
    # Once lines are measured and told apart, their words are no longer needed.
    return L.paragraph_groups(classified(spark, sf).drop("words").withColumn("table_no", F.lit(None).cast("int")))


@query("paragraph_groups", f"WITH RECURSIVE {PARA_SQL} SELECT doc_id, page_no, line_no, para_no FROM f")
def paragraph_groups(spark, sf):
    return grouped(spark, sf).select("doc_id", "page_no", "line_no", "para_no")


@query("paragraph_build", f"""
WITH RECURSIVE {PARA_SQL},
q AS (SELECT k.*, f.para_no, lead(f.para_no) OVER (PARTITION BY k.doc_id, k.page_no ORDER BY k.line_no) AS np FROM k JOIN f USING (doc_id, page_no, line_no)),
p AS (SELECT doc_id, page_no, para_no, any_value(kind) AS kind, string_agg(CASE WHEN np IS DISTINCT FROM para_no THEN text
    WHEN regexp_matches(text, '\\p{{L}}[-‐]$') THEN left(text, length(text) - 1) ELSE text || ' ' END, '' ORDER BY line_no) AS text,
  min(lft) AS lft, max(rgt) AS rgt, max(top) AS t, min(bottom) AS b, any_value(min_left) AS min_left, any_value(max_right) AS max_right, count(*)::INTEGER AS n_lines FROM q GROUP BY ALL)
SELECT doc_id, page_no, para_no, kind, text, {ALIGN_SQL} AS alignment, lft AS "left", 842 - t AS top, rgt - lft AS width, t - b AS height,
  lft - min_left AS indent, CASE WHEN kind LIKE 'Heading%' THEN 8.0::DOUBLE ELSE 6.0 END AS space_after, n_lines FROM p""")
def paragraph_build(spark, sf):
    return L.paragraph_build(grouped(spark, sf))


# ---- tables ---------------------------------------------------------------------------

CELL_VALUES = ("l_partkey", "l_suppkey", "CAST(l_quantity AS INT)", "l_linenumber")
TABLE_ROWS_SQL = """
i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INTEGER AS rn FROM lineitem),
x AS (SELECT l_orderkey AS doc_id, rn, l_suppkey, (l_suppkey % 3 + CASE WHEN l_suppkey % 10 = 0 THEN 20 ELSE 0 END)::DOUBLE AS shift,
  unnest(range(0, CASE WHEN l_suppkey % 7 = 0 THEN 3 ELSE 4 END)) AS c,
  unnest([l_partkey::VARCHAR, l_suppkey::VARCHAR, l_quantity::INTEGER::VARCHAR, l_linenumber::VARCHAR][1:CASE WHEN l_suppkey % 7 = 0 THEN 3 ELSE 4 END]) AS v FROM i),
tw AS (SELECT doc_id, rn AS line_no, c, v, 50 + 150 * c + shift AS lft, 50 + 150 * c + shift + 6 * (5 + length(v)) AS rgt,
   50 + 150 * c + shift + 6 * (3 + length(v)) + 6 AS last_left FROM x)"""


def table_words(spark, sf):
    """Line items written as table rows, a piece of a page each: four cells of three words at fixed places."""
    from pyspark.sql import Window

    row = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    shift = (F.col("l_suppkey") % 3 + F.when(F.col("l_suppkey") % 10 == 0, 20).otherwise(0)).cast("double")
    # A line item becomes twelve words.
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = dealt(items, 50_000, "l_orderkey").select(
        F.col("l_orderkey").alias("doc_id"), (800 - 14.0 * (row - 1)).alias("bottom"), shift.alias("shift"),
        F.when(F.col("l_suppkey") % 7 == 0, 9).otherwise(12).alias("n"), *(F.expr(f"CAST({v} AS STRING)").alias(f"v{c}") for c, v in enumerate(CELL_VALUES)),
    )

    def cell(c: int) -> list:
        at, v = 50 + 150.0 * c + F.col("shift"), F.col(f"v{c}")
        return [(F.lit("no"), F.lit(2), at), (v, F.length(v), at + 18), (F.lit("x"), F.lit(1), at + 24 + 6.0 * F.length(v))]

    words = [word for c in range(len(CELL_VALUES)) for word in cell(c)]
    some = lambda *values: F.slice(F.array(*values), F.lit(1), F.col("n"))
    same = lambda value: F.array_repeat(value, F.col("n"))
    return rows.select("doc_id", F.lit(1).alias("page_no"), L.piece(
        some(*(left for _, _, left in words)), some(*(left + 6.0 * k for _, k, left in words)), same(F.col("bottom")), some(*(k for _, k, _ in words)),
        same(F.lit(0)), some(*(F.lit(i) for i in range(len(words)))), some(*(text for text, _, _ in words)), F.col("bottom"), F.lit(11.0), 10.0,
    ).alias("words"))


def gapped(spark, sf):
    return L.column_gaps(L.line_stats(L.build_lines(table_words(spark, sf))))


def tabled(spark, sf):
    # Tables and cells need no more of a word than its place and its text.
    slim = F.arrays_zip(*(F.col(f"words.{f}").alias(f) for f in ("left", "right", "text")))
    return L.detect_tables(gapped(spark, sf).withColumn("words", slim))


GAPS_SQL = TABLE_ROWS_SQL + """,
gp AS (SELECT doc_id, line_no, c, lft AS x FROM tw WHERE c > 0),
ga AS (SELECT doc_id, line_no, list(x ORDER BY c) AS gaps FROM gp GROUP BY ALL)"""


@query("column_gaps", f"WITH {GAPS_SQL} SELECT doc_id, 1 AS page_no, line_no, c::INTEGER AS gap_no, x FROM gp")
def column_gaps(spark, sf):
    return gapped(spark, sf).select("doc_id", "page_no", "line_no", F.posexplode("gaps").alias("i", "x")).select(
        "doc_id", "page_no", "line_no", (F.col("i") + 1).alias("gap_no"), "x"
    )


TABLES_SQL = GAPS_SQL + """,
an AS (SELECT doc_id, line_no, line_no AS anchor, gaps FROM ga WHERE line_no = 1
  UNION ALL SELECT n.doc_id, n.line_no, CASE WHEN s.ok THEN s.anchor ELSE n.line_no END, CASE WHEN s.ok THEN s.gaps ELSE n.gaps END
  FROM (SELECT an.*, y.line_no AS nl, len(an.gaps) = len(y.gaps) AND list_bool_and(list_transform(list_zip(an.gaps, y.gaps), lambda z: abs(z[1] - z[2]) <= 5)) AS ok
        FROM an JOIN ga y ON y.doc_id = an.doc_id AND y.line_no = an.line_no + 1) s
  JOIN ga n ON n.doc_id = s.doc_id AND n.line_no = s.nl),
rs AS (SELECT doc_id, line_no, anchor, count(*) OVER (PARTITION BY doc_id, anchor) AS n FROM an),
tb AS (SELECT doc_id, line_no, dense_rank() OVER (PARTITION BY doc_id ORDER BY anchor)::INTEGER AS table_no, (line_no - anchor + 1)::INTEGER AS row_no FROM rs WHERE n >= 2)"""


@query("detect_tables", f"WITH RECURSIVE {TABLES_SQL} SELECT ga.doc_id, 1 AS page_no, ga.line_no, table_no, row_no FROM ga LEFT JOIN tb USING (doc_id, line_no)")
def detect_tables(spark, sf):
    return tabled(spark, sf).select("doc_id", "page_no", "line_no", "table_no", "row_no")


EDGES_SQL = TABLES_SQL + """,
bx AS (SELECT doc_id, table_no, min(lft) AS lo, max(rgt) AS hi FROM tw JOIN tb USING (doc_id, line_no) GROUP BY ALL),
av AS (SELECT doc_id, table_no, c, avg(x) AS x FROM gp JOIN tb USING (doc_id, line_no) GROUP BY ALL),
ed AS (SELECT doc_id, table_no, list(x - 2 ORDER BY c) AS xs FROM av GROUP BY ALL),
ee AS (SELECT doc_id, table_no, list_concat([lo - 1], list_concat(xs, [hi + 1])) AS e FROM ed JOIN bx USING (doc_id, table_no)),
rw AS (SELECT *, list_transform(range(1, len(e)), lambda k: greatest(1.0::DOUBLE, e[k + 1] - e[k])) AS raw FROM ee),
fl AS (SELECT *, list_transform(raw, lambda v: greatest(v, list_avg(raw) * 0.6::DOUBLE)) AS wide FROM rw)"""


@query("column_edges", f"""
WITH RECURSIVE {EDGES_SQL}
SELECT doc_id, 1 AS page_no, table_no, unnest(range(1, len(e)))::INTEGER AS col_no, round_even(unnest(e[1:len(e)-1]), 6) AS edge_lo, round_even(unnest(e[2:]), 6) AS edge_hi,
  round_even(unnest(list_transform(wide, lambda v: v / list_sum(wide))), 6) AS width FROM fl""")
def column_edges(spark, sf):
    edges = L.column_edges(tabled(spark, sf))
    pairs = F.arrays_zip(F.slice("edges", F.lit(1), F.size("edges") - 1).alias("lo"), F.slice("edges", F.lit(2), F.size("edges")).alias("hi"), F.col("widths").alias("w"))
    return edges.select("doc_id", "page_no", "table_no", F.posexplode(pairs).alias("i", "z")).select(
        "doc_id", "page_no", "table_no", (F.col("i") + 1).alias("col_no"), F.bround("z.lo", 6).alias("edge_lo"),
        F.bround("z.hi", 6).alias("edge_hi"), F.bround("z.w", 6).alias("width"),
    )


CELLS_SQL = TABLES_SQL + """,
ce AS (SELECT doc_id, 1 AS page_no, table_no, row_no, (c + 1)::INTEGER AS col_no, 'no ' || v || ' x' AS text, false AS is_header FROM tw JOIN tb USING (doc_id, line_no))"""


def cells(spark, sf):
    return L.words_to_columns(tabled(spark, sf))


@query("words_to_columns", f"WITH RECURSIVE {CELLS_SQL} SELECT * FROM ce")
def words_to_columns(spark, sf):
    return cells(spark, sf)


@query("sink_per_page", f"""
WITH RECURSIVE {CELLS_SQL}
SELECT doc_id, page_no, table_no, row_no, col_no, text FROM ce
UNION ALL SELECT DISTINCT doc_id, 1, 0, 0, 1, '— page 1 —' FROM ce""")
def sink_per_page(spark, sf):
    """All pages as sheets on disk, one folder per page, and what lies there."""
    target = scratch(spark, "sheets")
    write_parts(L.sheet_rows(settle(cells(spark, sf)), ["doc_id", "page_no"]), target, ["page_no"], 100_000)
    return spark.read.parquet(target)


SPANS = {
    "table_no": "l_orderkey", "row_no": "l_linenumber", "cell_no": "l_partkey * 100000 + l_suppkey",
    "text": "concat('v', CAST(l_partkey AS STRING))", "span": "CAST(1 + l_suppkey % 3 AS INT)",
}


@query("complete_cells", """
WITH s AS (SELECT l_orderkey AS table_no, l_linenumber AS row_no, 'v' || l_partkey AS text, 1 + l_suppkey % 3 AS span,
  sum(1 + l_suppkey % 3) OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) - (l_suppkey % 3) AS col FROM lineitem),
w AS (SELECT table_no, max(n) AS n FROM (SELECT table_no, row_no, sum(span) AS n FROM s GROUP BY ALL) GROUP BY ALL),
r AS (SELECT DISTINCT s.table_no, row_no, unnest(range(1, n::BIGINT + 1))::INTEGER AS col_no FROM s JOIN w ON s.table_no = w.table_no)
SELECT r.table_no, r.row_no, r.col_no, coalesce(s.text, '') AS text FROM r LEFT JOIN s ON s.table_no = r.table_no AND s.row_no = r.row_no AND s.col = r.col_no""")
def complete_cells(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(*(f"{e} AS {c}" for c, e in SPANS.items()))
    return L.complete_cells(rows, ["table_no"])


# ---- pages of text --------------------------------------------------------------------

TEXT_PAGES_SQL = """pg AS (SELECT doc_id, p::INTEGER AS page_no, array_to_string(ls[50 * (p - 1) + 1:50 * p], chr(10)) AS text FROM (
  SELECT doc_id, ls, unnest(range(1, (len(ls) - 1) // 50 + 2)) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"""


def text_pages(spark, sf):
    """Documents cut into pages of fifty lines."""
    listed = table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("ls"))
    last = F.floor((F.size("ls") - 1) / 50).cast("int") + 1
    return listed.select("doc_id", "ls", F.explode(F.sequence(F.lit(1), last)).alias("page_no")).select(
        "doc_id", "page_no", F.array_join(F.slice("ls", (F.col("page_no") - 1) * 50 + 1, F.lit(50)), "\n").alias("text")
    )


@query("text_layer_pages", f"""
WITH {TEXT_PAGES_SQL}, c AS (SELECT doc_id, page_no, length(text)::INTEGER AS chars, length(regexp_replace(text, '\\s', '', 'g'))::INTEGER AS letters FROM pg)
SELECT *, max(letters) OVER (PARTITION BY doc_id) >= 24 AS has_text, chars < 60 AS weak FROM c""")
def text_layer_pages(spark, sf):
    return L.text_layer_pages(text_pages(spark, sf), "text", weak_below=60)


@query("document_totals", f"""
WITH l AS ({LINES_SQL}), p AS (SELECT doc_id, (line_no // 50 + 1)::INTEGER AS page_no, sum(length(text))::BIGINT AS chars, bool_or(line_no % 50 = 7) AS used_ocr FROM l GROUP BY ALL)
SELECT doc_id, page_no, sum(chars)::BIGINT AS chars, bool_or(used_ocr) AS used_ocr FROM p GROUP BY GROUPING SETS ((doc_id, page_no), (doc_id))""")
def document_totals(spark, sf):
    blocks = doc_lines(spark, sf).select(
        "doc_id", (F.floor(F.col("line_no") / 50) + 1).cast("int").alias("page_no"), "text",
        (F.col("line_no") % 50 == 7).alias("was_recognized"),
    )
    return L.document_totals(blocks)


@query("ocr_fallback", f"""
WITH {TEXT_PAGES_SQL}, s AS (SELECT doc_id, page_no, CASE WHEN doc_id % 3 = 0 THEN left(text, 10) ELSE text || text END AS text, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 600 END::DOUBLE AS width FROM pg WHERE doc_id % 2 = 0),
j AS (SELECT pg.doc_id, pg.page_no, pg.text, s.text AS st, s.width AS sw, coalesce(length(pg.text) < 400 AND length(s.text) > length(pg.text), false) AS better FROM pg LEFT JOIN s USING (doc_id, page_no))
SELECT doc_id, page_no, CASE WHEN better THEN length(st) ELSE length(text) END::INTEGER AS chars, CASE WHEN better THEN st ELSE text END AS text,
  CASE WHEN better AND sw > 0 THEN sw ELSE 595.0::DOUBLE END AS width, CASE WHEN better THEN 850.0::DOUBLE ELSE 842.0 END AS height, better AS was_recognized FROM j""")
def ocr_fallback(spark, sf):
    pages = text_pages(spark, sf)
    own = pages.select(
        "doc_id", "page_no", "text", F.length("text").alias("chars"), F.lit(595.0).alias("width"), F.lit(842.0).alias("height"),
        F.lit(False).alias("was_recognized"),
    )
    seen = F.when(F.col("doc_id") % 3 == 0, F.left("text", F.lit(10))).otherwise(F.concat("text", "text"))
    scans = pages.where("doc_id % 2 = 0").select(
        "doc_id", "page_no", seen.alias("text"), F.length(seen).alias("chars"),
        F.when(F.col("doc_id") % 5 == 0, 0.0).otherwise(600.0).alias("width"), F.lit(850.0).alias("height"),
    )
    return L.ocr_fallback(own, scans, 400)


@query("weighted_line_height", f"""
WITH l AS ({LINES_SQL}), v AS (SELECT doc_id, (line_no // 50 + 1)::INTEGER AS page_no, (line_no % 6 + length(text) % 3)::DOUBLE AS h, unnest(range(0, least(greatest(length(text) // 10, 1), 40))) AS k FROM l)
SELECT doc_id, page_no, median(h) AS line_height FROM v WHERE h > 0 GROUP BY ALL""")
def weighted_line_height(spark, sf):
    paragraphs = doc_lines(spark, sf).select(
        "doc_id", (F.floor(F.col("line_no") / 50) + 1).cast("int").alias("page_no"), "text",
        (F.col("line_no") % 6 + F.length("text") % 3).cast("double").alias("line_height"),
    )
    return L.weighted_line_height(paragraphs, ["doc_id", "page_no"])


STYLE_SQL = f"""{RAW_WORDS_SQL.format(docs='SELECT * FROM documents')},
st AS (SELECT doc_id, line_no, word_no, text, word_no % 5 < 2 AS bold, CASE WHEN (word_no // 3) % 2 = 1 THEN 11.5::DOUBLE ELSE 11.0 END AS size FROM w0)"""


def document_words(spark, sf):
    """Words with those of a document in one place, so that grouping them by line shuffles no word."""
    return L.words_from_text(dealt(table(spark, sf, "documents").select("doc_id", "text"), 2_000, "doc_id"), "doc_id", "text")


def styled_words(spark, sf):
    size = L.font_half_points(11 + (F.floor(F.col("word_no") / 3) % 2) * 0.3)
    return document_words(spark, sf).select(
        "doc_id", "line_no", "word_no", "text", (F.col("word_no") % 5 < 2).alias("bold"), size.alias("size")
    )


@query("coalesce_runs", f"""
WITH {STYLE_SQL}, n AS (SELECT *, CASE WHEN (bold, size) IS NOT DISTINCT FROM lag((bold, size)) OVER p THEN 0 ELSE 1 END AS new FROM st WINDOW p AS (PARTITION BY doc_id, line_no ORDER BY word_no)),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, line_no ORDER BY word_no) AS run_no FROM n)
SELECT doc_id, line_no, run_no::BIGINT AS run_no, bold, size, string_agg(text, '' ORDER BY word_no) AS text FROM g GROUP BY ALL""")
def coalesce_runs(spark, sf):
    return L.coalesce_runs(styled_words(spark, sf), ["doc_id", "line_no"], ["word_no"], ["bold", "size"], "text")


# Raw names of fonts by word, and what they say.
RAW_FONTS = (("ABCDEF+Open Sans-BoldMT", "Open Sans", True, False), ("Arial,Italic", "Arial", False, True), ("ArialMT", "Arial", False, False), ("Roboto-HeavyOblique", "Roboto", True, True))
FONT_OF_WORD = "(line_no + word_no // 2) % 4"


@query("styled_runs", f"""
WITH {RAW_WORDS_SQL.format(docs='SELECT * FROM documents')},
st AS (SELECT doc_id, line_no, word_no, text, (['{"', '".join(f[1] for f in RAW_FONTS)}'])[{FONT_OF_WORD} + 1] AS family, CASE WHEN (word_no // 3) % 2 = 1 THEN 11.5::DOUBLE ELSE 11.0 END AS size,
  ([{", ".join(str(f[2]).lower() for f in RAW_FONTS)}])[{FONT_OF_WORD} + 1] OR word_no % 9 = 8 AS bold, ([{", ".join(str(f[3]).lower() for f in RAW_FONTS)}])[{FONT_OF_WORD} + 1] AS italic,
  CASE line_no % 3 WHEN 1 THEN CASE WHEN word_no % 4 < 2 THEN '#FF8000' END END AS color FROM w0),
n AS (SELECT *, CASE WHEN (family, size, bold, italic, color) IS NOT DISTINCT FROM lag((family, size, bold, italic, color)) OVER p THEN 0 ELSE 1 END AS new FROM st WINDOW p AS (PARTITION BY doc_id, line_no ORDER BY word_no)),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, line_no ORDER BY word_no) AS run_no FROM n)
SELECT doc_id, line_no, run_no::BIGINT AS run_no, family, size, bold, italic, color, string_agg(text, '' ORDER BY word_no) AS text FROM g GROUP BY ALL""")
def styled_runs(spark, sf):
    """Runs by the whole look of their letters, from raw names of fonts, weights and colours."""
    names = F.array(*(F.lit(f[0]) for f in RAW_FONTS))
    at = (F.col("line_no") + F.floor(F.col("word_no") / 2)) % 4
    shade = lambda r, g, b: F.struct(F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b"))
    color = F.when(F.col("line_no") % 3 == 1, F.when(F.col("word_no") % 4 < 2, shade(1.0, 0.5, 0.0)).otherwise(shade(0.05, 0.05, 0.05))).when(F.col("line_no") % 3 == 2, shade(0.95, 0.95, 1.0))
    pieces = document_words(spark, sf).select(
        "doc_id", "line_no", "word_no", "text", F.get(names, at.cast("int")).alias("font"), F.when(F.col("word_no") % 9 == 8, 700).alias("weight"),
        F.lit(None).cast("boolean").alias("slant"), color.alias("color"), (11 + (F.floor(F.col("word_no") / 3) % 2) * 0.3).alias("size"),
    )
    return L.coalesce_runs(L.run_style(pieces), ["doc_id", "line_no"], ["word_no"], L.STYLE, "text")


@query("recognised_blocks", f"""
WITH l AS ({LINES_SQL}),
p AS (SELECT doc_id, (line_no // 50 + 1)::INTEGER AS page_no, line_no AS par_no, CASE WHEN line_no % 4 = 1 THEN replace(text, ' ', chr(10) || ' ') WHEN line_no % 4 = 2 THEN left(text, 60) || chr(10) ELSE chr(9) || left(text, 95) || chr(160) END AS raw,
  ((10 + CASE WHEN line_no % 4 = 2 THEN 8 ELSE 0 END + length(text) % 3))::DOUBLE AS line, CASE WHEN line_no % 11 <> 5 THEN (40 + line_no * 7 % 60)::DOUBLE END AS confidence FROM l),
c AS (SELECT *, trim(regexp_replace(raw, '[\\s\\x{{a0}}]+', ' ', 'g')) AS text, length(rtrim(raw, chr(10))) - length(replace(rtrim(raw, chr(10)), chr(10), '')) + 1 AS lines FROM p),
k AS (SELECT *, line * 1.0 AS h FROM c WHERE text <> ''),
u AS (SELECT doc_id, page_no, median(h) AS usual FROM (SELECT doc_id, page_no, h, unnest(range(0, least(greatest(length(text) // 10, 1), 40))) AS v FROM k) GROUP BY ALL)
SELECT doc_id, page_no, par_no, CASE WHEN coalesce(h > usual * 1.35::DOUBLE AND lines <= 2 AND length(text) <= 90 AND confidence >= 60, false) THEN 'Heading2' ELSE 'Paragraph' END AS kind, text,
  round_even(greatest(7.0::DOUBLE, least(40.0::DOUBLE, h * 0.8::DOUBLE)), 1) AS font_size, lines::INTEGER AS n_lines FROM k JOIN u USING (doc_id, page_no)""")
def recognised_blocks(spark, sf):
    """Lines as recognised paragraphs: some broken into lines, some higher, some read badly."""
    n = F.col("line_no")
    raw = F.when(n % 4 == 1, F.replace("text", F.lit(" "), F.lit("\n "))).when(n % 4 == 2, F.concat(F.left("text", F.lit(60)), F.lit("\n"))).otherwise(
        F.concat(F.lit("\t"), F.left("text", F.lit(95)), F.lit("\u00a0")))
    line = 10 + F.when(n % 4 == 2, 8).otherwise(0) + F.length("text") % 3
    docs = dealt(table(spark, sf, "documents").select("doc_id", "text"), 2_000, "doc_id")
    paragraphs = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text")).select(
        "doc_id", (F.floor(n / 50) + 1).cast("int").alias("page_no"), n.alias("par_no"), raw.alias("text"),
        (line * line_count(raw)).cast("double").alias("height"), F.when(n % 11 != 5, 40 + n * 7 % 60).cast("double").alias("confidence"),
    )
    return L.recognised_blocks(paragraphs, ["doc_id", "page_no"], "par_no")


@query("drop_deleted_runs", f"WITH {STYLE_SQL} SELECT doc_id, line_no, word_no, text FROM st WHERE NOT (bold AND size = 11.5)")
def drop_deleted_runs(spark, sf):
    runs = styled_words(spark, sf).withColumn("is_deleted", F.when(F.col("bold") & (F.col("size") == 11.5), True))
    return L.drop_deleted_runs(runs).select("doc_id", "line_no", "word_no", "text")


# ---- slides ---------------------------------------------------------------------------

CHUNKS_SQL = f"""ll AS ({LINES_SQL}), co AS (SELECT *, greatest(1, ceil(length(text) / 95))::INTEGER AS cost FROM ll),
ch AS (SELECT doc_id, line_no, cost AS used, 1 AS chunk_no FROM co WHERE line_no = {{first}}
  UNION ALL SELECT c.doc_id, c.line_no, CASE WHEN ch.used + c.cost > 12 THEN c.cost ELSE ch.used + c.cost END, ch.chunk_no + CASE WHEN ch.used + c.cost > 12 THEN 1 ELSE 0 END
  FROM ch JOIN co c ON c.doc_id = ch.doc_id AND c.line_no = ch.line_no + 1)"""


@query("slide_chunks", f"WITH RECURSIVE {CHUNKS_SQL.format(first=0)} SELECT doc_id, line_no, chunk_no FROM ch")
def slide_chunks(spark, sf):
    return SL.slide_chunks(doc_lines(spark, sf), ["doc_id"], "line_no", "text").select("doc_id", "line_no", "chunk_no")


CLEAN_LINES = LINES_SQL.replace("unnest(string_split(text, chr(10))) AS text", "trim(regexp_replace(unnest(string_split(text, chr(10))), '\\s+', ' ', 'g')) AS text")


@query("slide_titles", f"""
WITH RECURSIVE {CHUNKS_SQL.format(first=1).replace(LINES_SQL, CLEAN_LINES)},
n AS (SELECT doc_id, chunk_no, count(*) AS n_lines FROM ch GROUP BY ALL),
t AS (SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE rtrim(left(text, 120)) || '…' END AS title FROM ll WHERE line_no = 0)
SELECT t.doc_id, coalesce(chunk_no, 1) AS chunk_no, title || CASE WHEN chunk_no > 1 THEN ' (continued)' ELSE '' END AS title, coalesce(n_lines, 0) AS n_lines
FROM t LEFT JOIN n ON n.doc_id = t.doc_id""")
def slide_titles(spark, sf):
    return SL.slides(doc_lines(spark, sf), ["doc_id"], "line_no", "text")
