"""Queries over numbers, cells and plain text."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.functions import numbers as N
from docflow.functions.text import BULLETS, DASHES, FONT_STYLES, FONT_TAILS
from docflow.operators import numbers as ops
from docflow.operators import texts
from docflow.plans.registry import query, table
from docflow.sources import tables as t
from docflow.sources.placing import spread

WS = r"\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

MONEY = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)"
NUMBERS = {
    "id": "o_orderkey",
    "text": f"""CASE o_orderkey % 6 WHEN 0 THEN {MONEY} WHEN 1 THEN concat('-', {MONEY}) WHEN 2 THEN concat(' + ', replace({MONEY}, '.', ','))
      WHEN 3 THEN concat(CAST(o_custkey AS STRING), ' 000_', CAST(o_orderkey AS STRING)) WHEN 4 THEN '-0.00' ELSE CAST(o_orderkey AS STRING) END""",
}
VALUE_SQL = f"""n AS ({t.derived_sql(NUMBERS, 'orders')}),
p AS (SELECT id, text, regexp_replace(replace(text, ',', '.'), '[ _+-]', '', 'g') AS body, starts_with(text, '-') AS neg FROM n),
q AS (SELECT id, neg, string_split(body, '.')[1]::BIGINT AS i, coalesce(string_split(body, '.')[2], '0')::BIGINT AS f,
   (10 ** length(coalesce(string_split(body, '.')[2], '')))::BIGINT AS den FROM p)"""


def _numbers(spark, sf):
    return spread(t.derived(spark, sf, NUMBERS, "orders"))


@query("base_fanout", f"""
WITH {VALUE_SQL}, b AS (SELECT unnest([2, 4, 8, 10, 16, 32, 64, 128, 256]) AS base),
d AS (SELECT id, base, neg AND (i > 0 OR f > 0) AS neg, i, f, den,
  list_reverse(list_transform(range(0, CASE WHEN i = 0 THEN 1 ELSE floor(log2(i) / log2(base) + 1e-12)::BIGINT + 1 END), lambda k: (i::HUGEINT // (base::HUGEINT ** k)::HUGEINT) % base)) AS ds,
  list_transform(range(1, 13), lambda k: (f::HUGEINT * (base::HUGEINT ** k)::HUGEINT // den) % base) AS fs,
  (f::HUGEINT * (base::HUGEINT ** 12)::HUGEINT) % den = 0 AS is_exact FROM q, b),
s AS (SELECT *, CASE WHEN is_exact THEN fs[1:len(fs) - coalesce(list_position(list_transform(list_reverse(fs), lambda x: x <> 0), true), len(fs) + 1) + 1] ELSE fs END AS fk FROM d),
r AS (SELECT id, base, is_exact, CASE WHEN neg THEN '-' ELSE '' END AS sign,
  CASE WHEN base <= 32 THEN array_to_string(list_transform(ds, lambda x: '{N.DIGITS}'[x::BIGINT + 1]), '') ELSE array_to_string(list_transform(ds, lambda x: x::VARCHAR), ':') END AS whole,
  CASE WHEN f = 0 THEN '' ELSE CASE WHEN base <= 32 THEN array_to_string(list_transform(fk, lambda x: '{N.DIGITS}'[x::BIGINT + 1]), '') ELSE array_to_string(list_transform(fk, lambda x: x::VARCHAR), ':') END END AS part FROM s),
g AS (SELECT *, CASE WHEN base IN (2, 4, 16) THEN 4 WHEN base IN (8, 10) THEN 3 END AS n FROM r)
SELECT id, base, sign || whole || CASE WHEN part = '' THEN '' ELSE '.' || part END AS value, is_exact,
  sign || CASE WHEN n IS NULL THEN whole ELSE reverse(trim(regexp_replace(reverse(whole), CASE WHEN n = 4 THEN '(.{{4}})' ELSE '(.{{3}})' END, '\\1 ', 'g'))) END
  || CASE WHEN part = '' THEN '' WHEN n IS NULL THEN '.' || part ELSE '.' || trim(regexp_replace(part, CASE WHEN n = 4 THEN '(.{{4}})' ELSE '(.{{3}})' END, '\\1 ', 'g')) END AS display
FROM g""")
def base_fanout(spark, sf):
    return ops.base_fanout(_numbers(spark, sf), ["id"], "text", 10, 12)


ODD_NUMBERS = {
    "id": "l_orderkey",
    "base": "CAST(CASE l_linenumber WHEN 1 THEN 2 WHEN 2 THEN 8 WHEN 3 THEN 10 WHEN 4 THEN 16 WHEN 5 THEN 32 WHEN 6 THEN 64 ELSE 256 END AS INT)",
    "text": """CASE l_suppkey % 10 WHEN 0 THEN ' ' WHEN 1 THEN '1.0.1' WHEN 2 THEN '-.' WHEN 3 THEN repeat('1', 513) WHEN 4 THEN CAST(l_partkey AS STRING)
      WHEN 5 THEN concat('1_0:', CAST(l_partkey % 300 AS STRING)) WHEN 6 THEN 'fG' WHEN 7 THEN NULL WHEN 8 THEN concat('+', CAST(l_partkey AS STRING), ',5') ELSE '12.3z.4' END""",
}


@query("number_quality", f"""
WITH n AS ({t.derived_sql(ODD_NUMBERS, 'lineitem')}),
p AS (SELECT base, trim(text) AS x, regexp_replace(trim(text), '^[+-]', '') AS b,
  CASE base WHEN 2 THEN '0-1' WHEN 8 THEN '0-7' WHEN 10 THEN '0-9' WHEN 16 THEN '0-9A-Fa-f' WHEN 32 THEN '0-9A-Va-v' ELSE '0-9:' END || '_ ' AS ok FROM n),
r AS (SELECT base, CASE WHEN x IS NULL OR x = '' THEN 'blank' WHEN length(x) > 512 THEN 'too_long'
  WHEN regexp_matches(b, '^[' || ok || ']*[.,][' || ok || ']*[.,]') THEN 'two_separators'
  WHEN regexp_matches(b, '[^' || ok || '.,]') THEN 'bad_digit'
  WHEN base > 32 AND len(list_filter(regexp_split_to_array(b, '[:_ .,]+'), lambda g: g <> '' AND TRY_CAST(g AS HUGEINT) >= base)) > 0 THEN 'bad_digit'
  WHEN NOT regexp_matches(b, '[0-9A-Za-z]') THEN 'no_digits' ELSE 'ok' END AS reason FROM p)
SELECT base, reason, count(*) AS n FROM r GROUP BY ALL""")
def number_quality(spark, sf):
    return ops.number_quality(spread(t.derived(spark, sf, ODD_NUMBERS, "lineitem")), "text", "base")


@query("positional_value", f"WITH {VALUE_SQL} SELECT id, i AS integer, f // CASE WHEN f % 100 = 0 THEN 100 WHEN f % 10 = 0 THEN 10 ELSE 1 END AS numerator,"
       " den // CASE WHEN f = 0 THEN den WHEN f % 10 = 0 THEN 10 ELSE 1 END AS denominator FROM q")
def positional_value(spark, sf):
    parsed = _numbers(spark, sf).select("id", N.parse_number(F.col("text"), 10).alias("p"))
    # Zeros at the end of a fraction carry no value.
    zeros = F.array_position(F.transform(F.reverse("p.part"), lambda d: d != 0), True)
    part = F.slice("p.part", F.lit(1), F.when(zeros == 0, 0).otherwise(F.size("p.part") - zeros + 1).cast("int"))
    digits = parsed.select("id", F.posexplode(F.concat("p.whole", part)).alias("i", "digit"), F.size("p.whole").alias("n")).select(
        "id", (F.col("n") - 1 - F.col("i")).alias("position"), "digit", F.lit(10).alias("base")
    )
    valued = ops.positional_value(digits, ["id"])
    return valued.select("id", *(F.col(c).cast("bigint").alias(c) for c in ("integer", "numerator", "denominator")))


# Long numbers: 500 and more digits in base 10, with a fraction; or 25 to 27 digits in base 16.
LONG = "rpad(concat(CAST(c_custkey AS STRING), repeat(CAST(7 * c_custkey AS STRING), 200)), 520, '3')"
LONG_SQL = LONG.replace("STRING", "VARCHAR")
SIXTEEN = "substring(md5(CAST(c_custkey AS STRING)), 1, CAST(25 + c_custkey % 3 AS INT))"


@query("positional_value_long", f"""
WITH c AS (SELECT c_custkey AS id, {LONG_SQL} AS x, 1 + c_custkey % 40 AS f, md5(CAST(c_custkey AS VARCHAR))[:25 + c_custkey % 3] AS h FROM customer),
n AS (SELECT *, ltrim(x[:len(x) - f], '0') AS i, ltrim(x[len(x) - f + 1:], '0') AS p FROM c)
SELECT id, CASE WHEN id % 2 = 1 THEN list_reduce(list_transform(string_split(h, ''), lambda d: (strpos('0123456789abcdef', d) - 1)::HUGEINT), lambda a, d: a * 16 + d)::VARCHAR WHEN i = '' THEN '0' ELSE i END AS integer,
  CASE WHEN id % 2 = 1 OR p = '' THEN '0' ELSE p END AS numerator, CASE WHEN id % 2 = 1 THEN '1' ELSE '1' || repeat('0', f::INTEGER) END AS denominator FROM n""")
def positional_value_long(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey AS id", f"IF(c_custkey % 2 = 1, {SIXTEEN}, {LONG}) AS x", "IF(c_custkey % 2 = 1, 16, 10) AS base", "CAST(IF(c_custkey % 2 = 1, 0, 1 + c_custkey % 40) AS INT) AS f")
    each = spread(c).select("id", "base", "f", F.length("x").alias("n"), F.posexplode(F.split("x", "")).alias("i", "d"))
    digits = each.select("id", "base", (F.col("n") - F.col("f") - 1 - F.col("i")).alias("position"), (F.instr(F.lit("0123456789abcdef"), F.col("d")) - 1).alias("digit"))
    return ops.positional_text(digits, ["id"])


AMOUNT = "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING)"
CELLS = {
    "col": "concat('c', CAST(l_linenumber AS STRING))",
    "text": f"""CASE (l_suppkey + l_linenumber) % 9 WHEN 0 THEN {AMOUNT} WHEN 1 THEN replace({AMOUNT}, '.', ',') WHEN 2 THEN concat(' 1 ', {AMOUNT}, ' ')
      WHEN 3 THEN concat('0', {AMOUNT}) WHEN 4 THEN concat({AMOUNT}, ' kg') WHEN 5 THEN concat('-1,', replace({AMOUNT}, '.', '.')) WHEN 6 THEN '1,250' WHEN 7 THEN concat('1.', replace({AMOUNT}, '.', ',')) ELSE '12-3' END""",
}


@query("cell_types", f"""
WITH c AS ({t.derived_sql(CELLS, 'lineitem')}),
p AS (SELECT col, regexp_replace(text, '\\s', '', 'g') AS x, trim(text) AS y FROM c),
v AS (SELECT col, CASE WHEN length(y) > 24 OR NOT regexp_matches(y, '^[0-9.,+\\- ]+$') OR regexp_matches(y, '^[+-]*0[^.,]') THEN NULL
  WHEN regexp_matches(x, '\\..*,') THEN replace(replace(x, '.', ''), ',', '.') WHEN regexp_matches(x, ',.*\\.') THEN replace(x, ',', '')
  WHEN regexp_matches(x, ',.*,') OR regexp_matches(x, ',.{{3}}$') THEN replace(x, ',', '') ELSE replace(x, ',', '.') END AS z FROM p),
n AS (SELECT col, TRY_CAST(z AS DECIMAL(18,2)) AS n FROM v)
SELECT col, count(*) AS cells, count(n) AS numeric, round_even(count(n) / count(*), 6) AS share, sum((n * 100)::BIGINT)::BIGINT AS cents FROM n GROUP BY col""")
def cell_types(spark, sf):
    return ops.cell_types(t.derived(spark, sf, CELLS, "lineitem"), "col", "text")


@query("column_widths", """
WITH c AS (SELECT p_brand AS table_no, unnest([1, 2, 3]) AS col_no, unnest([p_name, p_type, p_size::VARCHAR]) AS text FROM part)
SELECT table_no, col_no, round_even(least(greatest(max(length(text)) * 1.15::DOUBLE + 2, 9), 70), 2)::DOUBLE AS width FROM c GROUP BY ALL""")
def column_widths(spark, sf):
    cells = table(spark, sf, "part").select(
        F.col("p_brand").alias("table_no"), F.posexplode(F.array("p_name", "p_type", F.col("p_size").cast("string"))).alias("i", "text")
    ).withColumn("col_no", F.col("i") + 1)
    return ops.column_widths(cells, ["table_no", "col_no"], "text")


@query("proportional_shares", """
WITH w AS (SELECT l_orderkey AS table_no, l_partkey AS item, l_suppkey, CASE WHEN l_quantity > 20 THEN l_quantity - 20 ELSE 0 END AS w FROM lineitem)
SELECT table_no, item, l_suppkey, greatest(400, round_even(CASE WHEN sum(w) OVER g > 0 THEN 9000 * w / sum(w) OVER g ELSE 9000.0::DOUBLE / count(*) OVER g END, 0)::INTEGER) AS share
FROM w WINDOW g AS (PARTITION BY table_no)""")
def proportional_shares(spark, sf):
    items = table(spark, sf, "lineitem").selectExpr("l_orderkey AS table_no", "l_partkey AS item", "l_suppkey", "l_quantity - 20 AS w")
    return ops.proportional_shares(items, ["table_no"], "w", 9000).drop("w")


COLLAPSED = f"trim(regexp_replace(regexp_replace(text, '[{WS}]+', ' ', 'g'), '[\\x00-\\x1f\\x7f-\\x{{9f}}]', '', 'g'))"


@query("clean_corpus", f"""
WITH c AS (SELECT lang, text, {COLLAPSED} AS clean,
  regexp_replace(regexp_replace(translate(text, chr(9) || chr(10) || chr(13), '   '), '[\\x00-\\x1f\\x7f-\\x{{9f}}]', '', 'g'), '^[{WS}]+|[{WS}]+$', '', 'g') AS cell FROM documents)
SELECT lang, count(*) AS n_docs, count(*) FILTER (WHERE clean <> text) AS n_changed, count(*) FILTER (WHERE length(clean) > 4000) AS n_cut_slide,
  count(*) FILTER (WHERE length(text) > 32000) AS n_cut_cell, sum(least(length(clean), 4000))::BIGINT AS slide_chars,
  sum(least(length(cell), 32000))::BIGINT AS cell_chars,
  sum(CASE WHEN length(clean) <= 120 THEN length(clean) ELSE length(rtrim(left(clean, 120))) + 1 END)::BIGINT AS title_chars,
  round_even(avg(CASE WHEN clean <> text THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS share_changed
FROM c GROUP BY lang""")
def clean_corpus(spark, sf):
    return texts.clean_corpus(spread(table(spark, sf, "documents")), "text", ["lang"])


def doc_lines(spark, sf):
    """Lines of every document, numbered from 0."""
    return spread(table(spark, sf, "documents")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


LINES_SQL = (
    "SELECT doc_id, unnest(range(0, len(string_split(text, chr(10)))))::INTEGER AS line_no, unnest(string_split(text, chr(10))) AS text FROM documents"
)
MARKERS = ("• ", "- ", "1. ", "(2) ", "a) ", "12.x ", "-x ", "  ◦", "1234. ", "б. ", "")
MARKED = "CASE (doc_id + line_no) % 11 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MARKERS)) + " END"


@query("list_markers", f"""
WITH l AS (SELECT concat({MARKED}, text) AS text FROM ({LINES_SQL})),
k AS (SELECT CASE WHEN regexp_matches(text, '^\\s*[{BULLETS}]') THEN 'bullet' WHEN regexp_matches(text, '^\\s*[{DASHES}]\\s') THEN 'dash'
  WHEN regexp_matches(text, '^\\s*\\(?\\d{{1,3}}\\s*[.)]\\s') THEN 'number' WHEN regexp_matches(text, '^\\s*\\(?[a-zA-Zа-яА-Я]\\s*[.)]\\s') THEN 'letter' END AS kind FROM l)
SELECT kind, count(*) AS n_lines FROM k GROUP BY kind""")
def list_markers(spark, sf):
    lines = doc_lines(spark, sf).withColumn("text", F.expr(f"concat({MARKED}, text)"))
    return texts.list_markers(lines, "text")


FONTS = {
    "raw": """concat(CASE WHEN p_partkey % 2 = 0 THEN 'ABCDEF+' ELSE '' END, CASE p_size % 6 WHEN 0 THEN replace(p_name, ' ', 'Xy')
      WHEN 1 THEN 'TimesNewRomanPS' WHEN 2 THEN 'ArialMT' WHEN 3 THEN 'Open Sans' WHEN 4 THEN concat('Brand', p_type) ELSE 'CourierNewPSMT' END,
      CASE p_partkey % 7 WHEN 0 THEN '-BoldMT' WHEN 1 THEN ',Italic' WHEN 2 THEN 'Bold' WHEN 3 THEN 'SemiBoldItalic' WHEN 4 THEN '_x' ELSE '' END)"""
}
FONT_SQL = "regexp_replace(raw, '^[A-Z]{6}\\+', '')"
FONT_SQL = f"regexp_replace({FONT_SQL}, '^([^,+_-]+)[,+_-].*$', '\\1')"
for _tail in (*FONT_TAILS, *FONT_STYLES):
    FONT_SQL = f"regexp_replace({FONT_SQL}, '^(.+){_tail}$', '\\1')"


@query("font_normalise", f"""
WITH f AS ({t.derived_sql(FONTS, 'part')}), n AS (SELECT trim({FONT_SQL}) AS name FROM f)
SELECT CASE WHEN name = '' THEN 'Calibri' WHEN contains(name, ' ') THEN name ELSE regexp_replace(name, '([^A-Z])([A-Z])', '\\1 \\2', 'g') END AS family,
  count(*) AS n FROM n GROUP BY ALL""")
def font_normalise(spark, sf):
    return texts.font_usage(t.derived(spark, sf, FONTS, "part"), "raw")


@query("head_tail", f"""
WITH l AS ({LINES_SQL}), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM l)
SELECT doc_id, line_no, text FROM n WHERE n <= 14 OR line_no < 8 OR line_no >= n - 3
UNION ALL SELECT DISTINCT doc_id, 8, '… ' || (n - 11) || ' more' FROM n WHERE n > 14""")
def head_tail(spark, sf):
    return texts.head_tail(doc_lines(spark, sf), ["doc_id"], "line_no", "text")


@query("log_rollup", """
SELECT date_trunc('hour', ts) AS hour, event_type || ' by user #' AS kind, count(*) AS n FROM events WHERE event_id % 10 <> 0 GROUP BY ALL""")
def log_rollup(spark, sf):
    logs = table(spark, sf, "events").selectExpr(
        "concat(CASE WHEN event_id % 10 = 0 THEN 'broken' ELSE date_format(ts, 'yyyy-MM-dd HH:mm:ss') END, "
        "'  ', event_type, ' by user ', user_id) AS line"
    )
    return texts.log_rollup(logs, "line")
