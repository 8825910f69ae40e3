"""Script detection and transliteration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.functions import script as S
from docflow.operators import script as ops
from docflow.plans.registry import query, table
from docflow.sources.placing import spread

APOS = S.APOSTROPHES.replace("'", "''")
WORDISH = rf"[\p{{L}}\p{{Nd}}{APOS}]"
VOWELS = S.CYRILLIC_VOWELS


def _start(t: str, i: str) -> str:
    return f"({i} = 1 OR NOT regexp_matches({t}[{i}-1], '{WORDISH}'))"


def _lat_char(t: str, i: str) -> str:
    """SQL for what the i-th letter of a Latin token becomes ('' when a pair took it)."""
    c, n, nn = f"lower({t}[{i}])", f"lower({t}[{i}+1])", f"{t}[{i}+2]"
    p = f"(CASE WHEN {i} > 1 THEN lower({t}[{i}-1]) ELSE '' END)"
    apos = lambda x: f"(({x}) <> '' AND contains('{APOS}', {x}))"
    tse = lambda j: (
        f"(lower({t}[{j}+1]) = 's' AND ({_start(t, j)} OR lower({t}[{j}:{j}+4]) IN ('tsiya', 'tsion')))"
    )
    before_tse = f"({i} > 2 AND lower({t}[greatest({i}-2, 1)]) = 't' AND {p} = 's' AND {tse(f'greatest({i}-2, 1)')})"
    taken = (
        f"({apos(f'{t}[{i}]')} AND {p} IN ('o', 'g'))"
        f" OR ({p} = 'y' AND ({c} IN ('a', 'u', 'e') OR ({c} = 'o' AND NOT {apos(f'{t}[{i}+1]')})))"
        f" OR ({c} = 'h' AND ({p} = 'c' OR ({p} = 's' AND NOT {before_tse})))"
        f" OR ({c} = 's' AND {p} = 't' AND {tse(f'greatest({i}-1, 1)')})"
    )
    low = (
        f"CASE WHEN {c} = 'y' THEN CASE WHEN {n} = 'a' THEN 'я' WHEN {n} = 'u' THEN 'ю' WHEN {n} = 'e' THEN 'е'"
        f" WHEN {n} = 'o' AND NOT {apos(nn)} THEN 'ё' ELSE 'й' END"
        f" WHEN {c} = 'o' AND {apos(f'{t}[{i}+1]')} THEN 'ў' WHEN {c} = 'g' AND {apos(f'{t}[{i}+1]')} THEN 'ғ'"
        f" WHEN {c} = 's' AND {n} = 'h' THEN 'ш' WHEN {c} = 'c' AND {n} = 'h' THEN 'ч'"
        f" WHEN {c} = 't' AND {tse(i)} THEN 'ц'"
        f" WHEN {c} = 'e' THEN CASE WHEN {_start(t, i)} THEN 'э' ELSE 'е' END"
        f" WHEN regexp_matches({c}, '^[a-z]$') THEN translate({c}, '{S.LATIN_LETTERS}', '{S.LATIN_AS_CYRILLIC}')"
        f" WHEN {apos(f'{t}[{i}]')} AND {i} > 1 AND regexp_matches({t}[{i}-1], '\\p{{L}}') THEN 'ъ' END"
    )
    upper = f"regexp_matches({t}[{i}], '\\p{{Lu}}')"
    return (
        f"CASE WHEN {taken} THEN '' ELSE coalesce(CASE WHEN {upper} THEN upper({low}) ELSE ({low}) END, {t}[{i}]) END"
    )


def _cyr_char(t: str, i: str) -> str:
    """SQL for what the i-th letter of a Cyrillic token becomes."""
    c = f"lower({t}[{i}])"
    p = f"(CASE WHEN {i} > 1 THEN lower({t}[{i}-1]) ELSE '' END)"
    n = f"lower({t}[{i}+1])"
    vowel = f"({p} <> '' AND contains('{VOWELS}', {p}))"
    pairs = "".join(f" WHEN {c} = '{k}' THEN '{v}'" for k, v in S.CYRILLIC_DOUBLE.items())
    low = (
        f"CASE WHEN {c} = 'е' THEN CASE WHEN {_start(t, i)} OR {vowel} OR {p} IN ('ъ', 'ь') THEN 'ye' ELSE 'e' END"
        f" WHEN {c} = 'ц' THEN CASE WHEN {vowel} THEN 'ts' ELSE 's' END"
        f" WHEN {c} = 'ъ' THEN CASE WHEN {n} IN ('е', 'ё', 'ю', 'я') OR NOT regexp_matches({p}, '\\p{{L}}') THEN '' ELSE '''' END"
        f" WHEN {c} = 'ь' THEN '' WHEN {c} = 'ў' THEN 'o''' WHEN {c} = 'ғ' THEN 'g'''{pairs}"
        f" WHEN contains('{S.CYRILLIC_SINGLE}', {c}) THEN translate({c}, '{S.CYRILLIC_SINGLE}', '{S.LATIN_SINGLE}') END"
    )
    up = lambda x: f"regexp_matches({x}, '\\p{{Lu}}')"
    letter = lambda x: f"regexp_matches({x}, '\\p{{L}}')"
    run = (
        f"CASE WHEN {letter(f'{t}[{i}+1]')} THEN {up(f'{t}[{i}+1]')}"
        f" WHEN {i} > 1 AND {letter(f'{t}[{i}-1]')} THEN {up(f'{t}[{i}-1]')} ELSE false END"
    )
    return (
        f"coalesce(CASE WHEN NOT {up(f'{t}[{i}]')} THEN ({low}) WHEN {run} THEN upper({low})"
        f" ELSE upper(left({low}, 1)) || substr({low}, 2) END, {t}[{i}])"
    )


def _token_sql(tok: str, char) -> str:
    """SQL that converts one token letter by letter and leaves links alone."""
    www = rf"^((?:.*?[^\p{{L}}\p{{Nd}}{APOS}])?)([wW]{{3}}\..*)$"
    letters = lambda t: f"array_to_string(list_transform(range(1, length({t}) + 1), lambda i: {char(t, 'i')}), '')"
    return (
        f"CASE WHEN regexp_matches({tok}, '^\\s') THEN {tok}"
        f" WHEN contains({tok}, '://') OR (contains({tok}, '@') AND contains({tok}, '.')) THEN {tok}"
        f" WHEN regexp_matches({tok}, '{www}') THEN"
        f" array_to_string(list_transform([regexp_extract({tok}, '{www}', 1)], lambda h: {letters('h')}), '')"
        f" || regexp_extract({tok}, '{www}', 2)"
        f" ELSE {letters(tok)} END"
    )


def lat_sql(tok: str) -> str:
    return _token_sql(tok, _lat_char)


def cyr_sql(tok: str) -> str:
    return _token_sql(tok, _cyr_char)


def _tokens_sql(source: str, ids: str) -> str:
    """CTEs with the tokens of a source's texts, and every different token once."""
    return f"""
tk AS (SELECT {ids}, unnest(ts) AS tok, unnest(range(1, len(ts) + 1)) AS pos
  FROM (SELECT {ids}, regexp_extract_all(text, '[^\\s]+|[\\s]+') AS ts FROM {source})),
ds AS MATERIALIZED (SELECT DISTINCT tok FROM tk)"""


def _joined_sql(source: str, ids: str, out: str = "text") -> str:
    """Texts put together again from their converted tokens."""
    return (
        f"(SELECT {ids}, coalesce(any_value(j.{out}), '') AS {out} FROM {source} LEFT JOIN"
        f" (SELECT {ids}, string_agg(w, '' ORDER BY pos) AS {out} FROM tk JOIN cv USING (tok) GROUP BY {ids}) j USING ({ids}) GROUP BY {ids})"
    )


COUNTS_SQL = (
    "length(regexp_replace(text, '[^\\x{0400}-\\x{04FF}]', '', 'g')) AS n_cyr,"
    " length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_lat"
)
DIRECTION_SQL = "CASE WHEN n_cyr > n_lat THEN 'cyr_to_lat' WHEN n_lat > 0 THEN 'lat_to_cyr' END"


@query("script_census", f"""
WITH c AS (SELECT lang, source, sum(n_cyr)::BIGINT AS n_cyr, sum(n_lat)::BIGINT AS n_lat
           FROM (SELECT lang, source, {COUNTS_SQL} FROM documents) GROUP BY ALL)
SELECT lang, source, n_cyr, n_lat, {DIRECTION_SQL} AS direction FROM c""")
def script_census(spark, sf):
    return ops.script_census(spread(table(spark, sf, "documents")), "text", ["lang", "source"])


@query("transliterate_corpus", f"""
WITH c AS (SELECT doc_id, text, {COUNTS_SQL} FROM documents),
e AS (SELECT doc_id, text, coalesce({DIRECTION_SQL}, 'cyr_to_lat') AS direction FROM c), {_tokens_sql("e", "doc_id, direction")},
cv AS (SELECT tok, {lat_sql("tok")} AS w, {cyr_sql("tok")} AS k FROM ds),
o AS (SELECT doc_id, string_agg(CASE WHEN direction = 'cyr_to_lat' THEN k ELSE w END, '' ORDER BY pos) AS text FROM tk JOIN cv USING (tok) GROUP BY doc_id)
SELECT e.doc_id, direction, coalesce(o.text, '') AS text, length(e.text)::INTEGER AS n_chars FROM e LEFT JOIN o ON o.doc_id = e.doc_id""")
def transliterate_corpus(spark, sf):
    docs = spread(table(spark, sf, "documents")).select("doc_id", "text")
    return ops.transliterate_corpus(docs, "text")


@query("lat_to_cyr", f"""
WITH {_tokens_sql("conversations", "conv_id, turn")}, cv AS (SELECT tok, {lat_sql("tok")} AS w FROM ds)
SELECT * FROM {_joined_sql("conversations", "conv_id, turn")}""")
def lat_to_cyr(spark, sf):
    turns = spread(table(spark, sf, "conversations"))
    return turns.select("conv_id", "turn", S.latin_to_cyrillic(F.col("text")).alias("text"))


@query("cyr_to_lat", f"""
WITH {_tokens_sql("documents", "doc_id")}, lc AS MATERIALIZED (SELECT tok, {lat_sql("tok")} AS c FROM ds), cv AS (SELECT tok, {cyr_sql("c")} AS w FROM lc)
SELECT * FROM {_joined_sql("documents", "doc_id")}""")
def cyr_to_lat(spark, sf):
    docs = ops.cyrillic_documents(spread(table(spark, sf, "documents")))
    return docs.select("doc_id", S.cyrillic_to_latin(F.col("text")).alias("text"))


@query("roundtrip_quality", f"""
WITH {_tokens_sql("documents", "doc_id")}, lc AS MATERIALIZED (SELECT tok, {lat_sql("tok")} AS c FROM ds), cv AS (SELECT tok, {cyr_sql("c")} AS w FROM lc),
b AS (SELECT d.lang, coalesce(same, true) AS same FROM documents d LEFT JOIN
  (SELECT doc_id, bool_and(w = tok) AS same FROM tk JOIN cv USING (tok) GROUP BY doc_id) s ON s.doc_id = d.doc_id)
SELECT lang, count(*) AS n_docs, count(*) FILTER (WHERE same) AS n_equal, round_even(avg(CASE WHEN same THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS share
FROM b GROUP BY lang""")
def roundtrip_quality(spark, sf):
    return ops.roundtrip_quality(spread(table(spark, sf, "documents")), ["lang"])


# ---- runs and samples -----------------------------------------------------------------

TURNS_SQL = f"""{_tokens_sql("conversations", "conv_id, turn")}, cv AS (SELECT tok, {lat_sql("tok")} AS w FROM ds),
lt AS {_joined_sql("conversations", "conv_id, turn")},
p AS (SELECT c.conv_id, c.turn, CASE WHEN c.turn % 2 = 1 THEN lt.text ELSE c.text END AS text,
  CASE WHEN c.turn % 2 = 1 THEN 'cyr_to_lat' ELSE 'lat_to_cyr' END AS direction FROM conversations c JOIN lt ON lt.conv_id = c.conv_id AND lt.turn = c.turn)"""


def _aligned_sql(text: str, char) -> str:
    """SQL for the list of what each letter of a text becomes."""
    cells = f"list_transform(range(1, length(tok) + 1), lambda i: {char('tok', 'i')})"
    return (
        f"flatten(list_transform(regexp_extract_all({text}, '[^\\s]+|[\\s]+'), lambda tok:"
        f" CASE WHEN regexp_matches(tok, '^\\s') OR contains(tok, '://') OR (contains(tok, '@') AND contains(tok, '.'))"
        f" OR starts_with(lower(tok), 'www.') THEN string_split(tok, '') ELSE {cells} END))"
    )


@query("run_transliteration", f"""
WITH {TURNS_SQL},
a AS (SELECT conv_id, turn, text, CASE WHEN direction = 'cyr_to_lat' THEN {_aligned_sql("text", _cyr_char)} ELSE {_aligned_sql("text", _lat_char)} END AS cells FROM p)
SELECT conv_id, turn, k::INTEGER AS run_no, array_to_string(cells[7 * k + 1:7 * k + 7], '') AS text
FROM (SELECT conv_id, turn, cells, unnest(range(0, (length(text) + 6) // 7)) AS k FROM a)""")
def run_transliteration(spark, sf):
    odd = F.col("turn") % 2 == 1
    turns = spread(table(spark, sf, "conversations")).select(
        "conv_id", "turn",
        F.when(odd, S.latin_to_cyrillic(F.col("text"))).otherwise(F.col("text")).alias("text"),
        F.when(odd, S.CYR_TO_LAT).otherwise(S.LAT_TO_CYR).alias("direction"),
    )
    pieces = F.regexp_extract_all("text", F.lit("(?s).{1,7}"), F.lit(0))
    runs = turns.select("conv_id", "turn", "direction", F.posexplode(pieces).alias("run_no", "text"))
    return ops.convert_runs(runs, ["conv_id", "turn"], "run_no", "direction")


WORD_SPANS_SQL = """w AS (SELECT doc_id, i, w, sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(w) - 1 AS start
  FROM (SELECT doc_id, unnest(range(0, len(ws))) AS i, unnest(ws) AS w FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents)))"""


@query("segments_to_runs", """
WITH s AS (SELECT doc_id, k * 11 AS start, text[k * 11 + 1:k * 11 + 11] AS text FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 10) // 11)) AS k FROM documents))
SELECT doc_id, start::INTEGER AS start, (start // 97)::INTEGER AS run_id, text FROM s""")
def segments_to_runs(spark, sf):
    docs = spread(table(spark, sf, "documents")).select("doc_id", "text")
    pieces = F.regexp_extract_all("text", F.lit("(?s).{1,11}"), F.lit(0))
    segments = docs.select("doc_id", F.posexplode(pieces).alias("i", "text")).select("doc_id", (F.col("i") * 11).alias("start"), "text")
    marks = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 97).cast("int"))
    runs = docs.where("text <> ''").select("doc_id", F.explode(marks).alias("run_id")).select(
        "doc_id", (F.col("run_id") * 97).alias("start"), "run_id"
    )
    return ops.segments_to_runs(segments, runs, ["doc_id"])


@query("sample_prefix", """
WITH l AS (SELECT doc_id, unnest(range(0, len(ls))) AS line_no, unnest(ls) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
t AS (SELECT doc_id, line_no, i, unnest(range(1, 3)) AS run_no, unnest([text[1:length(text) // 2], text[length(text) // 2 + 1:]]) AS text FROM (SELECT *, line_no AS i FROM l)),
c AS (SELECT *, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY line_no, run_no) + line_no AS upto FROM t),
k AS (SELECT *, upto - length(text) AS before, CASE WHEN run_no = 2 AND upto < 4000 THEN text || ' ' ELSE text END AS piece FROM c)
SELECT doc_id, string_agg(piece, '' ORDER BY line_no, run_no) AS sample FROM k WHERE before < 4000 GROUP BY doc_id""")
def sample_prefix(spark, sf):
    lines = spread(table(spark, sf, "documents")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    half = F.floor(F.length("line") / 2).cast("int")
    both = F.array(F.substring("line", F.lit(1), half), F.substring("line", half + 1, F.length("line")))
    runs = lines.select("doc_id", "line_no", F.posexplode(both).alias("run_no", "text"))
    return ops.sample_prefix(runs, "doc_id", ["line_no", "run_no"], "line_no")
