"""Queries over style chains, outlines and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.operators import grids
from docflow.operators import hierarchy as H
from docflow.plans.registry import query, table
from docflow.sources import tables as t
from docflow.sources.placing import dealt, settle

STYLES = {
    "doc_id": "c_custkey % 10",
    "style_id": "CAST(c_custkey AS STRING)",
    "based_on": """CASE WHEN c_custkey < 10 THEN NULL WHEN floor(c_custkey / 10) % 50 = 7 THEN CAST(c_custkey + 10 AS STRING)
      WHEN floor(c_custkey / 10) % 50 = 8 THEN CAST(c_custkey - 10 AS STRING) WHEN floor(c_custkey / 10) % 40 = 9 THEN 'gone'
      ELSE CAST(CAST(floor(floor(c_custkey / 10) * 5 / 6) AS BIGINT) * 10 + c_custkey % 10 AS STRING) END""",
    "font": "CASE WHEN c_custkey % 7 = 0 THEN concat('F', CAST(c_custkey % 13 AS STRING)) END",
    "size": "CASE WHEN c_custkey % 11 = 0 THEN CAST(c_custkey % 20 + 8 AS INT) END",
    "bold": "CASE WHEN c_custkey % 23 = 0 THEN c_custkey % 2 = 0 END",
}


@query("style_chain", f"""
WITH RECURSIVE s AS ({t.derived_sql(STYLES, 'customer')}),
c AS (SELECT doc_id, style_id, style_id AS up, 0 AS depth, [style_id] AS path FROM s
  UNION ALL SELECT c.doc_id, c.style_id, n.style_id, c.depth + 1, list_append(c.path, n.style_id)
  FROM c JOIN s p ON p.doc_id = c.doc_id AND p.style_id = c.up JOIN s n ON n.doc_id = p.doc_id AND n.style_id = p.based_on
  WHERE c.depth + 1 < 16 AND NOT list_contains(c.path, n.style_id)),
v AS (SELECT c.doc_id, c.style_id, arg_min(s.font, depth) FILTER (WHERE s.font IS NOT NULL) AS font, arg_min(s.size, depth) FILTER (WHERE s.size IS NOT NULL) AS size,
  arg_min(s.bold, depth) FILTER (WHERE s.bold IS NOT NULL) AS bold FROM c JOIN s ON s.doc_id = c.doc_id AND s.style_id = c.up GROUP BY ALL),
d AS (SELECT * FROM v WHERE style_id::BIGINT BETWEEN 140 AND 149)
SELECT v.doc_id, v.style_id, coalesce(v.font, d.font) AS font, coalesce(v.size, d.size) AS size, coalesce(v.bold, d.bold) AS bold
FROM v LEFT JOIN d ON d.doc_id = v.doc_id""")
def style_chain(spark, sf):
    styles = t.derived(spark, sf, STYLES, "customer")
    default = styles.where("CAST(style_id AS BIGINT) BETWEEN 140 AND 149").select("doc_id", "style_id")
    return H.style_chain(styles, ["doc_id"], ["font", "size", "bold"], default)


OUTLINE_ROWS = 250_000  # paragraphs to a piece
OUTLINE = {
    "list_id": "l_orderkey",
    "seq": t.PLAN_SEQ,
    "level": "CAST(CASE WHEN l_linenumber = 1 THEN 0 ELSE l_suppkey % 4 END AS INT)",
    "start": "CAST(CASE WHEN l_linenumber > 1 AND l_suppkey % 4 = 2 THEN 3 ELSE 1 END AS INT)",
    "form": "CASE WHEN l_linenumber = 1 THEN 'decimal' WHEN l_suppkey % 4 = 1 THEN 'lowerLetter' WHEN l_suppkey % 4 = 2 THEN 'upperRoman' "
    "WHEN l_suppkey % 4 = 3 THEN 'bullet' ELSE 'decimal' END",
    "template": "CASE WHEN l_linenumber = 1 THEN '%1.' WHEN l_suppkey % 4 = 1 THEN '%1.%2)' WHEN l_suppkey % 4 = 2 THEN '%3-%1%%2' WHEN l_suppkey % 4 = 3 THEN 'x' ELSE '' END",
}


@query("outline_numbers", f"""
WITH p AS ({t.derived_sql(OUTLINE, 'lineitem')}),
c AS (SELECT *, sum(CASE WHEN level < 1 THEN 1 ELSE 0 END) OVER w AS c1, sum(CASE WHEN level < 2 THEN 1 ELSE 0 END) OVER w AS c2
      FROM p WHERE form <> 'bullet' WINDOW w AS (PARTITION BY list_id ORDER BY seq)),
n AS (SELECT *, start + row_number() OVER (PARTITION BY list_id, level, CASE level WHEN 0 THEN 0 WHEN 1 THEN c1 ELSE c2 END ORDER BY seq) - 1 AS v FROM c),
o AS (SELECT *, last_value(CASE WHEN level = 0 THEN v END IGNORE NULLS) OVER w AS v0,
   coalesce(arg_max(CASE WHEN level = 1 THEN v ELSE -1 END, seq) FILTER (WHERE level <= 1) OVER w, -1) AS v1 FROM n WINDOW w AS (PARTITION BY list_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT list_id, seq, level, CASE level WHEN 0 THEN v || '.' WHEN 1 THEN coalesce(v0, 1) || '.' || chr((96 + v)::INTEGER) || ')'
  ELSE ['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X', 'XI', 'XII', 'XIII', 'XIV', 'XV'][v] || '-' || coalesce(v0, 1) || '%' || CASE WHEN v1 > 0 THEN v1 ELSE 1 END END AS marker FROM o
UNION ALL SELECT list_id, seq, level, '▪' FROM p WHERE form = 'bullet'""")
def outline_numbers(spark, sf):
    rows = dealt(t.derived(spark, sf, OUTLINE, "lineitem"), OUTLINE_ROWS, "list_id")
    return H.outline_numbers(rows, ["list_id"], "seq", levels=4).select(
        "list_id", "seq", "level", "marker"
    )


SCORES_SQL = (
    "SELECT vec_id, unnest(range(0, len(embedding)))::INTEGER AS idx, unnest(embedding) AS v FROM embeddings"
)
SCALED_SQL = f"""s AS ({SCORES_SQL}), e AS (SELECT vec_id, min(v::DOUBLE) AS lo, max(v::DOUBLE) AS hi FROM s GROUP BY vec_id),
k AS (SELECT s.vec_id, idx, idx % 8 AS x, idx // 8 AS y, round_even((v::DOUBLE - lo) / (hi - lo) * 255, 0)::INTEGER AS scaled FROM s JOIN e ON s.vec_id = e.vec_id)"""


def scaled(spark, sf):
    scores = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("idx", "v"))
    return grids.minmax_scale(scores, ["vec_id"]).select(
        "vec_id", "idx", (F.col("idx") % 8).alias("x"), F.floor(F.col("idx") / 8).cast("int").alias("y"), "scaled"
    )


@query("minmax_scale", f"WITH {SCALED_SQL} SELECT vec_id, idx, scaled FROM k")
def minmax_scale(spark, sf):
    return scaled(spark, sf).select("vec_id", "idx", "scaled")


@query("visible_bounds", f"""
WITH {SCALED_SQL}
SELECT vec_id, coalesce(min(x) FILTER (WHERE scaled - 150 > 8), 0)::INTEGER AS "left", coalesce(min(y) FILTER (WHERE scaled - 150 > 8), 0)::INTEGER AS top,
  coalesce(max(x) FILTER (WHERE scaled - 150 > 8) + 1, 8)::INTEGER AS "right", coalesce(max(y) FILTER (WHERE scaled - 150 > 8) + 1, 8)::INTEGER AS bottom FROM k GROUP BY vec_id""")
def visible_bounds(spark, sf):
    dimmed = scaled(spark, sf).withColumn("shade", F.col("scaled") - 150)
    return grids.visible_bounds(dimmed, ["vec_id"], "shade", 8, 8)


@query("gaussian_smooth", f"""
WITH {SCALED_SQL}, o AS (SELECT unnest([-2, -1, 0, 1, 2]) AS d), w0 AS (SELECT d, exp(-(d * d) / (2 * 1.5::DOUBLE * 1.5)) AS g FROM o),
w AS (SELECT d, g / (SELECT sum(g) FROM w0) AS g FROM w0),
h AS (SELECT a.vec_id, a.x, a.y, sum(b.scaled * g) AS v FROM k a, w JOIN k b ON true WHERE b.vec_id = a.vec_id AND b.y = a.y AND b.x = least(greatest(a.x + d, 0), 7) GROUP BY ALL),
f AS (SELECT a.vec_id, a.x, a.y, sum(b.v * g) AS v FROM h a, w JOIN h b ON true WHERE b.vec_id = a.vec_id AND b.x = a.x AND b.y = least(greatest(a.y + d, 0), 7) GROUP BY ALL)
SELECT vec_id, x, y::INTEGER AS y, round_even(v, 0)::INTEGER AS smoothed FROM f""")
def gaussian_smooth(spark, sf):
    cells = scaled(spark, sf).select("vec_id", "x", "y", F.col("scaled").alias("smoothed"))
    return grids.gaussian_smooth(cells, ["vec_id"], "smoothed", 8, 8, 1.5)
