"""Queries over pages: plans, ranges, numbering, selection, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.operators import pages as ops
from docflow.plans.lists import SIZE_LABEL
from docflow.plans.registry import query, table
from docflow.sources import tables as t
from docflow.sources.files import write_parts
from docflow.sources.placing import scratch

PLAN_SQL = t.derived_sql(t.PAGE_PLAN, "lineitem")
SOURCES_SQL = (
    "SELECT l_orderkey AS source_id, count(*)::INTEGER AS page_count, (90 * (l_orderkey % 4))::INTEGER AS base_rotation "
    "FROM lineitem GROUP BY l_orderkey"
)
PAGES_SQL = t.derived_sql(t.LINE_PAGES, "lineitem")


def plan(spark, sf):
    return t.derived(spark, sf, t.PAGE_PLAN, "lineitem")


def sources(spark, sf):
    return (
        table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("source_id"))
        .agg(F.count(F.lit(1)).cast("int").alias("page_count"))
        .withColumn("base_rotation", (90 * (F.col("source_id") % 4)).cast("int"))
    )


def source_pages(spark, sf):
    """One row per page of every source."""
    return sources(spark, sf).select("source_id", F.explode(F.sequence(F.lit(1), "page_count")).alias("page_no"))


SOURCE_PAGES_SQL = "SELECT source_id, unnest(range(1, page_count + 1))::INTEGER AS page_no FROM sources"


def ranges(spark, sf):
    """Per source the text ``1-k, n``."""
    half = F.col("page_count").cast("int") / 2
    k = F.floor(half) + 1
    expr = F.concat(F.lit("1-"), k.cast("string"), F.lit(", "), F.col("page_count").cast("string"))
    odd = (
        F.when(F.col("source_id") % 11 == 0, " ").when(F.col("source_id") % 13 == 0, "5-2;x")
        .when(F.col("source_id") % 17 == 0, F.concat(expr, F.lit("\n1–2—3, -3,,0-2"))).otherwise(expr)
    )
    return sources(spark, sf).select("source_id", "page_count", odd.alias("expr"))


RANGES_SQL = f"""src AS ({SOURCES_SQL}),
rq AS (SELECT source_id, page_count, CASE WHEN source_id % 11 = 0 THEN ' ' WHEN source_id % 13 = 0 THEN '5-2;x'
  WHEN source_id % 17 = 0 THEN '1-' || (page_count // 2 + 1) || ', ' || page_count || chr(10) || '1–2—3, -3,,0-2'
  ELSE '1-' || (page_count // 2 + 1) || ', ' || page_count END AS expr FROM src)"""
PARTS_SQL = f"""{RANGES_SQL},
parts AS (SELECT source_id, page_count, p AS part, i - 1 AS pos FROM (
   SELECT source_id, page_count, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i FROM (
     SELECT source_id, page_count, list_filter(list_transform(regexp_split_to_array(expr, '[,;\\n\\r]'), lambda x: trim(x)), lambda x: x <> '') AS ps FROM rq))
   UNION ALL SELECT source_id, page_count, NULL, 0 FROM rq WHERE trim(expr) = ''),
cut AS (SELECT *, regexp_split_to_array(part, '[-–—]') AS s FROM parts),
num AS (SELECT *, CASE WHEN regexp_matches(trim(s[1]), '^[0-9]+$') AND trim(s[1])::INTEGER >= 1 THEN trim(s[1])::INTEGER END AS a,
   CASE WHEN regexp_matches(trim(s[len(s)]), '^[0-9]+$') AND trim(s[len(s)])::INTEGER >= 1 THEN trim(s[len(s)])::INTEGER END AS b FROM cut),
parsed AS (SELECT source_id, pos::INTEGER AS pos, part, a, b, CASE WHEN part IS NULL THEN 'empty' WHEN len(s) > 2 THEN 'bad_range' WHEN a IS NULL THEN 'bad_number'
   WHEN b IS NULL THEN 'bad_last_number' WHEN a > b THEN 'reversed' WHEN b > page_count THEN 'past_end' END AS reason FROM num)"""


@query("plan_violations", f"""
WITH p AS ({PLAN_SQL}), s AS ({SOURCES_SQL})
SELECT plan_id, seq, CASE WHEN page_count IS NULL THEN 'no_source' ELSE 'page_out_of_range' END AS reason
FROM p LEFT JOIN s ON p.source_id = s.source_id WHERE page_count IS NULL OR page_index < 0 OR page_index >= page_count""")
def plan_violations(spark, sf):
    return ops.plan_violations(plan(spark, sf), sources(spark, sf))


@query("plan_resolve", f"""
WITH p AS ({PLAN_SQL}), s AS ({SOURCES_SQL}),
j AS (SELECT p.*, page_count, base_rotation, bool_or(page_index < 0 OR page_index >= page_count) OVER (PARTITION BY plan_id) AS bad
      FROM p JOIN s ON p.source_id = s.source_id)
SELECT plan_id, row_number() OVER (PARTITION BY plan_id ORDER BY seq) AS out_page, source_id, page_index,
  ((base_rotation + rotation) % 360)::INTEGER AS rotation FROM j WHERE NOT bad""")
def plan_resolve(spark, sf):
    return ops.plan_resolve(plan(spark, sf), sources(spark, sf))


@query("page_ranges", f"""
WITH {PARTS_SQL}
SELECT source_id, pos, part, CASE WHEN reason IS NULL OR reason = 'past_end' THEN a END AS first,
  CASE WHEN reason IS NULL OR reason = 'past_end' THEN b END AS last, reason FROM parsed""")
def page_ranges(spark, sf):
    return ops.parse_ranges(ranges(spark, sf), ["source_id"], "expr", "page_count")


def _good_ranges(spark, sf):
    parsed = ops.parse_ranges(ranges(spark, sf), ["source_id"], "expr", "page_count")
    return parsed.where("reason IS NULL").withColumn("part_no", F.col("pos") + 1)


@query("range_pages", f"""
WITH {PARTS_SQL}
SELECT source_id, pos + 1 AS part_no, unnest(range(a, b + 1))::INTEGER AS page_no FROM parsed WHERE reason IS NULL""")
def range_pages(spark, sf):
    return ops.range_pages(_good_ranges(spark, sf)).select("source_id", "part_no", "page_no")


@query("sink_split_parts", f"""
WITH {PARTS_SQL},
x AS (SELECT source_id, pos + 1 AS part_no, a, b, unnest(range(a, b + 1)) AS page_no FROM parsed WHERE reason IS NULL)
SELECT source_id, part_no, 'doc_' || source_id || '_' || a || CASE WHEN a = b THEN '' ELSE '-' || b END || '.pdf' AS part_name,
  count(*) AS pages FROM x GROUP BY ALL""")
def sink_split_parts(spark, sf):
    rows = ops.range_pages(_good_ranges(spark, sf))
    name = ops.part_name(F.concat(F.lit("doc:"), F.col("source_id").cast("string")), F.col("first"), F.col("last"))
    # Parts are many and small: a folder holds those of a thirty-second of all sources.
    parts = rows.select("source_id", "part_no", name.alias("part_name"), "page_no", F.pmod(F.xxhash64("source_id"), F.lit(32)).cast("int").alias("folder"))
    target = scratch(spark, "parts")
    write_parts(parts, target, ["folder"], 100_000)
    return spark.read.parquet(target).groupBy("source_id", "part_no", "part_name").agg(F.count(F.lit(1)).alias("pages"))


@query("cascade_delete", f"""
WITH p AS ({PAGES_SQL})
SELECT doc_id, seq, source FROM p WHERE lower(source) NOT IN (SELECT 'scan_' || s_suppkey || '.pdf' FROM supplier WHERE s_nationkey % 4 = 0)""")
def cascade_delete(spark, sf):
    gone = table(spark, sf, "supplier").where("s_nationkey % 4 = 0").select(
        F.concat(F.lit("Scan_"), F.col("s_suppkey"), F.lit(".PDF")).alias("source")
    )
    return ops.cascade_delete(t.derived(spark, sf, t.LINE_PAGES, "lineitem"), gone, "source").select("doc_id", "seq", "source")


@query("page_numbers", f"""
WITH sources AS ({SOURCES_SQL}), p AS ({SOURCE_PAGES_SQL})
SELECT p.source_id, page_no, CASE WHEN page_no > 2 THEN 'Page ' || (10 + page_no - 1 - 2) || ' of ' || (page_count - 2) END AS label
FROM p JOIN sources ON p.source_id = sources.source_id""")
def page_numbers(spark, sf):
    return ops.page_numbers(
        source_pages(spark, sf), sources(spark, sf), ["source_id"], start=10, skip=2, template="Page {0} of {1}"
    )


@query("merge_sequence", f"""
WITH sources AS ({SOURCES_SQL}), p AS ({SOURCE_PAGES_SQL}),
f AS (SELECT o_custkey AS merge_id, o_orderkey AS file_seq, o_orderkey AS source_id FROM orders)
SELECT merge_id, file_seq, f.source_id, page_no, row_number() OVER (PARTITION BY merge_id ORDER BY file_seq, page_no) AS out_page
FROM f JOIN p ON f.source_id = p.source_id""")
def merge_sequence(spark, sf):
    files = table(spark, sf, "orders").selectExpr("o_custkey AS merge_id", "o_orderkey AS file_seq", "o_orderkey AS source_id")
    sized = files.join(sources(spark, sf), "source_id").select("merge_id", "file_seq", "source_id", "page_count")
    return ops.merge_sequence(sized, source_pages(spark, sf))


@query("fixed_chunks", f"""
WITH sources AS ({SOURCES_SQL}), p AS ({SOURCE_PAGES_SQL})
SELECT source_id, (page_no - 1) // 3 + 1 AS chunk_no, min(page_no)::BIGINT AS first, max(page_no)::BIGINT AS last FROM p GROUP BY ALL""")
def fixed_chunks(spark, sf):
    chunks = ops.fixed_chunks(sources(spark, sf), 3)
    return chunks.select("source_id", F.col("chunk_no").cast("int"), "first", F.col("last").cast("bigint"))


@query("rotation_total", """
SELECT l_orderkey AS source_id, l_linenumber AS page_no,
  (((sum((l_partkey % 9 - 4) * 90) % 360) + 360) % 360)::INTEGER AS rotation
FROM lineitem GROUP BY ALL HAVING NOT bool_or(l_suppkey % 20 = 0)""")
def rotation_total(spark, sf):
    steps = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS source_id", "l_linenumber AS page_no",
        "(l_partkey % 9 - 4) * 90 + CASE WHEN l_suppkey % 20 = 0 THEN 45 ELSE 0 END AS degrees",
    )
    return ops.rotation_total(steps, ["source_id", "page_no"])


@query("mixed_sources", f"""
WITH p AS ({PAGES_SQL})
SELECT doc_id, seq, source, count(DISTINCT lower(source)) OVER (PARTITION BY doc_id) > 1 AS mixed FROM p""")
def mixed_sources(spark, sf):
    rows = t.derived(spark, sf, t.LINE_PAGES, "lineitem").select("doc_id", "seq", "source")
    return ops.mixed_sources(rows, ["doc_id"], "source")


@query("page_selection", f"WITH p AS ({PAGES_SQL}) SELECT doc_id, seq, NOT selected AS selected FROM p WHERE selected")
def page_selection(spark, sf):
    return ops.invert_and_delete(t.derived(spark, sf, t.LINE_PAGES, "lineitem").select("doc_id", "seq", "selected"))


@query("selection_summary", f"""
WITH p AS ({PAGES_SQL}),
s AS (SELECT doc_id, count(*) FILTER (WHERE selected) AS selected, count(*) AS total,
  coalesce(sum(size_bytes) FILTER (WHERE selected), 0)::BIGINT AS bytes FROM p GROUP BY doc_id)
SELECT *, {SIZE_LABEL.format('bytes')} AS label FROM s""")
def selection_summary(spark, sf):
    return ops.selection_summary(t.derived(spark, sf, t.LINE_PAGES, "lineitem"), ["doc_id"])


@query("merge_union", """
SELECT kind, id, seq, text FROM (
  SELECT 'conversation' AS kind, conv_id AS id, turn AS seq, text FROM conversations UNION ALL
  SELECT 'document', doc_id, 0, text FROM documents UNION ALL SELECT 'benchmark', item_id, 0, text FROM benchmark)""")
def merge_union(spark, sf):
    return ops.merge_union(
        table(spark, sf, "conversations").selectExpr("'conversation' AS kind", "conv_id AS id", "turn AS seq", "text"),
        table(spark, sf, "documents").selectExpr("'document' AS kind", "doc_id AS id", "0L AS seq", "text"),
        table(spark, sf, "benchmark").selectExpr("'benchmark' AS kind", "item_id AS id", "0L AS seq", "text"),
    )


KEEP_SQL = (
    "SELECT o_orderkey AS source_id, unnest([o_custkey % 4 + 1, 1]) AS page_no, unnest([1, 2]) AS position FROM orders"
)


def _keep(spark, sf):
    listed = F.array((F.col("o_custkey") % 4 + 1).cast("int"), F.lit(1))
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("source_id"), F.posexplode(listed).alias("pos", "page_no")
    ).select("source_id", "page_no", (F.col("pos") + 1).alias("position"))


@query("keep_list", f"""
WITH sources AS ({SOURCES_SQL}), p AS ({SOURCE_PAGES_SQL}), k AS ({KEEP_SQL})
SELECT k.source_id, k.position, k.page_no::INTEGER AS page_no FROM k JOIN p ON k.source_id = p.source_id AND k.page_no = p.page_no""")
def keep_list(spark, sf):
    return ops.keep_list(source_pages(spark, sf), _keep(spark, sf), ["source_id"], "page_no").select(
        "source_id", "position", "page_no"
    )


@query("removed_pages", f"""
WITH sources AS ({SOURCES_SQL}), p AS ({SOURCE_PAGES_SQL}), k AS ({KEEP_SQL})
SELECT source_id, page_no FROM p WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.source_id = p.source_id AND k.page_no = p.page_no)""")
def removed_pages(spark, sf):
    return ops.removed_pages(source_pages(spark, sf), _keep(spark, sf), ["source_id"], "page_no")


@query("distinct_ci", f"""
WITH p AS ({PAGES_SQL}),
r AS (SELECT source, doc_id, seq, row_number() OVER (PARTITION BY lower(source) ORDER BY doc_id, seq) AS rn FROM p)
SELECT source, doc_id, seq FROM r WHERE rn = 1""")
def distinct_ci(spark, sf):
    rows = t.derived(spark, sf, t.LINE_PAGES, "lineitem").select("source", "doc_id", "seq")
    return ops.distinct_ci(rows, "source", ["doc_id", "seq"])


@query("compression_report", """
WITH r AS (SELECT p_brand AS kind, l_extendedprice::BIGINT AS original, (l_extendedprice * (0.4 + l_discount * 8))::BIGINT AS packed
           FROM lineitem JOIN part ON l_partkey = p_partkey),
s AS (SELECT kind, sum(original)::BIGINT AS original, sum(least(original, packed))::BIGINT AS stored FROM r GROUP BY kind)
SELECT *, round_even((original - stored) * 100.0 / original, 1)::DOUBLE AS saved_pct FROM s""")
def compression_report(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("kind"),
        F.bround("l_extendedprice").cast("bigint").alias("original"),
        F.bround(F.col("l_extendedprice") * (0.4 + F.col("l_discount") * 8)).cast("bigint").alias("packed"),
    )
    return ops.compression_report(rows, ["kind"])


@query("reading_order", """
SELECT l_orderkey AS doc_id, l_linenumber AS page_no, l_extendedprice AS top, l_quantity AS left, l_partkey AS block_no,
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice, l_quantity, l_partkey, l_suppkey) AS position
FROM lineitem""")
def reading_order(spark, sf):
    blocks = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS doc_id", "l_linenumber AS page_no", "l_extendedprice AS top", "l_quantity AS left",
        "l_partkey AS block_no", "l_suppkey",
    )
    return ops.reading_order(blocks, ["doc_id", "page_no"], ["block_no", "l_suppkey"]).drop("l_suppkey")
