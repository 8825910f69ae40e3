"""Engine input tables derived from the star-schema and text tables.

Each table is a list of projections that Spark and the checking SQL read alike, so both
sides start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.operators.requests import TOOLS
from docflow.plans.registry import table

# One page-plan row per line item; a third of them point past the end of their source.
PLAN_SEQ = "CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 1000000 + l_suppkey"
PAGE_PLAN = {
    "plan_id": "l_orderkey",
    "seq": PLAN_SEQ,
    "source_id": "l_orderkey",
    "page_index": "CAST(l_quantity AS INT) % 8",
    "rotation": "CAST(90 * (l_partkey % 4) AS INT)",
}
LINE_PAGES = {
    "doc_id": "l_orderkey",
    "seq": PLAN_SEQ,
    "page_no": "CAST(l_linenumber AS INT)",
    "source": "CASE WHEN l_suppkey % 2 = 0 THEN concat('Scan_', CAST(l_suppkey AS STRING), '.pdf')"
    " ELSE concat('SCAN_', CAST(l_suppkey + 1 AS STRING), '.PDF') END",
    "size_bytes": "CAST(floor(l_extendedprice) AS BIGINT)",
    "selected": "l_quantity > 25",
}
CATALOG = {
    "id": "p_partkey",
    "title": "p_name",
    "description": "p_type",
    "category": "p_brand",
}
RELEASES = {
    "product": "p_brand",
    "release_id": "p_partkey",
    "raw": """CASE
      WHEN p_partkey % 29 = 0 THEN '{' WHEN p_partkey % 31 = 0 THEN 'null'
      WHEN p_partkey % 37 = 0 THEN '<html>error</html>' WHEN p_partkey % 41 = 0 THEN '[]'
      WHEN p_partkey % 43 = 0 THEN '' ELSE concat(
      '{"tag_name":"', CASE WHEN p_partkey % 13 = 0 THEN 'latest' WHEN p_partkey % 3 = 0 THEN '' ELSE 'v' END,
      CASE WHEN p_partkey % 13 = 0 THEN '' ELSE concat(CAST(p_size % 12 AS STRING), '.', CAST(p_partkey % 11 AS STRING),
        CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat('.', CAST(p_partkey % 9 AS STRING)) END) END,
      '","draft":', CASE WHEN p_partkey % 11 = 0 THEN 'true' ELSE 'false' END,
      ',"prerelease":', CASE WHEN p_partkey % 17 = 0 THEN 'true' ELSE 'false' END,
      ',"name":"', p_name, '","body":"', p_type, '","published_at":"2024-0', CAST(1 + p_partkey % 9 AS STRING), '-15T10:00:00Z"',
      ',"assets":[{"name":"', CASE WHEN p_partkey % 4 = 0 THEN 'notes.zip' ELSE concat('Setup-', CAST(p_size AS STRING), '.0.exe') END,
      '","size":', CASE WHEN p_partkey % 7 = 0 THEN '0' ELSE CAST(1000 + p_partkey AS STRING) END,
      ',"browser_download_url":"', CASE WHEN p_partkey % 6 = 0 THEN 'http://github.com/a/' WHEN p_partkey % 10 = 3 THEN 'https://github.com.evil.example/a/'
        ELSE 'https://github.com/a/' END, CAST(p_partkey AS STRING), '"}',
      ',{"name":"SETUP-', CAST(p_size AS STRING), '.1.2.EXE","size":', CAST(500 + p_partkey AS STRING),
      ',"browser_download_url":"https://', CASE WHEN p_partkey % 2 = 0 THEN 'Objects.GitHubUserContent.com' ELSE 'cdn.example.com' END, '/b"}]}') END""",
}
TOOL_CASE = "CASE o_orderkey % 17 " + " ".join(f"WHEN {i} THEN '{tool}'" for i, (tool, _) in enumerate(TOOLS)) + " END"
REQUESTS = {
    "request_id": "o_orderkey",
    "tool": TOOL_CASE,
    "output_path": "CASE WHEN o_custkey % 9 = 0 THEN '  ' ELSE concat('out_', CAST(o_orderkey AS STRING), '.pdf') END",
    "output_folder": "CASE WHEN o_custkey % 8 = 0 THEN NULL ELSE concat('out/', CAST(o_custkey AS STRING)) END",
    "password": "CASE WHEN o_custkey % 3 = 0 THEN NULL WHEN o_custkey % 3 = 1 THEN '' ELSE 'pw' END",
    "user_password": "CASE WHEN o_custkey % 4 = 0 THEN 'u' WHEN o_custkey % 4 = 1 THEN '' END",
    "owner_password": "CASE WHEN o_custkey % 5 = 0 THEN 'o' END",
    "apply_to_all": "CASE WHEN o_custkey % 2 = 0 THEN TRUE ELSE FALSE END",
    "plan_rows": "CAST(o_custkey % 3 AS INT)",
    "split_mode": "CASE WHEN o_custkey % 3 = 0 THEN 'Ranges' WHEN o_custkey % 3 = 1 THEN 'FixedChunks' ELSE 'EachPage' END",
    "range_expression": "CASE WHEN o_custkey % 6 = 0 THEN ' ' ELSE '1-3' END",
    "pages_per_file": "CAST(o_custkey % 5 AS INT)",
    "watermark_text": "CASE WHEN o_custkey % 7 = 0 THEN ' ' WHEN o_custkey % 7 = 1 THEN NULL ELSE 'draft' END",
    "has_options": "CASE WHEN o_orderkey % 10 = 0 THEN FALSE ELSE TRUE END",
    "recognition": "CASE WHEN o_custkey % 2 = 0 THEN 'TextLayerOnly' ELSE 'Automatic' END",
    "engine": "CASE WHEN o_custkey % 3 = 0 THEN 'MicrosoftWord' ELSE 'Automatic' END",
    "languages": "CASE WHEN o_custkey % 6 = 0 THEN ' + ' WHEN o_custkey % 6 = 1 THEN NULL "
    "WHEN o_custkey % 6 = 2 THEN 'uzb+ENG+ eng' WHEN o_custkey % 6 = 3 THEN concat('rus+l', CAST(o_custkey % 50 AS STRING)) "
    "ELSE concat('l', CAST(o_custkey % 90 AS STRING), '+uzb') END",
}
REQUEST_FILES = {
    "request_id": "l_orderkey",
    "seq": PLAN_SEQ,
    "path": "concat('in/Part_', CAST(l_partkey AS STRING), '.pdf')",
}
INPUT_MANIFEST = {"path": "concat('in/part_', CAST(p_partkey AS STRING), '.PDF')", "size": "CAST(p_size AS BIGINT)"}
INSTALLED = {"file": "concat(CASE WHEN c_custkey % 2 = 0 THEN 'L' ELSE 'l' END, CAST(c_custkey % 80 AS STRING), '.traineddata')"}

HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
URL_PATH = "regexp_extract(url, '^https?://[^/?#]+/?([^?#]*)', 1)"
ARCHIVE_ENTRIES = {
    "archive_id": HOST,
    "entry_no": "page_id",
    "path": f"CASE page_id % 5 WHEN 0 THEN concat('/', {URL_PATH}) WHEN 1 THEN replace({URL_PATH}, '/', '\\') "
    f"WHEN 2 THEN upper({URL_PATH}) ELSE {URL_PATH} END",
    "size": "CASE WHEN page_id % 23 = 0 THEN NULL ELSE CAST(length(html) AS BIGINT) END",
    "compressed_size": "CAST(floor(length(html) / 3) AS BIGINT)",
    "is_directory": "right(url, 1) = '/'",
    "is_encrypted": "page_id % 97 = 0",
}


def derived_sql(fields: dict[str, str], source: str) -> str:
    """The projection as SQL text, for the checking engine."""
    return "SELECT " + ", ".join(f"{e} AS {c}" for c, e in fields.items()) + f" FROM {source}"


def derived(spark: SparkSession, sf: str, fields: dict[str, str], source: str) -> DataFrame:
    return table(spark, sf, source).select(
        *(F.expr(e.replace("\\", "\\\\")).alias(c) for c, e in fields.items())
    )
