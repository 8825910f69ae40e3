"""Queries over lists: files, requests, catalog, releases, archives."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.operators import catalog, manifest, releases, requests
from docflow.plans.registry import query, table
from docflow.sources import tables as t

SIZE_LABEL = (
    "CASE WHEN {0} < 1024 THEN {0}::VARCHAR || ' B'"
    " WHEN {0} < 1048576 THEN printf('%.1f KB', round({0} / 1024.0::DOUBLE, 1))"
    " WHEN {0} < 1073741824 THEN printf('%.1f MB', round({0} / 1048576.0::DOUBLE, 1))"
    " ELSE printf('%.1f GB', round({0} / 1073741824.0::DOUBLE, 1)) END"
)
FILE_PATHS = {
    "file_no": "page_id",
    "path": f"CASE WHEN page_id % 3 = 0 THEN upper({t.URL_PATH}) ELSE {t.URL_PATH} END",
}
PATHS_SQL = t.derived_sql(FILE_PATHS, "pages")
ENTRIES_SQL = t.derived_sql(t.ARCHIVE_ENTRIES, "pages")
NORM_KEY = "regexp_replace(replace({0}, '\\', '/'), '^/+', '')"


def archive_entries(spark, sf):
    return t.derived(spark, sf, t.ARCHIVE_ENTRIES, "pages")


@query("scan_manifest", f"""
WITH p AS ({PATHS_SQL}),
n AS (SELECT *, row_number() OVER (PARTITION BY lower(path) ORDER BY file_no) AS rn FROM p
      WHERE regexp_matches(lower(path), '\\.html?$'))
SELECT file_no, path FROM n WHERE rn = 1""")
def scan_manifest(spark, sf):
    return manifest.scan_manifest(t.derived(spark, sf, FILE_PATHS, "pages"), "path", "file_no", [".html", ".HTM"])


@query("archive_ext_filter", r"""
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  concat('dir.v1/Part_', l_partkey, CASE l_suppkey % 7 WHEN 0 THEN '.ZIP' WHEN 1 THEN '.tar.gz' WHEN 2 THEN '.pdf'
         WHEN 3 THEN '.Cbr' WHEN 4 THEN '' WHEN 5 THEN '.7z' ELSE '.zip.txt' END) AS path FROM lineitem)
SELECT * FROM p WHERE regexp_matches(lower(path), '\.(zip|rar|7z|tar|gz|bz2|cbz|cbr)$')""")
def archive_ext_filter(spark, sf):
    tail = (
        "CASE l_suppkey % 7 WHEN 0 THEN '.ZIP' WHEN 1 THEN '.tar.gz' WHEN 2 THEN '.pdf' WHEN 3 THEN '.Cbr' "
        "WHEN 4 THEN '' WHEN 5 THEN '.7z' ELSE '.zip.txt' END"
    )
    rows = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", f"concat('dir.v1/Part_', l_partkey, {tail}) AS path"
    )
    return manifest.archives(rows, "path")


@query("entry_semi", f"""
WITH e AS ({ENTRIES_SQL}),
w AS (SELECT {t.HOST} AS archive_id, lower({NORM_KEY.format(t.URL_PATH)}) AS k FROM pages WHERE page_id % 2 = 0)
SELECT archive_id, entry_no, path FROM e WHERE NOT is_directory AND path <> ''
  AND EXISTS (SELECT 1 FROM w WHERE w.archive_id = e.archive_id AND w.k = lower({NORM_KEY.format('e.path')}))""")
def entry_semi(spark, sf):
    wanted = table(spark, sf, "pages").selectExpr(f"{t.HOST} AS archive_id", f"{t.URL_PATH} AS path", "page_id")
    found = manifest.entry_semi(archive_entries(spark, sf), wanted.where("page_id % 2 = 0"), ["archive_id"])
    return found.select("archive_id", "entry_no", "path")


@query("archive_summary", f"""
WITH e AS ({ENTRIES_SQL}),
s AS (SELECT archive_id, count(*) FILTER (WHERE NOT is_directory)::BIGINT AS files,
  coalesce(sum(size) FILTER (WHERE NOT is_directory), 0)::BIGINT AS bytes, bool_or(is_encrypted) AS encrypted,
  max(CASE WHEN size > 0 AND compressed_size > 0 AND compressed_size <= size
      THEN 100 - (compressed_size * 100) // size END) FILTER (WHERE NOT is_directory)::INTEGER AS best_saved
  FROM e GROUP BY archive_id)
SELECT *, {SIZE_LABEL.format('bytes')} AS label FROM s""")
def archive_summary(spark, sf):
    return manifest.archive_summary(archive_entries(spark, sf), ["archive_id"])


HOSTILE = {
    0: ("concat('/', x)", "x"),
    1: ("concat('../', x)", "NULL"),
    2: ("concat('C:\\\\', replace(x, '/', '\\\\'))", "x"),
    3: ("concat('a/./b/../', x)", "concat('a/', x)"),
    4: ("concat('a/../../b/', x)", "NULL"),
    5: ("concat('\\\\\\\\server\\\\', x)", "concat('server/', x)"),
    6: ("concat(x, '/../..', '/../../..')", "NULL"),
    7: ("concat('a//b///', x)", "concat('a/b/', x)"),
    8: ("'a/..'", "NULL"),
    9: ("concat('c:../', x)", "NULL"),
}


@query("path_safety", "WITH p AS (SELECT page_id, 'd/' || page_id || '.html' AS x FROM pages) SELECT page_id, "
       + "CASE page_id % 10 " + " ".join(f"WHEN {k} THEN {a}" for k, (a, _) in HOSTILE.items()).replace("\\\\", "\\")
       + " END AS path, CASE page_id % 10 " + " ".join(f"WHEN {k} THEN {b}" for k, (_, b) in HOSTILE.items())
       + " END AS safe_path, CASE WHEN page_id % 10 IN (1, 4, 6, 8, 9) THEN 'rejected' ELSE 'ok' END AS verdict FROM p")
def path_safety(spark, sf):
    case = "CASE page_id % 10 " + " ".join(f"WHEN {k} THEN {a}" for k, (a, _) in HOSTILE.items()) + " END AS path"
    rows = table(spark, sf, "pages").selectExpr("page_id", "concat('d/', page_id, '.html') AS x")
    return manifest.path_safety(rows.selectExpr("page_id", case))


@query("self_exclude", f"""
WITH e AS ({ENTRIES_SQL})
SELECT archive_id, entry_no, path FROM e WHERE lower(path) <> lower(CASE WHEN entry_no % 10 = 0 THEN upper(path) ELSE 'all.zip' END)""")
def self_exclude(spark, sf):
    files = archive_entries(spark, sf)
    target = F.expr("CASE WHEN entry_no % 10 = 0 THEN upper(path) ELSE 'all.zip' END")
    return manifest.self_exclude(files, F.col("path"), target).select("archive_id", "entry_no", "path")


@query("folder_totals", f"""
WITH e AS ({ENTRIES_SQL}),
p AS (SELECT archive_id, coalesce(size, 0) AS size,
        list_filter(string_split({NORM_KEY.format('path')}, '/'), lambda x: x <> '') AS parts
      FROM e WHERE NOT is_directory),
x AS (SELECT archive_id, size, unnest(list_transform(range(1, len(parts)), lambda n: array_to_string(parts[1:n], '/'))) AS folder FROM p)
SELECT archive_id, folder, count(*) AS files, sum(size)::BIGINT AS bytes FROM x GROUP BY ALL""")
def folder_totals(spark, sf):
    return manifest.folder_totals(archive_entries(spark, sf), ["archive_id"])


NAMES = {
    "archive_id": t.HOST,
    "seq": "page_id",
    "name": "concat(CASE WHEN page_id % 2 = 0 THEN 'Page' ELSE 'page' END, CAST(page_id % 7 AS STRING), "
    "CASE WHEN page_id % 3 = 0 THEN '' ELSE '.html' END)",
}


@query("unique_names", f"""
WITH n AS ({t.derived_sql(NAMES, 'pages')}),
r AS (SELECT *, row_number() OVER (PARTITION BY archive_id, lower(name) ORDER BY seq) AS k FROM n)
SELECT archive_id, seq, name, CASE WHEN k = 1 THEN name
  ELSE regexp_replace(name, '(\\.html)?$', ' (' || k || ')') || CASE WHEN name LIKE '%.html' THEN '.html' ELSE '' END END AS unique_name
FROM r""")
def unique_names(spark, sf):
    names = t.derived(spark, sf, NAMES, "pages")
    return manifest.unique_names(names, ["archive_id"], "name", ["seq"], F.floor(F.col("seq") / 4096))


# ---- requests -------------------------------------------------------------------------

INSTALLED_SQL = (
    "SELECT DISTINCT lower(replace(file, '.traineddata', '')) AS code FROM (" + t.derived_sql(t.INSTALLED, "customer") + ")"
)
CODES_SQL = """list_distinct_ci AS (
  SELECT request_id, code, pos FROM (
    SELECT request_id, trim(code) AS code, pos,
      row_number() OVER (PARTITION BY request_id, lower(trim(code)) ORDER BY pos) AS rn
    FROM (SELECT request_id, unnest(string_split(x, '+')) AS code, unnest(range(len(string_split(x, '+')))) AS pos FROM asked)
    WHERE trim(code) <> '') WHERE rn = 1)"""


def _asked(source: str, expr: str) -> str:
    usable = f"len(list_filter(string_split(coalesce({expr}, ''), '+'), lambda p: trim(p) <> '')) > 0"
    return f"asked AS (SELECT request_id, CASE WHEN {usable} THEN {expr} ELSE 'uzb+eng+rus' END AS x FROM {source})"


def _requests(spark, sf):
    return t.derived(spark, sf, t.REQUESTS, "orders")


def _installed(spark, sf):
    return requests.installed_languages(t.derived(spark, sf, t.INSTALLED, "customer"))


@query("missing_languages", f"""
WITH r AS ({t.derived_sql(t.REQUESTS, 'orders')}), have AS ({INSTALLED_SQL}), {_asked('r', 'languages')}, {CODES_SQL}
SELECT request_id, code FROM list_distinct_ci WHERE lower(code) NOT IN (SELECT code FROM have)""")
def missing_languages(spark, sf):
    return requests.missing_languages(_requests(spark, sf), _installed(spark, sf), "request_id", "languages")


@query("distinct_languages", INSTALLED_SQL)
def distinct_languages(spark, sf):
    return _installed(spark, sf)


COMPONENT_SQL = f"""
r AS ({t.derived_sql(t.REQUESTS, 'orders')}), have AS ({INSTALLED_SQL}),
scans AS (SELECT request_id, CASE WHEN has_options THEN languages END AS languages FROM r
  WHERE tool = 'OcrToWord' OR (tool = 'PdfToWord' AND has_options AND recognition <> 'TextLayerOnly')),
{_asked('scans', 'languages')}, {CODES_SQL},
lacking AS (SELECT DISTINCT request_id FROM list_distinct_ci WHERE lower(code) NOT IN (SELECT code FROM have)),
comp AS (SELECT r.*, CASE WHEN r.request_id IN (SELECT request_id FROM lacking) THEN 'languages'
  WHEN tool = 'BackgroundRemover' THEN 'model' ELSE 'none' END AS component FROM r)"""


@query("prerequisite_check", f"WITH {COMPONENT_SQL} SELECT request_id, tool, component FROM comp")
def prerequisite_check(spark, sf):
    found = requests.missing_component(_requests(spark, sf), _installed(spark, sf), model_available=False)
    return found.select("request_id", "tool", "component")


@query("request_rules", f"""
WITH {COMPONENT_SQL},
f AS ({t.derived_sql(t.REQUEST_FILES, 'lineitem')}),
m AS (SELECT DISTINCT lower(path) AS path FROM ({t.derived_sql(t.INPUT_MANIFEST, 'part WHERE p_size > 5')})),
i AS (SELECT request_id, count(*) AS n, bool_or(lower(path) NOT IN (SELECT path FROM m)) AS missing FROM f GROUP BY request_id)
SELECT c.request_id, tool, CASE
  WHEN i.n IS NULL THEN 'no_input' WHEN i.missing THEN 'file_not_found'
  WHEN tool IN ('Split', 'PdfToImage') AND trim(coalesce(output_folder, '')) = '' THEN 'no_output_folder'
  WHEN tool NOT IN ('Split', 'PdfToImage') AND trim(coalesce(output_path, '')) = '' THEN 'no_output_file'
  WHEN tool = 'Merge' AND i.n < 2 AND plan_rows = 0 THEN 'merge_needs_two'
  WHEN tool = 'Unlock' AND coalesce(password, '') = '' THEN 'password_needed'
  WHEN tool = 'Protect' AND coalesce(CASE WHEN has_options THEN coalesce(user_password, password) ELSE password END, '') = ''
       AND (NOT has_options OR coalesce(owner_password, '') = '') THEN 'no_protection'
  WHEN tool = 'Rotate' AND has_options AND NOT apply_to_all AND plan_rows = 0 THEN 'no_page_selection'
  WHEN tool = 'Split' AND has_options AND split_mode = 'Ranges' AND trim(range_expression) = '' THEN 'no_ranges'
  WHEN tool = 'Split' AND has_options AND split_mode = 'FixedChunks' AND pages_per_file < 1 THEN 'bad_chunk'
  WHEN tool = 'Watermark' AND has_options AND trim(coalesce(watermark_text, '')) = '' THEN 'no_watermark_text'
  WHEN tool = 'WordToPdf' AND has_options AND engine = 'MicrosoftWord' THEN 'word_not_available'
  WHEN component = 'languages' THEN 'languages_missing' WHEN component = 'model' THEN 'model_missing' END AS violation
FROM comp c LEFT JOIN i ON c.request_id = i.request_id""")
def request_rules(spark, sf):
    existing = t.derived(spark, sf, t.INPUT_MANIFEST | {"p_size": "p_size"}, "part").where("p_size > 5")
    files = t.derived(spark, sf, t.REQUEST_FILES, "lineitem")
    return requests.request_rules(_requests(spark, sf), files, existing, _installed(spark, sf))


@query("batch_outcome", """
SELECT o_custkey AS batch_id, count(*) FILTER (WHERE o_orderstatus <> 'P') AS ok,
  count(*) FILTER (WHERE o_orderstatus = 'P') AS failed,
  CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'P') = 0 THEN 'all_ok'
       WHEN count(*) FILTER (WHERE o_orderstatus <> 'P') = 0 THEN 'all_failed' ELSE 'partly' END AS outcome
FROM orders GROUP BY o_custkey""")
def batch_outcome(spark, sf):
    items = table(spark, sf, "orders").selectExpr(
        "o_custkey AS batch_id", "CASE WHEN o_orderstatus = 'P' THEN 'file is locked' END AS error"
    )
    return requests.batch_outcome(items, ["batch_id"])


# ---- catalog --------------------------------------------------------------------------

CATALOG_SQL = t.derived_sql(t.CATALOG, "part")


@query("catalog_search", f"""
WITH c AS ({CATALOG_SQL})
SELECT category, count(*) AS n_items, min(id) AS first_id FROM c
WHERE contains(lower(concat_ws(' ', title, description, category)), 'ring') GROUP BY category""")
def catalog_search(spark, sf):
    return catalog.search(t.derived(spark, sf, t.CATALOG, "part"), " Ring ")


@query("catalog_groups", f"""
WITH c AS ({CATALOG_SQL}), f AS (SELECT category, min(id) AS first_id FROM c GROUP BY category),
o AS (SELECT category, row_number() OVER (ORDER BY first_id) AS group_no FROM f)
SELECT o.category, group_no, row_number() OVER (PARTITION BY c.category ORDER BY id) AS position, id, title
FROM c JOIN o ON c.category = o.category""")
def catalog_groups(spark, sf):
    return catalog.groups(t.derived(spark, sf, t.CATALOG, "part"))


# ---- releases -------------------------------------------------------------------------

RELEASES_SQL = t.derived_sql(t.RELEASES, "part")
PARSED_SQL = f"""
raw AS ({RELEASES_SQL}),
js AS (SELECT *, CASE WHEN json_valid(raw) AND json_type(raw) = 'OBJECT' THEN raw::JSON END AS j FROM raw),
f AS (SELECT product, release_id, j->>'tag_name' AS tag, j->>'draft' AS draft, j->>'prerelease' AS prerelease,
  j->>'name' AS name, j->'assets' AS assets, regexp_replace(trim(j->>'tag_name'), '^[vV]', '') AS bare FROM js WHERE j IS NOT NULL),
v AS (SELECT *, CASE WHEN regexp_matches(bare, '^\\d+(\\.\\d+){{1,3}}$') THEN
   list_transform(list_resize(string_split(bare, '.')[1:3], 3, '0'), lambda x: x::INTEGER) END AS version FROM f)"""
VERSION_TEXT = "concat(version[1], '.', version[2], '.', version[3])"
ACCEPTED_SQL = f"""{PARSED_SQL},
a AS (SELECT *, unnest(assets->'$[*]') AS asset, unnest(range(json_array_length(assets)::BIGINT)) AS pos FROM v
  WHERE draft = 'false' AND prerelease = 'false' AND version > [2, 1, 0]),
g AS (SELECT *, row_number() OVER (PARTITION BY product, release_id ORDER BY pos) AS rn FROM a
  WHERE regexp_matches(asset->>'name', '(?i)^setup-\\d+(\\.\\d+){{1,3}}\\.exe$') AND (asset->>'size')::BIGINT > 0
    AND regexp_matches(lower(asset->>'browser_download_url'), '^https://(github\\.com|objects\\.githubusercontent\\.com)/'))"""


def _parsed(spark, sf):
    return releases.parse_releases(t.derived(spark, sf, t.RELEASES, "part"))


def _accepted(spark, sf):
    return releases.accept_releases(_parsed(spark, sf), F.array(F.lit(2), F.lit(1), F.lit(0)), "Setup-")


def _text(version):
    return F.array_join(F.col(version).cast("array<string>"), ".")


@query("load_releases", f"""
WITH {PARSED_SQL}
SELECT r.product, r.release_id, v.tag, {VERSION_TEXT.replace('version', 'v.version')} AS version, v.name,
  coalesce(json_array_length(v.assets), 0)::INTEGER AS n_assets
FROM raw r LEFT JOIN v ON r.release_id = v.release_id""".replace("concat(v.version[1]", "CASE WHEN v.version IS NOT NULL THEN concat(v.version[1]").replace("v.version[3])", "v.version[3]) END"))
def load_releases(spark, sf):
    return _parsed(spark, sf).select(
        "product", "release_id", F.col("release.tag_name").alias("tag"), _text("version").alias("version"),
        F.col("release.name").alias("name"), F.coalesce(F.size("release.assets"), F.lit(0)).alias("n_assets"),
    )


@query("release_accept", f"""
WITH {ACCEPTED_SQL}
SELECT product, release_id, {VERSION_TEXT} AS version, asset->>'name' AS asset, (asset->>'size')::BIGINT AS size
FROM g WHERE rn = 1""")
def release_accept(spark, sf):
    return _accepted(spark, sf).select(
        "product", "release_id", _text("version").alias("version"), F.col("asset.name").alias("asset"),
        F.col("asset.size").cast("bigint").alias("size"),
    )


@query("latest_release", f"""
WITH {ACCEPTED_SQL},
b AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY version DESC, release_id DESC) AS k FROM g WHERE rn = 1)
SELECT product, release_id, {VERSION_TEXT} AS version FROM b WHERE k = 1""")
def latest_release(spark, sf):
    best = releases.latest_release(_accepted(spark, sf).select("product", "release_id", "version"), ["product"], "release_id")
    return best.select("product", "release_id", _text("version").alias("version"))


@query("first_match", f"""
WITH {PARSED_SQL}, a AS (SELECT release_id, unnest(assets->'$[*]') AS asset, unnest(range(json_array_length(assets)::BIGINT)) AS pos FROM v),
m AS (SELECT release_id, asset->>'name' AS name, row_number() OVER (PARTITION BY release_id ORDER BY pos) AS rn FROM a
      WHERE lower(asset->>'name') LIKE '%.exe')
SELECT release_id, name AS first_installer FROM m WHERE rn = 1""")
def first_match(spark, sf):
    found = F.get(F.filter("release.assets", lambda a: F.lower(a["name"]).endswith(".exe")), F.lit(0))
    rows = _parsed(spark, sf).select("release_id", found["name"].alias("first_installer"))
    return rows.where("first_installer IS NOT NULL")


TRUSTED = ("blog.tionsh.example.net", "THTHER.example.org", "m.ththth.example.net", "m.tionsh.example.net", "thther.example.com")


@query("trusted_urls", """
WITH u AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN replace(url, '.example.', '.example.evil.') WHEN 1 THEN upper(left(url, 8)) || substr(url, 9)
  WHEN 2 THEN 'not a url ' || page_id WHEN 3 THEN replace(url, '://', '://a@') ELSE url END AS url FROM pages)
SELECT page_id, url FROM u WHERE regexp_matches(lower(url), '^https://(a@)?(blog\\.tionsh\\.example\\.net|thther\\.example\\.org|m\\.ththth\\.example\\.net|m\\.tionsh\\.example\\.net|thther\\.example\\.com)(/|$|\\?|#)')""")
def trusted_urls(spark, sf):
    rows = table(spark, sf, "pages").selectExpr(
        "page_id",
        "CASE page_id % 6 WHEN 0 THEN replace(url, '.example.', '.example.evil.') "
        "WHEN 1 THEN concat(upper(left(url, 8)), substr(url, 9)) WHEN 2 THEN concat('not a url ', page_id) "
        "WHEN 3 THEN replace(url, '://', '://a@') ELSE url END AS url",
    )
    return rows.where(releases.trusted_url(F.col("url"), TRUSTED))


@query("throttle_rate", """
WITH c AS (SELECT date_trunc('hour', ts) AS hour, CASE WHEN value > 60 THEN 429 WHEN event_type = 'error' THEN 403 ELSE 200 END AS status,
  CASE WHEN user_id % 3 = 0 THEN '0' WHEN user_id % 3 = 1 THEN '5' END AS remaining FROM events)
SELECT hour, count(*) AS calls, count(*) FILTER (WHERE status = 429 OR (status = 403 AND remaining = '0')) AS throttled,
  round_even(count(*) FILTER (WHERE status = 429 OR (status = 403 AND remaining = '0')) / count(*), 6) AS share
FROM c GROUP BY hour""")
def throttle_rate(spark, sf):
    calls = table(spark, sf, "events").selectExpr(
        "ts", "CASE WHEN value > 60 THEN 429 WHEN event_type = 'error' THEN 403 ELSE 200 END AS status",
        "CASE WHEN user_id % 6 = 0 THEN map('X-RateLimit-Remaining', '0', 'x-ratelimit-remaining', '7') "
        "WHEN user_id % 3 = 0 THEN map('X-RateLimit-Remaining', '0') "
        "WHEN user_id % 3 = 1 THEN map('x-ratelimit-remaining', '5') ELSE map() END AS headers",
    )
    return releases.throttle_rate(calls, "ts")
