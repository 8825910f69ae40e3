"""Release feeds: parsing, acceptance, newest version, trusted links, throttling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions.text import trim_space

# Hosts a download may come from.
DOWNLOAD_HOSTS = ("github.com", "objects.githubusercontent.com")
RELEASE_SCHEMA = (
    "tag_name string, draft string, prerelease string, name string, body string, published_at string, "
    "assets array<struct<name: string, size: string, browser_download_url: string>>"
)


def trusted_url(url: Column, hosts: Sequence[str] = DOWNLOAD_HOSTS) -> Column:
    """An absolute https link whose host is exactly one of the allowed ones."""
    link = trim_space(url)
    return F.coalesce(
        (F.lower(F.try_parse_url(link, F.lit("PROTOCOL"))) == "https")
        & F.lower(F.try_parse_url(link, F.lit("HOST"))).isin([h.lower() for h in hosts]),
        F.lit(False),
    )


def tag_version(tag: Column) -> Column:
    """Version numbers of a tag, three parts, or null. An optional ``v`` leads, and two to
    four parts are read."""
    bare = F.regexp_replace(trim_space(tag), "^[vV]", "")
    parts = F.transform(F.split(bare, r"\."), lambda p: F.when(p.rlike(r"^\s*\+?\d{1,10}\s*$"), trim_space(p)).try_cast("int"))
    valid = F.size(parts).between(2, 4) & F.forall(parts, lambda p: p.isNotNull())
    return F.when(valid, F.array(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.coalesce(F.get(parts, F.lit(2)), F.lit(0))))


def parse_releases(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Release fields from JSON text; text that is no JSON object gives nulls."""
    is_object = F.col(column).rlike(r"^\s*\{")
    parsed = F.when(is_object, F.from_json(F.col(column), RELEASE_SCHEMA))
    # As a generator the text is parsed once; filters on its fields would each parse it again.
    rows = raw.select("*", F.explode_outer(F.array(parsed)).alias("release"))
    return rows.withColumn("version", tag_version(F.col("release.tag_name")))


def accept_releases(
    parsed: DataFrame, current: Column, asset_prefix: str, hosts: Sequence[str] = DOWNLOAD_HOSTS
) -> DataFrame:
    """Releases worth offering, each with its first fitting asset."""
    pattern = rf"(?i)^{asset_prefix}\d+(\.\d+){{1,3}}\.exe$"
    fits = F.filter(
        F.col("release.assets"),
        lambda a: a["name"].rlike(pattern)
        & trusted_url(a["browser_download_url"], hosts)
        & (F.coalesce(a["size"].try_cast("bigint"), F.lit(0)) > 0),
    )
    shipped = (F.col("release.draft") != "true") & (F.col("release.prerelease") != "true")
    return (
        parsed.where(F.coalesce(shipped, F.lit(True)) & F.col("release").isNotNull() & (F.col("version") > current))
        .withColumn("asset", F.get(fits, F.lit(0)))
        .where("asset IS NOT NULL")
    )


def latest_release(accepted: DataFrame, keys: Sequence[str], tie: str) -> DataFrame:
    """The newest release per key, by version and not by text."""
    return (
        accepted.groupBy(*keys)
        .agg(F.max_by(F.struct("*"), F.struct("version", F.col(tie))).alias("__best"))
        .select(*keys, *(f"__best.{c}" for c in accepted.columns if c not in keys))
    )


def is_throttled(status: Column, headers: Column) -> Column:
    """Status 429, or 403 with no calls remaining under any spelling of the header."""
    none = F.exists(F.map_entries(headers), lambda h: (F.lower(h["key"]) == "x-ratelimit-remaining") & (h["value"] == "0"))
    return (status == 429) | ((status == 403) & F.coalesce(none, F.lit(False)))


def throttle_rate(calls: DataFrame, ts: str, keys: Sequence[str] = ()) -> DataFrame:
    """Share of throttled calls per hour."""
    hit = is_throttled(F.col("status"), F.col("headers")).cast("int")
    return calls.groupBy(F.date_trunc("hour", ts).alias("hour"), *keys).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(hit).alias("throttled"),
        F.bround(F.sum(hit) / F.count(F.lit(1)), 6).alias("share"),
    )
