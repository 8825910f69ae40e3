"""Archive paths and names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions read as archives.
ARCHIVE_EXTENSIONS = (".zip", ".rar", ".7z", ".tar", ".gz", ".bz2", ".cbz", ".cbr")


def normal_key(path: Column) -> Column:
    """Forward slashes, none in front; compare it ignoring case."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+", "")


def safe_path(path: Column) -> Column:
    """Where an entry lands below the target folder, or null when it would leave it.

    Slashes in front and a drive are dropped; ``.`` and ``..`` are worked off like a stack.
    A path that resolves to the folder itself is refused too.
    """
    relative = F.regexp_replace(normal_key(path), "^.:/*", "")
    parts = F.split(relative, "/+")
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("left"))

    def step(acc: Column, part: Column) -> Column:
        up, none = part == "..", F.size(acc["kept"]) == 0
        kept = (
            F.when(part.isin("", "."), acc["kept"])
            .when(up & none, acc["kept"])
            .when(up, F.slice(acc["kept"], 1, F.greatest(F.size(acc["kept"]) - 1, F.lit(0))))
            .otherwise(F.concat(acc["kept"], F.array(part)))
        )
        return F.struct(kept.alias("kept"), (acc["left"] | (up & none)).alias("left"))

    done = F.aggregate(parts, start, step)
    return F.when(~done["left"] & (F.size(done["kept"]) > 0), F.array_join(done["kept"], "/"))


def folders(path: Column) -> Column:
    """Every folder above an entry, at any depth."""
    parts = F.filter(F.split(normal_key(path), "/"), lambda p: p != "")
    depth = F.size(parts) - 1
    return F.when(
        depth > 0,
        F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/")),
    ).otherwise(F.array().cast("array<string>"))


def saved_percent(size: Column, packed: Column) -> Column:
    """Whole percent saved, null when a size is unknown or the entry grew."""
    known = (size > 0) & (packed > 0) & (packed <= size)
    return F.when(known, F.lit(100) - F.floor(packed * 100 / size)).cast("int")


def split_name(name: Column) -> tuple[Column, Column]:
    """Stem and extension of a name."""
    ext = F.regexp_extract(name, r"\.[^./\\]*$", 0)
    ext = F.when(ext == ".", "").otherwise(ext)
    return F.substring(name, F.lit(1), F.length(name) - F.length(ext)), ext
