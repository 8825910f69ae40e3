"""Archive manifests: selection, safety, totals and unique names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.functions.paths import ARCHIVE_EXTENSIONS, folders, normal_key, safe_path, saved_percent, split_name
from docflow.functions.text import extension, size_label
from docflow.operators.ordered import first_rows, running


def scan_manifest(paths: DataFrame, path: str, seq: str, allowed: Sequence[str]) -> DataFrame:
    """Allowed files, each once ignoring case, the first spelling kept."""
    fit = paths.where(extension(F.col(path)).isin([e.lower() for e in allowed]))
    return first_rows(fit, [F.lower(path)], [seq])


def archives(paths: DataFrame, path: str) -> DataFrame:
    return paths.where(extension(F.col(path)).isin(*ARCHIVE_EXTENSIONS))


def entry_semi(entries: DataFrame, wanted: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Requested files; no request means all files. Directories are never extracted."""
    files = entries.where("NOT is_directory AND path <> ''")
    if wanted is None:
        return files
    asked = wanted.select(*keys, F.lower(normal_key(F.col("path"))).alias("__key")).distinct()
    keyed = files.withColumn("__key", F.lower(normal_key(F.col("path"))))
    return keyed.join(asked, [*keys, "__key"], "left_semi").drop("__key")


def path_safety(entries: DataFrame) -> DataFrame:
    safe = safe_path(F.col("path"))
    return entries.withColumn("safe_path", safe).withColumn(
        "verdict", F.when(F.col("safe_path").isNull(), "rejected").otherwise("ok")
    )


def archive_summary(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Files, bytes, encryption and a label per archive; directories count for nothing."""
    is_file = ~F.col("is_directory")
    packed = saved_percent(F.col("size"), F.col("compressed_size"))
    return entries.groupBy(*keys).agg(
        F.count_if(is_file).alias("files"),
        F.coalesce(F.sum(F.when(is_file, F.col("size"))), F.lit(0)).alias("bytes"),
        F.bool_or("is_encrypted").alias("encrypted"),
        F.max(F.when(is_file, packed)).alias("best_saved"),
    ).withColumn("label", size_label(F.col("bytes")))


def self_exclude(files: DataFrame, path: Column, target: Column) -> DataFrame:
    """An archive never takes itself in."""
    return files.where(F.lower(path) != F.lower(target))


def folder_totals(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Files and bytes under each folder at any depth; an unreadable size is 0 bytes."""
    rows = entries.where("NOT is_directory").select(
        *keys, F.explode(folders(F.col("path"))).alias("folder"), F.coalesce("size", F.lit(0)).alias("__size")
    )
    return rows.groupBy(*keys, "folder").agg(
        F.count(F.lit(1)).alias("files"), F.sum("__size").alias("bytes")
    )


def unique_names(
    names: DataFrame,
    keys: Sequence[str],
    name: str,
    seq: Sequence[str],
    block: Column,
    first: int = 2,
    opening: str = " (",
    closing: str = ")",
) -> DataFrame:
    """Give every row its own name: the first keeps it, later ones get `` (2)``, `` (3)``...

    Names meet only when they share the root left after all counters are taken off, so each
    root is worked alone. Where a root has one spelling a row number says it all, however
    many rows share it. Where names that already carry a counter mix in, the rows of a
    spelling take the counters that nothing else holds, in order of arrival.
    """
    stem, ext = split_name(F.col(name))
    esc = lambda s: "".join("\\" + c if not c.isalnum() and c != " " else c for c in s)
    counter = rf"(?:{esc(opening)}\d+{esc(closing)})+$"
    rooted = names.withColumn(
        "__root", F.lower(F.concat(F.regexp_replace(stem, counter, ""), F.lit("/"), ext))
    ).withColumn("__low", F.lower(name))
    spread = rooted.groupBy(*keys, "__root").agg((F.min("__low") < F.max("__low")).alias("__mixed"))
    marked = rooted.join(spread, [*keys, "__root"])

    plain = running(marked.where("NOT __mixed"), [*keys, "__root"], seq, block, number="__n")
    numbered = plain.withColumn(
        "unique_name",
        F.when(F.col("__n") == 1, F.col(name)).otherwise(
            F.concat(stem, F.lit(opening), (F.col("__n") - 2 + first).cast("string"), F.lit(closing), ext)
        ),
    ).drop("__n")
    mixed = _fold_names(marked.where("__mixed"), [*keys, "__root"], name, seq, first, opening, closing)
    return numbered.unionByName(mixed).drop("__root", "__low", "__mixed")


def _name_walker(columns, keys, name, first, opening, closing):
    """Batches of rows sorted by root and order in, the same rows with their names out.

    A counter below a spelling's next one is in use, so only spellings are remembered.
    """
    import re

    import pandas as pd

    counted = re.compile(rf"^(.*){re.escape(opening)}([1-9]\d*){re.escape(closing)}$", re.S)

    def parts(text):
        dot = text.rfind(".")
        cut = dot if max(text.rfind("/"), text.rfind("\\")) < dot < len(text) - 1 else len(text)
        return text[:cut], text[cut:]

    def walk(batches):
        root, seen, nexts = None, set(), {}

        def in_use(low):
            if low in seen:
                return True
            stem, ext = parts(low)
            made = counted.match(stem)
            return bool(made) and first <= int(made[2]) < nexts.get(made[1] + ext, first)

        for frame in batches:
            out = []
            for *key, text in frame[[*keys, name]].itertuples(index=False, name=None):
                if key != root:
                    root = key
                    seen.clear()
                    nexts.clear()
                low = text.lower()
                if not in_use(low):
                    seen.add(low)
                    out.append(text)
                    continue
                stem, ext = parts(text)
                n = nexts.get(low, first)
                while f"{stem}{opening}{n}{closing}{ext}".lower() in seen:
                    n += 1
                nexts[low] = n + 1
                out.append(f"{stem}{opening}{n}{closing}{ext}")
            yield frame.assign(unique_name=pd.Series(out, index=frame.index, dtype=object))[columns]

    return walk


def _fold_names(df, keys, name, seq, first, opening, closing):
    """Walk the rows of mixed roots in order. The rows stream through a sorted partition; a
    task holds the spellings of one root and never its rows."""
    schema = T.StructType([*df.schema.fields, T.StructField("unique_name", T.StringType())])
    walk = _name_walker(schema.names, keys, name, first, opening, closing)
    placed = df.repartition(*keys).sortWithinPartitions(*keys, *seq)
    return placed.mapInPandas(walk, schema)


# What a sheet name may not hold, how long it may be, its default.
SHEET_FORBIDDEN, SHEET_LIMIT, SHEET_DEFAULT = "[]:*?/\\", 31, "Sheet"


def sheet_name(name: Column) -> Column:
    """A name fit for a sheet: no forbidden characters, no quotes or blanks at its ends."""
    plain = F.regexp_replace(F.translate(name, SHEET_FORBIDDEN, " " * len(SHEET_FORBIDDEN)), "^[' ]+|[' ]+$", "")
    return F.left(F.when(plain == "", SHEET_DEFAULT).otherwise(plain), F.lit(SHEET_LIMIT))


def sheet_names(names: DataFrame, keys: Sequence[str], name: str, seq: Sequence[str]) -> DataFrame:
    """Sheet names that differ within each workbook, none longer than the limit.

    A counter may cut a name, so names that begin alike before any bracket are walked
    together, in order, in a sorted partition that holds only the names in use.
    """
    alike = SHEET_LIMIT - len("  (9999999)")
    rooted = names.withColumn("__clean", sheet_name(F.col(name))).withColumn(
        "__root", F.lower(F.left(F.regexp_replace("__clean", r"(?s) \(.*$", ""), F.lit(alike)))
    )
    schema = T.StructType([*rooted.schema.fields, T.StructField("unique_name", T.StringType())])
    group, columns = [*keys, "__root"], schema.names

    def walk(batches):
        root, used, nexts = None, set(), {}
        for frame in batches:
            out = []
            for *key, text in frame[[*group, "__clean"]].itertuples(index=False, name=None):
                if key != root:
                    root, used, nexts = key, set(), {}
                low, made = text.lower(), text
                n = nexts.get(low, 2)
                while made.lower() in used:
                    tail = f" ({n})"
                    made, n = text[: SHEET_LIMIT - len(tail)] + tail, n + 1
                nexts[low] = n
                used.add(made.lower())
                out.append(made)
            yield frame.assign(unique_name=out)[columns]

    placed = rooted.repartition(*group).sortWithinPartitions(*group, *seq)
    return placed.mapInPandas(walk, schema).drop("__clean", "__root")
