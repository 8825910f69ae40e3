"""Files as tables: manifests, text files, archives; and writing results."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.operators.ordered import first_rows

ENTRY_SCHEMA = (
    "archive_id string, entry_no long, path string, size long, compressed_size long, modified timestamp, "
    "is_directory boolean, is_encrypted boolean, error string"
)


def _plain(path):
    """A path without its scheme, which sources spell in more than one way."""
    return F.regexp_replace(path, "^[A-Za-z0-9+.-]+:/*", "/")


def list_files(spark: SparkSession, entries: str | Sequence[str], extensions: Sequence[str] = ()) -> DataFrame:
    """``path, name, modified, length`` of dropped files and of the files directly in dropped
    folders, without reading them.

    Only the given extensions are listed, whatever their case. Of paths that differ in case
    only the first stays: that of the first entry, and of one entry the smallest path."""
    entries = [entries] if isinstance(entries, str) else list(entries)
    meta = F.col("_metadata")
    found = spark.read.format("binaryFile").load(entries).select(
        meta["file_path"].alias("path"), meta["file_name"].alias("name"), meta["file_modification_time"].alias("modified"), meta["file_size"].alias("length")
    )
    if extensions:
        found = found.where(F.lower(F.regexp_extract("name", r"\.[^.]+$", 0)).isin([e.lower() for e in extensions]))
    order = spark.createDataFrame(list(enumerate(entries)), "entry int, at string").select("entry", F.regexp_replace(_plain(F.col("at")), "/+$", "").alias("at"))
    # A file belongs to the entry that names it, or to the one that names a folder above it.
    plain = _plain(F.col("path"))
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split(plain, "/"))), lambda n: F.call_function("substring_index", plain, F.lit("/"), n)))
    owned = found.withColumn("at", above).join(order, "at").groupBy("path", "name", "modified", "length").agg(F.min("entry").alias("entry"))
    return first_rows(owned, [F.lower("path")], ["entry", "path"]).select("path", "name", "modified", "length")


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files with their content. The reader leaves empty files out."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)


def decode_text(files: DataFrame, content: str = "content") -> DataFrame:
    """Text of files. A byte order mark decides; without one only valid UTF-8 is accepted,
    and anything else is kept as a reject with its reason."""
    data = F.col(content)
    head = lambda n: F.hex(F.substring(data, 1, n))
    rest = lambda n: F.substring(data, F.lit(n + 1), F.length(data))
    # Bad sequences of UTF-8 behind a mark become replacement characters; UTF-16 that does not
    # pair up has no text.
    plain, high, low = "(?:[0-9A-CEF][0-9A-F]|D[0-7])", "D[89AB]", "D[C-F]"
    paired = lambda data, unit, pair: F.hex(data).rlike(f"^(?:{unit}|{pair})*+$")
    little = paired(rest(2), f"[0-9A-F]{{2}}{plain}", f"[0-9A-F]{{2}}{high}[0-9A-F]{{2}}{low}")
    big = paired(rest(2), f"{plain}[0-9A-F]{{2}}", f"{high}[0-9A-F]{{2}}{low}[0-9A-F]{{2}}")
    text = (
        F.when(head(3) == "EFBBBF", F.make_valid_utf8(rest(3).cast("string")))
        .when(head(2) == "FFFE", F.when(little, F.decode(rest(2), "UTF-16LE")))
        .when(head(2) == "FEFF", F.when(big, F.decode(rest(2), "UTF-16BE")))
        .otherwise(F.try_validate_utf8(data.cast("string")))
    )
    error = F.when(F.col("text").isNull(), F.when(head(2).isin("FFFE", "FEFF"), "not_utf16").otherwise("not_utf8"))
    return files.withColumn("text", text).withColumn("error", error)


def _entries(name: str, data: bytes):
    """Entries of one archive, as the format's own directory lists them."""
    import bz2
    import datetime
    import gzip
    import io
    import tarfile
    import zipfile

    stream = io.BytesIO(data)
    if zipfile.is_zipfile(stream):
        for info in zipfile.ZipFile(stream).infolist():
            try:
                when = datetime.datetime(*info.date_time)
            except ValueError:  # an entry may have no time
                when = None
            yield info.filename, info.file_size, info.compress_size, when, info.is_dir(), bool(info.flag_bits & 1)
        return
    stream.seek(0)
    try:
        with tarfile.open(fileobj=stream) as tar:
            for member in tar:
                when = datetime.datetime.fromtimestamp(member.mtime, datetime.timezone.utc).replace(tzinfo=None)
                yield member.name, member.size, member.size, when, member.isdir(), False
        return
    except tarfile.ReadError:
        pass
    stem = name.replace("\\", "/").rsplit("/", 1)[-1]
    for magic, opener, suffix in ((b"\x1f\x8b", gzip.open, ".gz"), (b"BZh", bz2.open, ".bz2")):
        if data.startswith(magic):
            size = 0
            with opener(io.BytesIO(data)) as unpacked:
                while piece := unpacked.read(1 << 20):
                    size += len(piece)
            yield stem[: -len(suffix)] if stem.lower().endswith(suffix) else stem, size, len(data), None, False, False
            return
    raise ValueError("no archive")


def list_archives(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """One row per entry of every archive. An archive that cannot be read is one row with its
    error, so it stops nothing."""
    def read(batches):
        import pandas as pd

        columns = [c.split(" ")[0] for c in ENTRY_SCHEMA.split(", ")]

        def table(rows):
            out = pd.DataFrame(rows, columns=columns)
            for column in ("entry_no", "size", "compressed_size"):
                out[column] = out[column].astype("Int64")
            for column in ("is_directory", "is_encrypted"):
                out[column] = out[column].astype("boolean")
            out["modified"] = pd.to_datetime(out["modified"])
            return out

        # A frame costs as much as many rows, so archives share one.
        for frame in batches:
            rows = []
            for archive, data in zip(frame[name].tolist(), frame[content].tolist()):
                try:
                    for number, (path, *rest) in enumerate(_entries(archive, data)):
                        if path:
                            rows.append((archive, number, path.replace("\\", "/"), *rest, None))
                except Exception as error:  # any broken archive is a row, never a failed job
                    rows.append((archive, None, None, None, None, None, None, None, type(error).__name__))
                if len(rows) >= 10_000:
                    yield table(rows)
                    rows = []
            if rows:
                yield table(rows)

    return files.select(name, content).mapInPandas(read, ENTRY_SCHEMA)


def write_table(df: DataFrame, path: str) -> None:
    """A new table that appears whole or not at all, and never replaces one."""
    df.write.mode("errorifexists").parquet(path)


def write_parts(df: DataFrame, path: str, by: Sequence[str], rows_per_file: int = 1_000_000) -> None:
    """One folder per value of ``by``, written whole or not at all, and never over another table.

    Rows are rebalanced by part at run time: a part of more than the advisory size is dealt out to several
    tasks, so a part with most of the rows is not one task's work, and small parts share one.
    No file has more than ``rows_per_file`` rows. The table is written beside its place and
    moved there at the end, so nobody reads half of it."""
    hadoop = df.sparkSession._jvm.org.apache.hadoop.fs
    target, staged = hadoop.Path(path), hadoop.Path(f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}")
    store = target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    if store.exists(target):
        raise FileExistsError(path)
    df.hint("rebalance", *(F.col(c) for c in by)).write.partitionBy(*by).option("maxRecordsPerFile", rows_per_file).parquet(str(staged))
    if store.exists(target) or not store.rename(staged, target):
        store.delete(staged, True)
        raise FileExistsError(path)


def write_split(df: DataFrame, path: str, error: str = "error") -> None:
    """Accepted and rejected rows as two tables of one folder, out of one pass: rows with an
    error lie in ``rejected=true``, the others in ``rejected=false``."""
    df.withColumn("rejected", F.col(error).isNotNull()).write.mode("errorifexists").partitionBy("rejected").parquet(path)


def write_files(df: DataFrame, path: str, name: str, content: str, files_per_folder: int = 1000) -> None:
    """Bytes as files of given names: ``content`` of the rows that share a name, one behind the
    other, is one file in one of the folders ``part=0``, ``part=1`` and so on of ``path``.

    A folder holds about ``files_per_folder`` files and is written by one task, so there is no
    folder a file to make, move and list. Names that differ in case only share a folder. A file
    is moved to its name once it is whole, so a repeated task leaves the same files. Tasks write
    through ``pyarrow.fs``, which must know the scheme of ``path``. Names hold no slash, null
    content is empty, and rows of one name come in no set order."""
    parts = max(1, -(-df.count() // files_per_folder))
    rows = df.select(F.pmod(F.xxhash64(F.lower(name)), F.lit(parts)).alias("part"), F.col(name).alias("name"), F.col(content).alias("content"))
    cores = df.sparkSession.sparkContext.defaultParallelism

    def write(batches):
        from itertools import groupby
        from uuid import uuid4

        import pyarrow as pa
        from pyarrow.fs import FileSystem

        store, root = FileSystem.from_uri(path)
        flat = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        written, folder = 0, None
        for (part, title), pieces in groupby(flat, lambda row: row[:2]):
            if folder != part:
                store.create_dir(f"{root}/part={part}", recursive=True)
                folder = part
            # Names that start with an underscore are passed over by Spark's readers.
            staged = f"{root}/part={part}/_{uuid4().hex}"
            with store.open_output_stream(staged) as out:
                for _, _, data in pieces:
                    out.write(data or b"")
            store.move(staged, f"{root}/part={part}/{title}")
            written += 1
        yield pa.RecordBatch.from_pydict({"written": pa.array([written], pa.int64())})

    dealt = rows.repartition(max(cores, parts), "part").sortWithinPartitions("part", "name")
    dealt.mapInArrow(write, "written long").write.format("noop").mode("overwrite").save()


def write_by(df: DataFrame, path: str, column: str) -> None:
    """One folder per page or part."""
    write_parts(df, path, [column])
