"""Where intermediate data lies: spread over tasks, or settled in shared storage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out when a source comes in fewer pieces than there are cores, which happens
    with small files. A source in many pieces is left as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Deal rows out by key, about ``rows`` to a piece, for steps that widen them: rows that are
    narrow when they are shuffled would be joined into a few pieces at run time, and those are
    too large once every row has become many. What groups by these keys needs no other shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // rows)), *keys)


def shared_folder(spark: SparkSession) -> str | None:
    """The folder ``spark.checkpoint.dir`` names. A session in one process gets its own where
    none is set; a cluster without one has none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        root = tempfile.mkdtemp(prefix="docflow-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/") if root else None


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    root = shared_folder(spark)
    if root is None:
        raise ValueError("set spark.checkpoint.dir to a folder that every executor reaches")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write a table that several steps read, and go on from the written copy, which a lost
    executor cannot take away. A cluster that names no shared folder is an error, not a
    slower run."""
    spark = df.sparkSession
    path = scratch(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
