"""Tables on disk: parts, splits, folders of files."""

import pytest
from pyspark.sql import functions as F

from docflow.sources import files as S


def test_parts_are_whole_and_never_replaced(spark, tmp_path):
    rows = spark.range(10_000).select("id", F.when(F.col("id") < 9_000, 1).when(F.col("id") < 9_999, 2).alias("part"))
    target = str(tmp_path / "parts")
    S.write_parts(rows, target, ["part"], rows_per_file=1_000)
    got = spark.read.parquet(target)
    assert sorted(got.groupBy("part").count().collect(), key=str) == sorted(rows.groupBy("part").count().collect(), key=str)
    assert len(list((tmp_path / "parts" / "part=1").glob("*.parquet"))) >= 9
    with pytest.raises(FileExistsError):
        S.write_parts(rows.limit(1), target, ["part"])
    assert spark.read.parquet(target).count() == 10_000
    assert [p.name for p in tmp_path.iterdir()] == ["parts"]


def test_split_in_one_pass(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (2, None, "bad")], "id int, text string, error string")
    S.write_split(rows, str(tmp_path / "s"))
    assert [r.id for r in spark.read.parquet(str(tmp_path / "s" / "rejected=true")).collect()] == [2]
    assert [r.id for r in spark.read.parquet(str(tmp_path / "s" / "rejected=false")).collect()] == [1]


def test_dropped_files_in_order(spark, tmp_path):
    for name in ("b/x.txt", "b/Y.TXT", "b/y.txt", "b/n.pdf", "b/deep/z.txt", "a/x.txt", "one.txt", "b/none"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True, parents=True)
        path.write_bytes(b"abc")
    drop = [str(tmp_path / "b"), str(tmp_path / "one.txt"), str(tmp_path / "a")]
    got = sorted(r.path.split(str(tmp_path))[1] for r in S.list_files(spark, drop, [".txt"]).collect())
    assert got == ["/a/x.txt", "/b/Y.TXT", "/b/x.txt", "/one.txt"]
    # A file that is dropped by itself and in its folder is one file.
    twice = S.list_files(spark, [str(tmp_path / "b" / "x.txt"), str(tmp_path / "b")], [".txt"])
    assert sorted(r.name for r in twice.collect()) == ["Y.TXT", "x.txt"]
