"""Ranges, requests, releases, archives and text files."""

import bz2
import gzip
import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from docflow.operators import pages as P
from docflow.operators import releases as R
from docflow.operators import requests as Q
from docflow.sources import files as S


def test_range_texts(spark):
    cases = ["1-3, 5; 8–10", "1;3", "2\n4", " 1 - 2 ,", "", "abc", "0-2", "5-2", "1-2-3", "-3", "1-99", "4-", "+2", None, ",;"]
    frame = spark.createDataFrame([(i, c, 10) for i, c in enumerate(cases)], "i int, expr string, n int")
    rows = P.parse_ranges(frame, ["i"], "expr", "n").orderBy("i", "pos").collect()
    got = {}
    for r in rows:
        got.setdefault(r.i, []).append(r.reason or (r.first, r.last))
    assert got == {
        0: [(1, 3), (5, 5), (8, 10)], 1: [(1, 1), (3, 3)], 2: [(2, 2), (4, 4)], 3: [(1, 2)], 4: ["empty"], 5: ["bad_number"],
        6: ["bad_number"], 7: ["reversed"], 8: ["bad_range"], 9: ["bad_number"], 10: ["past_end"], 11: ["bad_last_number"],
        12: [(2, 2)], 13: ["empty"], 14: ["empty"]}


def test_overlapping_ranges_repeat_pages(spark):
    ranges = spark.createDataFrame([(1, 1, 1, 3), (1, 2, 2, 2), (1, 3, 2, 9)], "source_id int, part_no int, first int, last int")
    sources = spark.createDataFrame([(1, 3)], "source_id int, page_count int")
    assert sorted((r.part_no, r.page_no) for r in P.range_pages(ranges, sources).collect()) == [(1, 1), (1, 2), (1, 3), (2, 2)]


def test_chunk_size_is_checked(spark):
    with pytest.raises(ValueError):
        P.fixed_chunks(spark.createDataFrame([(1, 3)], "source_id int, page_count int"), 0)


def test_page_number_template(spark):
    sources = spark.createDataFrame([(1, 4), (2, 1)], "doc int, page_count int")
    pages = spark.createDataFrame([(1, p) for p in range(1, 5)] + [(2, 1)], "doc int, page_no int")
    rows = P.page_numbers(pages, sources, ["doc"], 5, 2, "{0}/{1}").orderBy("doc", "page_no").collect()
    assert [r.label for r in rows] == [None, None, "5/2", "6/2", None]


def test_languages(spark):
    frame = spark.createDataFrame([(0, "uzb+ENG+ eng"), (1, " + "), (2, None), (3, "rus")], "i int, e string")
    got = [r[0] for r in frame.orderBy("i").select(Q.language_codes(F.col("e"))).collect()]
    assert got == [["uzb", "ENG"], ["uzb", "eng", "rus"], ["uzb", "eng", "rus"], ["rus"]]


def test_tag_versions(spark):
    tags = ["v2.2.0", "2.2", " V1.2.3.4 ", "1", "latest", "1.2.3.4.5", "v", "1..2", "-1.2", None]
    frame = spark.createDataFrame(list(enumerate(tags)), "i int, t string")
    got = [r[0] for r in frame.orderBy("i").select(R.tag_version(F.col("t"))).collect()]
    assert got == [[2, 2, 0], [2, 2, 0], [1, 2, 3], None, None, None, None, None, None, None]


def test_trusted_links(spark):
    links = {"https://github.com/a/b": True, "HTTPS://GitHub.com/a": True, "http://github.com/a": False, "file:///c:/x": False,
             "https://github.com.evil.example/a": False, "https://evilgithub.com/a": False, "junk": False, "": False, None: False,
             "https://objects.githubusercontent.com/x?y=1": True, "/relative": False}
    frame = spark.createDataFrame(list(enumerate(links)), "i int, u string")
    assert [r[0] for r in frame.orderBy("i").select(R.trusted_url(F.col("u"))).collect()] == list(links.values())


def test_junk_releases_are_no_releases(spark):
    raws = ["", "{", "<html/>", "[1]", "null", "{}", '{"tag_name": 5}', '{"tag_name":"v9.0","draft":true,"assets":[]}',
            '{"tag_name":"v9.0","assets":[{"name":"Setup-9.0.exe","size":5,"browser_download_url":"https://github.com/x"}]}']
    frame = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    good = R.accept_releases(R.parse_releases(frame), F.array(F.lit(2), F.lit(0), F.lit(0)), "Setup-")
    assert [r.i for r in good.collect()] == [8]


def archive(kind):
    data = io.BytesIO()
    if kind == "zip":
        with zipfile.ZipFile(data, "w") as z:
            z.writestr("a/b.txt", "hello")
            z.writestr("a/", "")
    elif kind == "tar":
        with tarfile.open(fileobj=data, mode="w:gz") as z:
            info = tarfile.TarInfo("dir/c.txt")
            info.size = 3
            z.addfile(info, io.BytesIO(b"abc"))
    elif kind == "gz":
        return gzip.compress(b"x" * 10)
    elif kind == "bz2":
        return bz2.compress(b"y" * 7)
    else:
        return b"nothing"
    return data.getvalue()


def test_archives_of_every_kind(spark, tmp_path):
    for kind in ("zip", "tar", "gz", "bz2", "bad"):
        (tmp_path / f"f.{kind}").write_bytes(archive(kind))
    files = S.read_files(spark, str(tmp_path)).withColumn("path", F.regexp_extract("path", "[^/]+$", 0))
    got = {(r.archive_id, r.path): (r.size, r.is_directory, r.error) for r in S.list_archives(files).collect()}
    assert got == {
        ("f.zip", "a/b.txt"): (5, False, None), ("f.zip", "a/"): (0, True, None), ("f.tar", "dir/c.txt"): (3, False, None),
        ("f.gz", "f"): (10, False, None), ("f.bz2", "f"): (7, False, None), ("f.bad", None): (None, None, "ValueError")}


def test_text_files(spark, tmp_path):
    text = "O'zbek ўзбек"
    coded = {"a": text.encode(), "b": b"\xef\xbb\xbf" + text.encode(), "c": b"\xff\xfe" + text.encode("utf-16-le"),
             "d": b"\xfe\xff" + text.encode("utf-16-be"), "e": text.encode("cp1251")}
    for name, data in coded.items():
        (tmp_path / name).write_bytes(data)
    files = S.decode_text(S.read_files(spark, str(tmp_path)).withColumn("name", F.regexp_extract("path", "[^/]+$", 0)))
    got = {r.name: (r.text, r.error) for r in files.collect()}
    assert got == {**{n: (text, None) for n in "abcd"}, "e": (None, "not_utf8")}


def test_results_are_never_overwritten(spark, tmp_path):
    frame = spark.range(3)
    S.write_table(frame, str(tmp_path / "t"))
    with pytest.raises(Exception):
        S.write_table(frame, str(tmp_path / "t"))
    S.write_by(frame.withColumn("page_no", F.col("id") % 2), str(tmp_path / "p"), "page_no")
    assert {p.name for p in (tmp_path / "p").iterdir() if p.is_dir()} == {"page_no=0", "page_no=1"}
