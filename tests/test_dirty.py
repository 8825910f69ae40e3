"""Input that is dirty in an ordinary way stops no job and loses no rows."""

import io
import time
import zipfile

from pyspark.sql import functions as F

from docflow.functions import script as S
from docflow.functions import wire
from docflow.operators import hierarchy, numbers, releases, sessions
from docflow.operators import script as script_ops
from docflow.operators.ordered import running
from docflow.sources import files as files_io
from tests.test_live import beacon, column, frame

MARKS = "﷐﷑﷒﷓"


def test_entries_without_a_time(spark):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as pack:
        for name in "abc":
            pack.writestr(zipfile.ZipInfo(name), name)
    raw = bytearray(data.getvalue())
    at = raw.rindex(b"PK\x01\x02", 0, raw.rindex(b"PK\x01\x02"))  # the second entry of the directory
    raw[at + 12 : at + 16] = b"\0\0\0\0"
    rows = spark.createDataFrame([("z.zip", bytes(raw))], "path string, content binary")
    got = {r.path: (r.modified is None, r.error) for r in files_io.list_archives(rows).collect()}
    assert got == {"a": (False, None), "b": (True, None), "c": (False, None)}


def test_names_that_are_no_utf8(spark):
    got = column(spark, [beacon(name=b"p\xffc"), beacon(name=b"ok")], wire.parse_beacon)
    assert [g.name for g in got] == ["p�c", "ok"]


def test_texts_that_are_broken(spark):
    coded = [b"\xef\xbb\xbfa\xffb", b"\xff\xfea", b"\xff\xfe\x00\xd8a\x00", b"\xff\xfe\x3d\xd8\x00\xde", b"\xfe\xff\xd8\x3d\xde\x00", b"\xff\xfe"]
    rows = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(coded)], "i int, content binary")
    got = [(r.text, r.error) for r in files_io.decode_text(rows).orderBy("i").collect()]
    assert got == [("a�b", None), (None, "not_utf16"), (None, "not_utf16"), ("😀", None), ("😀", None), ("", None)]


def test_files_of_one_name(spark, tmp_path):
    for name in ("a.TXT", "A.txt", "b.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r.path.rsplit("/", 1)[1] for r in files_io.list_files(spark, str(tmp_path), [".txt"]).collect()) == ["A.txt", "b.txt"]


def test_headers_in_two_spellings(spark):
    rows = spark.sql("SELECT 403 AS status, map('X-RateLimit-Remaining', '0', 'x-ratelimit-remaining', '3') AS headers UNION ALL SELECT 403, map('x', '0') UNION ALL SELECT 403, NULL")
    assert [r[0] for r in rows.select(releases.is_throttled(F.col("status"), F.col("headers"))).collect()] == [True, False, False]


def test_styles_of_one_id(spark):
    rows = spark.createDataFrame(
        [(1, 0, "a", None, "old"), (1, 1, "A", None, "new"), (1, 2, "b", "a", None), (1, 3, "c", "B", None)],
        "doc int, seq int, style_id string, based_on string, font string",
    )
    got = {(r.style_id): r.font for r in hierarchy.style_chain(rows, ["doc"], ["font"], order="seq").collect()}
    assert got == {"A": "new", "b": "new", "c": "new"}


def test_numbers_of_38_digits(spark):
    digits = spark.range(38).selectExpr("1 AS k", "CAST(id AS INT) AS position", "CAST(id % 9 + 1 AS INT) AS digit", "10 AS base")
    row = numbers.positional_value(digits, ["k"]).first()
    assert int(row.integer) == sum((i % 9 + 1) * 10**i for i in range(38))


def test_marks_of_the_source_stay(spark):
    texts = [f"shahar{MARKS}choy", f"{MARKS}", f"e﷒l www.a﷓b.uz ya", "шаҳар﷐е﷑Ш﷓ер"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    cyr = [r[0] for r in rows.orderBy("i").select(S.latin_to_cyrillic(F.col("text"))).collect()]
    assert cyr[:2] == [f"шаҳар{MARKS}чой", MARKS] and cyr[2].startswith("э﷒л ")
    lat = [r[0] for r in rows.orderBy("i").select(S.cyrillic_to_latin(F.col("text"))).collect()]
    assert lat[3] == "shahar﷐ye﷑Sh﷓yer" and lat[1] == MARKS
    runs = spark.createDataFrame([
        (1, "lat_to_cyr", 0, "sha﷒h"), (1, "lat_to_cyr", 1, "ar﷓﷒ yo"), (2, "cyr_to_lat", 0, "Ш﷐е"), (2, "cyr_to_lat", 1, "﷓﷑р www.﷓"),
    ], "p int, direction string, seq int, text string")
    got = {(r.p, r.seq): r.text for r in script_ops.convert_runs(runs, ["p"], "seq", "direction").collect()}
    assert got == {(1, 0): "ша﷒ҳ", (1, 1): "ар﷓﷒ ё", (2, 0): "Sh﷐ye", (2, 1): "﷓﷑r www.﷓"}


def test_long_frames_take_time_in_step(spark):
    body = bytes(16 * 2**20)
    data, buffer, found = frame(11, body) + frame(3, b"hi"), sessions.FrameBuffer(), []
    start = time.perf_counter()
    for at in range(0, len(data), 1400):
        found += buffer.feed(data[at : at + 1400])
    assert [(k, len(p)) for k, p, _ in found] == [(11, len(body)), (3, 2)] and not buffer.rest
    assert time.perf_counter() - start < 5


def test_blocks_and_plain_windows_agree(spark):
    """A key with most of the rows, in one piece and in blocks."""
    rows = spark.range(6000).selectExpr("CASE WHEN id % 3 < 2 THEN 0 ELSE id % 50 END AS k", "id AS s", "CAST(CASE WHEN id % 7 > 0 THEN id % 11 END AS INT) AS v")
    values = dict(number="n", total="t", sums={"sum": F.col("v")}, maxes={"max": F.col("v")}, lasts={"last": F.col("v")}, lags={"lag": F.col("v")}, leads={"lead": F.col("v")})
    plain, cut = running(rows, ["k"], ["s"], **values), running(rows, ["k"], ["s"], F.floor(F.col("s") / 512), **values)
    assert plain.schema.simpleString() == cut.schema.simpleString()
    assert sorted(map(str, plain.collect())) == sorted(map(str, cut.collect()))
