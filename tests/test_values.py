"""Numbers, cells, text rules and labels."""

import random
from fractions import Fraction

from pyspark.sql import functions as F

from docflow.functions import numbers as N
from docflow.functions import text as X
from docflow.functions.paths import safe_path, saved_percent
from docflow.operators import numbers as ops
from docflow.operators.hierarchy import letters, roman


def column(spark, values, make, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in frame.select("i", make(F.col("v")).alias("out")).orderBy("i").collect()]


def digits_of(text, base):
    if base <= 32:
        return [N.DIGITS.index(c) for c in text]
    return [int(g) for g in text.split(":") if g]


def expected(text, base, to, limit):
    negative, body = text.startswith("-"), text.lstrip("+-")
    whole, _, part = body.partition(".")
    value = Fraction(0)
    for d in digits_of(whole, base):
        value = value * base + d
    for k, d in enumerate(digits_of(part, base), 1):
        value += Fraction(d, base**k)
    n, rest, out, tail = int(value), value - int(value), [], []
    while n:
        out.insert(0, n % to)
        n //= to
    while rest and len(tail) < limit:
        rest *= to
        tail.append(int(rest))
        rest -= int(rest)
    write = lambda ds: "".join(N.DIGITS[d] for d in ds) if to <= 32 else ":".join(map(str, ds))
    shown = write(out or [0]) + ("." + write(tail) if tail else "")
    return ("-" if negative and value else "") + shown, rest == 0


def test_bases_against_exact_fractions(spark):
    rng = random.Random(3)
    for base in N.BASES:
        symbols = [N.DIGITS[d] if base <= 32 else str(d) for d in range(base)]
        mark = "" if base <= 32 else ":"
        texts = ["0", "-0", "1", "-0.0"]
        for size in (1, 3, 9, 18, 25, 90):
            whole = mark.join(rng.choice(symbols) for _ in range(size))
            part = mark.join(rng.choice(symbols) for _ in range(size // 3))
            texts += [whole, f"-{whole}.{part}" if part else f"-{whole}", f"0.{part or '1'}"]
        frame = spark.createDataFrame([(t,) for t in set(texts)], "t string")
        for row in ops.base_fanout(frame, ["t"], "t", base, 20).collect():
            assert (row.value, row.is_exact) == expected(row.t, base, row.base, 20), row


def test_display_groups(spark):
    frame = spark.createDataFrame([("1234567.12345",), ("-255",)], "t string")
    shown = {(r.t, r.base): r.display for r in ops.base_fanout(frame, ["t"], "t", 10, 8).collect()}
    assert shown["1234567.12345", 10] == "1 234 567.123 45"
    assert shown["-255", 2] == "-1111 1111"
    assert shown["-255", 64] == "-3:63"


def test_number_faults(spark):
    cases = [("1.2.3", 10, "two_separators"), (".", 10, "no_digits"), ("z", 32, "bad_digit"), ("8", 8, "bad_digit"),
             ("1_0 0'1", 2, None), ("63:64", 64, "bad_digit"), ("1:2:", 64, None), ("00255", 256, None), ("1a", 128, "bad_digit"),
             ("  ", 10, None), (None, 10, None), ("1" * 513, 10, "too_long"), ("1x.2.3", 10, "bad_digit"), ("−5,5", 10, None)]
    frame = spark.createDataFrame([(i, t, b) for i, (t, b, _) in enumerate(cases)], "i int, t string, b int")
    fault = N.by_base(F.col("b"), lambda b: N.number_fault(F.col("t"), b))
    got = [r[0] for r in frame.orderBy("i").select(fault).collect()]
    assert got == [c[2] for c in cases]


def test_cells(spark):
    cases = {"1 250,5": 1250.5, "1,250": 1250.0, "1000,50": 1000.5, "1.234,56": 1234.56, "1,234.56": 1234.56, "007": None,
             "0.5": 0.5, "0,5": 0.5, "12-3": None, "5-": None, "-7": -7.0, "+ 7": 7.0, "1,2,3": 123.0, "": None, "12 kg": None,
             "1.2.3": None, ".": None, "5.": 5.0, "1" * 25: None, "\u00a01\u00a0000 ": 1000.0, "0": 0.0, "-0,25": -0.25}
    assert column(spark, list(cases), N.cell_number) == list(cases.values())


def test_text_rules(spark):
    assert column(spark, ["  a \t\n b\u00a0c\u0007 ", None, "x"], X.collapse) == ["a b c", "", "x"]
    assert column(spark, ["a" * 121, "a" * 119 + " bc", "ok"], X.shorten) == ["a" * 120 + "…", "a" * 119 + "…", "ok"]
    assert column(spark, ["a\tb\u0001 ", "x" * 32001], X.cell_text) == ["a b", "x" * 32000]
    kinds = ["• a", "- a", "-a", "1. a", "(12) a", "1234. a", "a) b", "ab) c", "б. в", " ◦x", "text"]
    assert column(spark, kinds, X.marker_kind) == [
        "bullet", "dash", None, "number", "number", None, "letter", None, "letter", "bullet", None]
    fonts = ["ABCDEF+TimesNewRomanPS-BoldMT", "ArialMT", "Open Sans", "CourierNewPSMT", " ", None, "Bold", "SegoeUISemiBold", "-x"]
    assert column(spark, fonts, X.font_family) == [
        "Times New", "Arial", "Open Sans", "Courier New", "Calibri", "Calibri", "Bold", "Segoe UI", "-x"]


def test_labels(spark):
    assert column(spark, [0, 1023, 1024, 1536, 1048576, 5 * 2**40, -1], X.size_label, "bigint") == [
        "0 B", "1023 B", "1.0 KB", "1.5 KB", "1.0 MB", "5120.0 GB", None]
    assert column(spark, [0, 25, 26, 701, 702, 16383], X.column_letters, "int") == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]
    assert column(spark, [1, 26, 27, 702, 703, 0], letters, "int") == ["a", "z", "aa", "zz", "aaa", "a"]
    assert column(spark, [1, 4, 1994, 3999, 4000, 0], roman, "int") == ["I", "IV", "MCMXCIV", "MMMCMXCIX", "4000", "0"]
    pairs = spark.createDataFrame([(1.0, 0.5, 0.0), (1.0, 0.95, 0.94), (0.0, 0.0, 0.08), (0.5, 0.5, 0.5)], "r double, g double, b double")
    assert [r[0] for r in pairs.select(X.color_hex(F.col("r"), F.col("g"), F.col("b"))).collect()] == ["#FF8000", None, None, "#808080"]


def test_paths_that_leave_the_folder_are_refused(spark):
    cases = {"a/b.txt": "a/b.txt", "../x": None, "a/../../x": None, "a/../b": "b", "/etc/x": "etc/x", "\\\\srv\\x": "srv/x",
             "C:\\win\\x": "win/x", "c:..\\x": None, "a/./b//c": "a/b/c", "a/..": None, "": None, "..": None,
             "..\\..\\w": None, "a/b/../../../c": None, "a/../c/..": None}
    assert column(spark, list(cases), safe_path) == list(cases.values())


def test_saved_percent(spark):
    pairs = spark.createDataFrame([(100, 40), (3, 1), (0, 0), (10, 20), (None, 5)], "a bigint, b bigint")
    assert [r[0] for r in pairs.select(saved_percent(F.col("a"), F.col("b"))).collect()] == [60, 67, None, None, None]
