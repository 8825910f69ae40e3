"""Running values across blocks, unique names and slides, against plain loops."""

import random

from pyspark.sql import functions as F

from docflow.operators.manifest import sheet_names, unique_names
from docflow.operators.ordered import first_rows, running
from docflow.operators.slides import slide_chunks


def test_running_values_match_a_loop(spark):
    rng = random.Random(5)
    rows = [(k, s, rng.choice([None, 1, 2, 5])) for k in "ab" for s in sorted(rng.sample(range(1000), 60))] + [("c", 7, None)]
    frame = spark.createDataFrame(rows, "k string, s int, v int")
    out = running(
        frame, ["k"], ["s"], F.floor(F.col("s") / 64), number="n", total="t", sums={"sum": F.col("v")},
        maxes={"max": F.col("v")}, lasts={"last": F.col("v")}, lags={"lag": F.col("v")}, leads={"lead": F.col("v")},
    )
    got = {(r.k, r.s): (r.n, r.t, r["sum"], r["max"], r["last"], r["lag"], r["lead"]) for r in out.collect()}
    for key in "abc":
        mine = [(s, v) for k, s, v in rows if k == key]
        for i, (s, v) in enumerate(mine):
            seen = [x for _, x in mine[: i + 1] if x is not None]
            want = (i + 1, len(mine), sum(seen) if seen else None, max(seen, default=None), seen[-1] if seen else None,
                    mine[i - 1][1] if i else None, mine[i + 1][1] if i + 1 < len(mine) else None)
            assert got[key, s] == want


def test_first_rows(spark):
    frame = spark.createDataFrame([(1, "B.txt"), (0, "b.TXT"), (2, "c")], "s int, name string")
    assert {r.name for r in first_rows(frame, [F.lower("name")], ["s"]).collect()} == {"b.TXT", "c"}


def slow_names(names):
    used, out = set(), []
    for name in names:
        dot = name.rfind(".")
        cut = dot if 0 <= dot < len(name) - 1 else len(name)
        made, n = name, 2
        while made.lower() in used:
            made, n = f"{name[:cut]} ({n}){name[cut:]}", n + 1
        used.add(made.lower())
        out.append(made)
    return out


def test_unique_names_match_a_loop(spark):
    rng = random.Random(11)
    pool = ["a.txt", "A.txt", "a (2).txt", "a (3).txt", "a (2) (2).txt", "b", "B", "b (2)", "c.tar.gz", "a (02).txt", "x.txt", "X.TXT"]
    rows = [(z, i, rng.choice(pool if z else pool[:2] + pool[10:])) for z in range(4) for i in range(80)]
    frame = spark.createDataFrame(rows, "z int, i int, name string")
    out = unique_names(frame, ["z"], "name", ["i"], F.floor(F.col("i") / 16))
    got = {(r.z, r.i): r.unique_name for r in out.collect()}
    for z in range(4):
        want = slow_names([n for zz, _, n in rows if zz == z])
        assert [got[z, i] for i in range(80)] == want


def slow_chunks(costs):
    out, used, chunk = [], 0, 1
    for cost in costs:
        if used and used + cost > 12:
            used, chunk = 0, chunk + 1
        used += cost
        out.append(chunk)
    return out


def test_slides_across_blocks_match_a_loop(spark):
    rng = random.Random(2)
    rows = [(d, i, "x" * rng.choice([0, 10, 95, 96, 300, 900, 2000])) for d in range(3) for i in range(200 if d else 3)]
    frame = spark.createDataFrame(rows, "d int, i int, text string")
    got = {(r.d, r.i): r.chunk_no for r in slide_chunks(frame, ["d"], "i", "text", block=16).collect()}
    for d in range(3):
        want = slow_chunks([max(1, -(-len(t) // 95)) for dd, _, t in rows if dd == d])
        assert [got[d, i] for i in range(len(want))] == want


def test_sheet_names(spark):
    long = "x" * 40
    rows = ["Data", "data", "a/b", " 'q' ", "", long, long, "x" * 27 + " (2)", "Data (2)", "???", "Data"]
    frame = spark.createDataFrame([(1, i, n) for i, n in enumerate(rows)], "w int, i int, name string")
    got = [r.unique_name for r in sheet_names(frame, ["w"], "name", ["i"]).orderBy("i").collect()]
    assert got == ["Data", "data (2)", "a b", "q", "Sheet", "x" * 31, "x" * 27 + " (2)", "x" * 27 + " (3)", "Data (2) (2)",
                   "Sheet (2)", "Data (3)"]


def test_dashed_counters(spark):
    frame = spark.createDataFrame([(1, i, n) for i, n in enumerate(["a.pdf", "A.pdf", "a.pdf", "b.pdf"])], "w int, i int, name string")
    out = unique_names(frame, ["w"], "name", ["i"], F.floor(F.col("i") / 16), first=1, opening="-", closing="")
    assert [r.unique_name for r in out.orderBy("i").collect()] == ["a.pdf", "A-1.pdf", "a-2.pdf", "b.pdf"]
