"""Plans that must not grow: what is worked out once, sorted once, shuffled narrow."""

import random

from pyspark.sql import functions as F

from docflow.functions.text import font_family
from docflow.operators import layout


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_font_family_is_worked_out_once(spark):
    """the chain of tails was written out anew for each of its uses, ninety patterns a word."""
    names = spark.createDataFrame([("ArialMT",), ("ABCDEF+Open Sans-BoldMT",), ("BrandXBoldPSMT",)], "n string").select(font_family(F.col("n")).alias("family"))
    assert _plan(names).count("regexp_replace") < 12
    assert [r["family"] for r in names.collect()] == ["Arial", "Open Sans", "Brand X"]


def test_words_are_placed_without_growing_arrays(spark):
    """Every word copied the words before it."""
    rng, docs = random.Random(9), []
    for k in range(60):
        lines = [" ".join(rng.choice(["", "a", "bé", "слово", "𝒳y", "longer"]) for _ in range(rng.choice([0, 1, 5, 31, 32, 33, 64, 200]))) for _ in range(rng.randrange(1, 5))]
        docs.append((k, "\n".join(lines)))
    docs.append((99, " ".join(f"w{i}" for i in range(5000))))
    words = layout.words_from_text(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    want = []
    for k, text in docs:
        for n, line in enumerate(text.split("\n")):
            at = number = 0
            for token in line.split(" "):
                if token:
                    want.append((k, n, number, token, 50 + 6.0 * at))
                    number += 1
                at += len(token) + 1
    got = [tuple(r) for r in words.select("doc_id", "line_no", "word_no", "text", "left").collect()]
    assert sorted(got) == sorted(want)
    # One struct per block of 32 words grows an array, no longer one per word.
    assert "aggregate(transform(sequence" in _plan(words).replace("\n", "")


def test_rows_are_dealt_before_they_widen(spark):
    """No word is shuffled, and no piece is joined with others."""
    from docflow.plans import layout as plans

    for made in (plans.gapped, plans.lines, plans.coalesce_runs, plans.styled_runs):
        plan = made(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and "REPARTITION_BY_NUM" in plan


def test_sheets_work_their_cells_out_once(spark, monkeypatch):
    """the chain from words to cells ran once for the headers and once more for the rows."""
    from docflow.plans import layout as plans

    seen = []
    monkeypatch.setattr(plans, "write_parts", lambda df, *rest: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or df.write.parquet(rest[0]))
    plans.sink_per_page(spark, "/root/testdata/sf0.001")
    assert "l_orderkey" not in seen[0]


def test_digits_are_not_broadcast(spark):
    """digits in rows were estimated at the size of their numbers and sent to the driver."""
    from docflow.plans import values as plans

    for made in (plans.positional_value_long, plans.positional_value):
        plan = made(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "BuildLeft" not in plan and "SortMergeJoin" in plan


def test_numbers_are_parsed_once(spark):
    """the parts of a parsed number were each worked out from its text again."""
    from docflow.operators import numbers as ops

    rows = spark.createDataFrame([(1, "12.50"), (2, "-0.1"), (3, "7"), (4, "0.00390625"), (5, "x"), (6, "123456789012345678.123456789012")], "id int, text string")
    made = ops.base_fanout(rows, ["id"], "text", 10, 12)
    assert _plan(made).count("two_separators") == 1
    got = {(r["id"], r["base"]): (r["value"], r["is_exact"]) for r in made.collect()}
    assert got[1, 2] == ("1100.1", True) and got[1, 256] == ("12:.128".replace(":.", "."), True) and got[2, 16] == ("-0.199999999999", False)
    assert got[4, 256] == ("0.1", True) and got[4, 64] == ("0.0:16", True) and got[4, 8] == ("0.002", True) and not any(k == 5 for k, _ in got)
    part = lambda b: 123456789012 * b**12 // 10**12
    assert got[6, 2][0].split(".")[1] == format(part(2), "012b") and got[6, 16][0].split(".")[1] == format(part(16), "012X")


def _folders(monkeypatch, tmp_path, made, spark):
    """How many folders a query of files makes, and its rows."""
    from docflow.plans import live as plans

    monkeypatch.setattr(plans, "scratch", lambda spark, name: str(tmp_path / name))
    rows = getattr(plans, made)(spark, "/root/testdata/sf0.001").collect()
    return sum(p.is_dir() for p in tmp_path.rglob("*")), rows


def test_documents_take_no_folder_each(spark, monkeypatch, tmp_path):
    """every document was a folder of its own, to be made, moved and listed."""
    folders, rows = _folders(monkeypatch, tmp_path, "text_files", spark)
    assert folders < 10 and len(rows) == 200 and len(list(tmp_path.rglob("[0-9]*.txt"))) == 200


def test_rows_of_one_name_are_one_file(spark, tmp_path):
    """a name in several rows is one file; names that differ in case lie together."""
    from docflow.sources import files

    rows = spark.createDataFrame([("a.txt", b"12"), ("A.txt", b"3"), ("a.txt", b"45"), ("b.txt", None)], "name string, content binary").repartition(4)
    files.write_files(rows, f"file://{tmp_path}/out", "name", "content", files_per_folder=2)
    got = {p.name: p.read_bytes() for p in (tmp_path / "out").rglob("*.txt")}
    assert got.pop("a.txt") in (b"1245", b"4512") and got == {"A.txt": b"3", "b.txt": b""}
    assert not list((tmp_path / "out").rglob("_*")) and len({p.parent for p in (tmp_path / "out").rglob("[aA].txt")}) == 1


def test_suppliers_take_no_folder_each(spark, monkeypatch, tmp_path):
    """every name was a folder of its own."""
    folders, rows = _folders(monkeypatch, tmp_path, "folder_files", spark)
    assert folders < 5 and rows


def test_patterns_of_letters_begin_with_a_letter(spark):
    """patterns that begin by looking back were tried at every place of a text."""
    from docflow.functions import script as S

    texts = spark.createDataFrame([("Eshik e'lon tsirk Stansiya ma'no OʻZ",), ("ЕЛКА ель объём ЦЕХ бъЕ aцЕ",)], "t string")
    made = texts.select(S.latin_to_cyrillic(F.col("t")).alias("c"), S.cyrillic_to_latin(F.col("t")).alias("l"))
    plan = _plan(made)
    assert "regexp_replace" in plan and ", (?<" not in plan.replace(", (?<![^", "") and ", (?:(?<" not in plan
    assert [r["c"] for r in made.collect()][0] == "Эшик эълон цирк Стансия маъно ЎЗ"


def test_pages_are_packed_in_pieces(spark):
    """all pages of a file were packed by one task, and each archive's entries were a frame of their own."""
    from docflow.plans import live as plans
    from docflow.sources import files

    assert "REPARTITION_BY_NUM" in plans.zipped_pages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    packed = spark.range(300, numPartitions=1).select(F.concat("id", F.lit(".zip")).alias("path"), F.lit(b"junk").alias("content"))
    frames = files.list_archives(packed).mapInPandas(lambda frames: (f.head(1) for f in frames), files.ENTRY_SCHEMA)
    assert files.list_archives(packed).count() == 300 and frames.count() < 300


def test_outlines_are_dealt_before_they_widen(spark):
    """narrow rows were joined into few pieces at run time, then widened by the windows."""
    from docflow.plans import structure as plans

    plan = plans.outline_numbers(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == plan.count("REPARTITION_BY_NUM") and "Window" in plan


def test_recognised_texts_are_read_once(spark):
    """texts were cleaned once for the usual height and once more for the blocks, and joined."""
    from docflow.plans import layout as plans

    made = plans.recognised_blocks(spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and "Join" not in plan
    pages = spark.createDataFrame(
        [(1, 1, 1, "one line\n", 30.0, 90.0), (1, 1, 2, "x" * 400, 10.0, 90.0), (1, 1, 3, "  \n", 99.0, 90.0), (None, 1, 1, "lost", 50.0, 90.0)],
        "doc_id int, page_no int, par_no int, text string, height double, confidence double")
    got = {(r["doc_id"], r["par_no"]): (r["kind"], r["n_lines"], r["font_size"]) for r in layout.recognised_blocks(pages, ["doc_id", "page_no"], "par_no").collect()}
    assert got == {(1, 1): ("Heading2", 1, 24.0), (1, 2): ("Paragraph", 1, 8.0), (None, 1): ("Paragraph", 1, 40.0)}


def test_passages_are_read_and_shuffled_once(spark):
    """op1: every text was cut twice, and each unit was shuffled once per key, 1.9 times on the average."""
    from docflow.llm import repeats

    plan = repeats.repeated_spans(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange") == 2 and "Join" not in plan


def test_long_sentences_have_short_keys():
    """op1: every part of a sentence carried the whole sentence in its key, quadratic in its length."""
    from docflow.llm import repeats

    text = " ".join(f"w{i * i % 7919}" for i in range(8_000))
    units = repeats.cut_units(text)
    keys = repeats.keyed(units)
    assert len(keys) == len(units) + 1 and sum(len(x) for k in keys for x in k if isinstance(x, (str, bytes))) <= 8 * len(keys)
    # A character of another script at the end takes the slower way for the text before it.
    for text in ("Ab  cd\tEf. gh\n" + "One two three four five Six " * 9, "é à. Ün\n" + "zwölf Große Über öl " * 12):
        quick = repeats.cut_units(text + "\nend")
        assert quick[:-1] == repeats.cut_units(text + "\n界")[:-1] and len(quick) > 2


def test_lines_keep_no_shingles(spark, monkeypatch):
    """op2: shingles of lines were written, and minima were taken of every one of them."""
    from docflow.llm import lines

    written, steady = [], lines.steady
    monkeypatch.setattr(lines, "steady", lambda df: written.append(df.schema.simpleString()) or steady(df))
    long = " ".join(f"word{i * i % 97}" for i in range(100))
    rows = spark.createDataFrame([(1, long), (2, long + " more"), (3, "a short one"), (4, "a shorter one")], "doc_id long, text string")
    assert [r["kept"] for r in lines.line_verdicts(rows).orderBy("doc_id").collect()] == [True, False, True, True]
    assert written and not any("array" in x for x in written)
    hashes = rows.where("doc_id = 1").select(F.flatten(lines._elements(F.col("text"))["h"]).alias("h")).first()["h"]
    assert len(hashes) <= 100


def test_near_lines_are_found(spark):
    """op2: of pairs at a similarity of 0.8 or more, held against all shingles, nine in ten are found."""
    from docflow.llm import lines

    random.seed(11)
    word = lambda: "".join(random.choices("abcdefghijklmnoprstuvwy", k=random.randint(1, 9)))
    grams = lambda x: {x[k : k + 5] for k in range(max(1, len(x) - 4))}
    pairs = []
    while len(pairs) < 600:
        line = " ".join(word() for _ in range(random.choice([8, 14, 15, 16, 20, 21, 22, 23, 40, 80])))
        other = list(line)
        for _ in range(random.randint(1, max(1, len(line) // 45))):
            at = random.randrange(1, len(other) - 1)
            other[at : at + random.randint(0, 1)] = random.choice(["", "x", "zq"])
        a, b = grams(line), grams("".join(other).strip())
        if line != "".join(other).strip() and len(a & b) >= 0.8 * len(a | b):
            pairs.append((line, "".join(other).strip(), len(a & b) / len(a | b)))
    rows = spark.createDataFrame([(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)], "doc_id long, text string")
    got = {r["doc_id"]: r["keep_doc_id"] for r in lines.line_verdicts(rows).collect()}
    found = [got[2 * i + 1] == 2 * i for i in range(len(pairs))]
    near = [f for f, p in zip(found, pairs) if p[2] < 0.85]
    print(f"found {sum(found)} of {len(found)}; under 0.85: {sum(near)} of {len(near)}")
    assert sum(found) >= 0.95 * len(found) and len(near) > 30 and sum(near) >= 0.9 * len(near)


def test_lines_of_one_template_are_not_compared_in_all_pairs(spark, monkeypatch):
    """op2: lines under one key that were still apart were compared in all pairs, shingle by shingle."""
    from docflow.llm import lines

    compared, similar = [], lines._similar
    monkeypatch.setattr(lines, "_similar", lambda pairs, *rest: compared.append(pairs.count()) or similar(pairs, *rest))
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnoprstuvwy", k=rng.randint(3, 8)))
    template = [word() for _ in range(60)]
    made = [" ".join(word() if k in odd else w for k, w in enumerate(template)) for odd in (set(rng.sample(range(60), 12)) for _ in range(400))]
    rows = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    kept = {r["doc_id"] for r in lines.line_verdicts(rows).where("kept").collect()}
    assert sum(compared) < 4_000 and len(kept) > 350


def test_sketches_refuse_no_near_pair(spark):
    """op2: a sketch may only refuse what shingles refuse as well."""
    from docflow.llm import lines

    rng = random.Random(8)
    base = ["".join(rng.choices("abcd efgh", k=n)) for n in (3, 9, 40, 300, 2_000)]
    texts = base + ["".join(c if rng.random() > p else "xé" for c in t) for t in base for p in (0.005, 0.02, 0.03, 0.05, 0.2)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, line string")
    sketches = lines._sketches(rows)
    met = lines._of(sketches, "a").crossJoin(lines._of(sketches, "b")).where("a_id > b_id")
    passed = {(r["a_id"], r["b_id"]) for r in met.where(lines._may_be_near(0.8)).collect()}
    near = {tuple(r) for r in lines._similar(met.selectExpr("a_id AS a", "b_id AS b"), rows, 0.8).collect()}
    assert near and near <= passed and len(passed) < met.count()


def test_pieces_make_the_lines_of_their_words(spark):
    """Every word was a row of its own, sorted, numbered and gathered again."""
    rng = random.Random(11)
    marks = ["", "a", "bé", "слово", "𝒳y", "longer", "\t", " ", "x y", "end\t"]
    docs = []
    for k in range(30):
        lines = [" ".join(rng.choice(marks) for _ in range(rng.choice([0, 1, 5, 31, 32, 33, 64, 200]))) for _ in range(rng.randrange(1, 70))]
        docs.append((k, "\n".join(lines)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    shift, lift, bold = F.when(F.col("line_no") % 5 == 3, 20.0).otherwise(0.0), (F.col("word_no") % 3) * 0.5, F.col("line_no") % 7 == 3
    rows = layout.words_from_text(frame, "doc_id", "text").select(
        "doc_id", "page_no", "word_no", "text", (F.col("left") + shift).alias("left"), (F.col("right") + shift).alias("right"), (F.col("top") + lift).alias("top"),
        (F.col("bottom") + lift).alias("bottom"), "baseline", "font_size", "n_letters", F.when(bold, F.col("n_letters")).otherwise(0).alias("n_bold"))
    pieces = layout.pieces_from_text(
        frame, "doc_id", "text", shift=lambda n: F.when(n % 5 == 3, 20.0).otherwise(0.0), lifts=(0.0, 0.5, 1.0), bold=lambda n: n % 7 == 3)
    stats = lambda words: sorted(layout.page_metrics(layout.line_stats(layout.build_lines(words))).collect())
    read = lambda words: sorted(layout.with_metrics(layout.line_stats(layout.build_lines(words))).collect())
    assert stats(pieces) == stats(rows) and read(pieces) == read(rows) and len(read(pieces)) > 200


def test_lines_are_gathered_once(spark):
    """Whole lines with their words were gathered by page for two medians, and
    again by stretch for tables or paragraphs."""
    from docflow.plans import layout as plans

    for made in (plans.tabled, plans.grouped):
        plan = made(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count(" partial_collect_list") + plan.count("[partial_collect_list") == 1


def test_hyphens_are_looked_for_at_the_end(spark):
    """a growing paragraph was searched from its start for every line that joined it."""
    line = lambda n, text: (1, 1, n, text, 50.0, 100.0, 800.0 - 14 * n, 790.0 - 14 * n, "Paragraph", 1, 50.0, 500.0)
    frame = spark.createDataFrame(
        [line(1, "a"), line(2, "-"), line(3, "b-"), line(4, "-"), line(5, "é‐"), line(6, "z")],
        "doc_id int, page_no int, line_no int, text string, left double, right double, top double, bottom double, kind string, "
        "para_no int, min_left double, max_right double")
    made = layout.paragraph_build(frame)
    assert made.collect()[0].text == "a - béz"
    assert "substring" in made._jdf.queryExecution().executedPlan().toString()


def test_short_fractions_are_compiled(spark):
    """digits of every fraction and of every wide base were made in lambdas, which are not compiled."""
    from docflow.functions import numbers as N
    from docflow.operators import numbers as ops

    rng = random.Random(8)
    texts = [f"{rng.randrange(10 ** rng.randrange(1, 18))}.{''.join(rng.choice('0123456789') for _ in range(rng.randrange(0, 17)))}" for _ in range(60)] + ["0.0", "5.", ".5", "1.25"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for limit in (4, 12, 64):
        made = ops.base_fanout(frame, ["id"], "text", 10, limit)
        for r in made.collect():
            whole, _, part = texts[r["id"]].partition(".")
            b, top, under = r["base"], int(part or 0), 10 ** len(part)
            digits = [top * b ** (k + 1) // under % b for k in range(limit)]
            exact = top * b**limit % under == 0
            while exact and digits and not digits[-1]:
                digits.pop()
            spell = lambda ds: "".join(N.DIGITS[d] for d in ds) if b <= 32 else ":".join(map(str, ds))
            left, n = [], int(whole or 0)
            while n or not left:
                left, n = [n % b, *left], n // b
            want = spell(left) + ("." + spell(digits) if any(digits) or not exact else "")
            assert (r["value"], r["is_exact"]) == (want, exact), (texts[r["id"]], b)
    assert "concat_ws(:" in _plan(made)


def test_shingles_are_cut_from_code_points_of_one_width(spark):
    """every shingle was found by a pattern that looked ahead at every place of a line."""
    from docflow.llm import lines

    texts = ["", "abc", "abcde", "abcdef", "naïve é𝒳 слово", "x" * 40, "aé\U0001F600b\r cdefg"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, line string")
    made = rows.select("id", lines.shingles(F.col("line")).alias("h"))
    got = {r["id"]: r["h"] for r in made.collect()}
    grams = {i: [t[k : k + 5] for k in range(len(t) - 4)] if len(t) > 5 else [t] for i, t in enumerate(texts)}
    known = {}
    for i, hashes in got.items():
        assert len(hashes) == len(grams[i])
        for h, gram in zip(hashes, grams[i]):
            if len(texts[i]) > 5:
                assert known.setdefault(gram, h) == h
    assert len(set(known.values())) == len(known)
    assert "regexp_extract_all" not in _plan(made)
