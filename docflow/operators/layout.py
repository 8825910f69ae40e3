"""From positioned words to lines, tables and paragraphs.

Words are shuffled once, by page. A line then is one row that carries its words, and what
follows (metrics, gaps, tables, paragraphs) groups lines by page or by less, which is where
they already lie: no further shuffle, no second reading, no join of lines with themselves. A
page has few lines however many words it holds: two lines lie at least half a point apart.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from docflow.functions.text import SPACE, SPACES, color_hex, font_family, is_list_item, line_count, names_style, paragraph_text, trim_space
from docflow.functions.weighted import breaks_to_slices, median, weighted_median

PAGE = ("doc_id", "page_no")
WORD_FIELDS = ("right", "top", "bottom", "baseline", "font_size", "n_letters", "n_bold", "text")
# A4 in points, and what a page without usable words is measured with.
PAGE_WIDTH, PAGE_HEIGHT = 595.0, 842.0
DEFAULT_FONT_SIZE, DEFAULT_GAP = 11.0, 2.0


def _blocks(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """``doc, __line, at, words, __block``: lines of plain text in blocks of 32 tokens, and how many
    letters and words stand before a block in its line."""
    lines = docs.select(doc, F.posexplode(F.split(text, "\n")).alias("__line", "__text"))
    # Lines are cut into blocks of tokens, so that a line of any length takes time in step with
    # its length. A token starts behind what stands before it in its block.
    tokens, block = F.split("__text", " "), 32
    cut = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("__tokens") - 1) / block).cast("int")),
        lambda b: F.array_join(F.slice("__tokens", b * block + 1, F.lit(block)), " "),
    )
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("words"), F.array().cast("array<struct<at:int,words:int,text:string>>").alias("blocks"))
    placed = F.aggregate(
        cut,
        start,
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t) + 1).alias("at"),
            (acc["words"] + F.regexp_count(t, F.lit("[^ ]+"))).alias("words"),
            F.concat(acc["blocks"], F.array(F.struct(acc["at"].alias("at"), acc["words"].alias("words"), t.alias("text")))).alias("blocks"),
        ),
        lambda acc: acc["blocks"],
    )
    whole = F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("words"), F.col("__text").alias("text")))
    blocks = lines.withColumn("__tokens", tokens).select(doc, "__line", F.explode(F.when(F.size("__tokens") <= block, whole).otherwise(placed)).alias("__b"))
    return blocks.select(doc, "__line", "__b.at", "__b.words", F.col("__b.text").alias("__block"))


def words_from_text(docs: DataFrame, doc: str, text: str, lines_per_page: int = 50) -> DataFrame:
    """Positioned words of plain text: 6 points a letter, 14 points a line."""
    each = _blocks(docs, doc, text).select(
        "*", F.posexplode(F.split("__block", " ")).alias("__i", "__t")
    ).where("__t <> ''")
    before = F.call_function("substring_index", F.col("__block"), F.lit(" "), F.col("__i"))
    # Without blanks in a row, the place of a token is its number.
    apart = ~(F.col("__block").contains("  ") | F.col("__block").startswith(" "))
    words = each.select(
        doc, "__line", (F.col("words") + F.when(apart, F.col("__i")).otherwise(F.regexp_count(before, F.lit("[^ ]+")))).alias("word_no"),
        F.struct((F.col("at") + F.when(F.col("__i") > 0, F.length(before) + 1).otherwise(0)).alias("at"), F.col("__t").alias("text")).alias("__w"),
    )
    left, length = 50 + 6.0 * F.col("__w.at"), F.length("__w.text")
    bottom = 800 - 14.0 * (F.col("__line") % lines_per_page)
    size = F.when(F.col("__line") == 0, 18.0).otherwise(11.0)
    return words.select(
        doc,
        (F.floor(F.col("__line") / lines_per_page) + 1).cast("int").alias("page_no"),
        F.col("__line").alias("line_no"),
        "word_no",
        F.col("__w.text").alias("text"),
        left.alias("left"),
        (left + 6.0 * length).alias("right"),
        (bottom + 10).alias("top"),
        bottom.alias("bottom"),
        bottom.alias("baseline"),
        size.alias("font_size"),
        F.lit(False).alias("is_bold"),
        length.alias("n_letters"),
        F.lit(0).alias("n_bold"),
    )


def word(text: Column, left: Column, right: Column, top: Column, bottom: Column, baseline: Column, font_size: Column, n_letters: Column, n_bold: Column, word_no: Column) -> Column:
    """A word as lines hold it, in the order of a line; null for one without letters."""
    height = F.abs(top - bottom)
    fields = {
        "left": left, "down": -((bottom + top) / 2), "word_no": word_no, "h": F.when(height > 0, height).otherwise(10.0), "right": right, "top": top,
        "bottom": bottom, "baseline": baseline, "font_size": font_size, "n_letters": n_letters, "n_bold": n_bold, "text": text,
    }
    return F.when((n_letters > 0) & (F.ltrim(text, F.lit(SPACES)) != ""), F.struct(*(c.alias(k) for k, c in fields.items())))


def piece(left: Column, right: Column, bottom: Column, n_letters: Column, n_bold: Column, word_no: Column, text: Column, baseline: Column, font_size: Column, height: float) -> Column:
    """Words as ``build_lines`` takes them in pieces, of an array for every value of theirs; ``baseline``
    and ``font_size`` are those of all of them, and so is ``height``. Words without letters are the
    caller's to leave out. Arrays are zipped, as a struct made in a lambda is not compiled."""
    n = F.size(text)
    over = lambda by: F.transform(bottom, lambda y: y + by)
    fields = {
        "left": left, "down": F.transform(bottom, lambda y: -((y + (y + height)) / 2)), "word_no": word_no, "h": F.array_repeat(F.lit(height), n), "right": right,
        "top": over(height), "bottom": bottom, "baseline": F.array_repeat(baseline, n), "font_size": F.array_repeat(font_size, n),
        "n_letters": n_letters, "n_bold": n_bold, "text": text,
    }
    return F.arrays_zip(*(c.alias(k) for k, c in fields.items()))


def pieces_from_text(docs: DataFrame, doc: str, text: str, lines_per_page: int = 50, shift=None, lifts: Sequence[float] = (0.0,), bold=None) -> DataFrame:
    """The words of ``words_from_text`` in pieces for ``build_lines``, a row per 32 tokens of a line.
    Lines lie ``shift(line)`` points further right, words by turns ``lifts`` points higher, and letters are
    bold in lines where ``bold(line)``; counted from 0."""
    line, page_no = F.col("__line"), (F.floor(F.col("__line") / lines_per_page) + 1).cast("int")
    cut = _blocks(docs, doc, text).select(doc, "__line", "at", "words", "__block", F.split("__block", " ").alias("__t"))
    # A token starts behind what stands before it in its block.
    before = lambda i: F.length(F.call_function("substring_index", F.col("__block"), F.lit(" "), i)) + 1
    begins = F.transform("__t", lambda _, i: F.col("at") + F.when(i > 0, before(i)).otherwise(0))
    cut = cut.select(doc, "__line", "words", "__block", "__t", begins.alias("__s"))
    pairs = F.arrays_zip(F.col("__t").alias("t"), F.col("__s").alias("s"))
    solid = cut.select(doc, "__line", "words", "__block", F.when(F.array_contains("__t", ""), F.filter(pairs, lambda p: p["t"] != "")).otherwise(pairs).alias("__p"))
    left = 50.0 + (shift(line) if shift else F.lit(0.0))
    measured = solid.select(
        doc, "__line", "words", "__block", F.col("__p.t").alias("__t"), F.transform("__p.t", lambda t: F.length(t)).alias("__n"),
        F.transform("__p.s", lambda at: left + 6.0 * at).alias("__left"),
    )
    n, bottom = F.size("__t"), 800 - 14.0 * (line % lines_per_page)
    turns = F.flatten(F.array_repeat(F.array(*(bottom + up for up in lifts)), F.floor(n / len(lifts)).cast("int") + 2))
    made = piece(
        F.col("__left"), F.zip_with("__left", "__n", lambda x, k: x + 6.0 * k), F.slice(turns, F.col("words") % len(lifts) + 1, n), F.col("__n"),
        F.when(bold(line), F.col("__n")).otherwise(F.array_repeat(F.lit(0), n)) if bold else F.array_repeat(F.lit(0), n),
        F.slice(F.sequence(F.col("words"), F.col("words") + n), F.lit(1), n), F.col("__t"), bottom, F.when(line == 0, 18.0).otherwise(11.0), 10.0,
    )
    whole = measured.select(doc, page_no.alias("page_no"), "__block", made.alias("words"))
    # Other kinds of space count as a word's number but are no word.
    blank = F.col("__block").rlike(rf"[^\S ]|[{SPACE[2:]}]")
    return whole.select(doc, "page_no", F.when(blank, F.filter("words", lambda w: F.ltrim(w["text"], F.lit(SPACES)) != "")).otherwise(F.col("words")).alias("words"))


def build_lines(words: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """Words gathered into lines, numbered from the top: one row per line with its words.

    ``words`` has a row per word, or pieces of a page: rows with an array of any number of them
    (of ``piece``) in ``words``. Words that come in pieces are not taken apart.

    Words run from the top down. One joins the current line if its middle is within half a
    height of the line's running mean. Where the gap to the words above is wider than any
    height on the page allows, a new line must begin; pages are cut there first, so the walk
    never holds more than the pieces that touch each other vertically.
    """
    page = list(page)
    if "words" in words.columns:
        pieces = words.select(*page, F.col("words").alias("__ws"))
    else:
        one = word(*(F.col(f) for f in ("text", "left", "right", "top", "bottom", "baseline", "font_size", "n_letters", "n_bold", "word_no")))
        pieces = words.select(*page, one.alias("__w")).where("__w IS NOT NULL").select(*page, F.array("__w").alias("__ws"))
    boxed = pieces.select(
        *page, "__ws", F.array_min("__ws.down").alias("__top"), F.array_max("__ws.down").alias("__low"),
        F.array_max("__ws.h").alias("__tall"), F.array_min("__ws.h").alias("__short"),
    )
    down = Window.partitionBy(*page).orderBy("__top")
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    whole = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    apart = F.col("__top") - F.max("__low").over(above) > 0.5 * F.greatest(F.lit(1.0), F.max("__tall").over(whole))
    islands = boxed.withColumn("__cut", F.when(apart, 1).otherwise(0)).withColumn(
        "__island", F.sum("__cut").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    touching = (
        islands
        .groupBy(*page, "__island")
        .agg(
            F.sort_array(F.flatten(F.collect_list("__ws"))).alias("__words"),
            (F.max("__low") - F.min("__top")).alias("__range"),
            F.min("__short").alias("__low"),
        )
        .where(F.size("__words") > 0)
    )

    none = F.array().cast("array<int>")
    start = F.struct(
        F.lit(0).alias("i"), F.lit(0.0).alias("centre"), F.lit(0).alias("count"), F.lit(0.0).alias("height"),
        none.alias("breaks"),
    )

    def step(acc: Column, w: Column) -> Column:
        centre = -w["down"]
        tolerance = 0.5 * F.greatest(F.lit(1.0), acc["height"], w["h"])
        joins = (acc["i"] > 0) & (F.abs(centre - acc["centre"]) <= tolerance)
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(joins, (acc["centre"] * acc["count"] + centre) / (acc["count"] + 1)).otherwise(centre).alias("centre"),
            F.when(joins, acc["count"] + 1).otherwise(1).alias("count"),
            F.when(joins, F.greatest(acc["height"], w["h"])).otherwise(w["h"]).alias("height"),
            F.when(joins | (acc["i"] == 0), acc["breaks"])
            .otherwise(F.concat(acc["breaks"], F.array(acc["i"])))
            .alias("breaks"),
        )

    order_as = lambda ws, *first: F.sort_array(
        F.transform(ws, lambda w: F.struct(*(w[f].alias(f) for f in (*first, "word_no", "h", *WORD_FIELDS))))
    )
    # Words that all lie within the least tolerance are one line, and need no walk.
    level = F.col("__range") <= 0.5 * F.greatest(F.lit(1.0), F.col("__low"))
    sorted_down = touching.select(*page, "__island", "__words", F.when(~level, order_as(F.col("__words"), "down", "left")).alias("__down"))
    breaks = F.aggregate("__down", start, step, lambda acc: acc["breaks"])
    walked = F.transform(breaks_to_slices(F.col("__down"), breaks), lambda ws: order_as(ws, "left", "down"))
    lines = sorted_down.select(
        *page, "__island",
        F.posexplode(F.when(F.col("__down").isNull(), F.array("__words")).otherwise(walked)).alias("__local", "words"),
    )
    order = Window.partitionBy(*page).orderBy("__island", "__local")
    return lines.select(*page, F.row_number().over(order).alias("line_no"), "words")


def line_stats(lines: DataFrame) -> DataFrame:
    """Text, box, baseline, size and boldness of each line."""
    pick = lambda f: F.col(f"words.{f}")
    weigh = lambda f, keep: F.transform(
        F.filter("words", keep), lambda w: F.struct(w[f].alias("v"), w["n_letters"].cast("bigint").alias("n"))
    )
    add = lambda f: F.aggregate(pick(f), F.lit(0), lambda acc, n: acc + n)
    size = F.when(_one_size(), F.array_min(pick("font_size"))).otherwise(
        weighted_median(weigh("font_size", lambda w: (w["font_size"] > 0) & ~F.isnan(w["font_size"])))
    )
    # Mostly all words of a line stand on one height, and then there is nothing to count.
    lowest = F.array_min(pick("baseline"))
    baseline = F.when(lowest == F.array_max(pick("baseline")), lowest).otherwise(weighted_median(weigh("baseline", lambda w: F.lit(True))))
    # No word has bold letters, and none is unknown: looking for -1 gives null where one is.
    plain = (F.array_max(pick("n_bold")) <= 0) & ~F.array_contains(pick("n_bold"), F.lit(-1)) & (F.array_min(pick("n_letters")) > 0)
    return lines.select(
        "*",
        trim_space(F.array_join(pick("text"), " ")).alias("text"),
        F.array_min(pick("left")).alias("left"),
        F.array_max(pick("right")).alias("right"),
        F.array_max(pick("top")).alias("top"),
        F.array_min(pick("bottom")).alias("bottom"),
        baseline.alias("baseline"),
        F.coalesce(size, F.lit(DEFAULT_FONT_SIZE)).alias("font_size"),
        F.when(plain, False).otherwise(add("n_bold") >= add("n_letters") * 0.7).alias("is_bold"),
    ).where("text <> ''")


def _one_size() -> Column:
    """Whether all words of a line that have a size have the same usable one."""
    least = F.array_min("words.font_size")
    return (least == F.array_max("words.font_size")) & (least > 0) & ~F.isnan(least)


def word_gaps(words: Column) -> Column:
    """Blanks between neighbours of one line."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words["left"], F.lit(2), n), F.slice(words["right"], F.lit(1), n), lambda left, right: left - right)


def _listed(lines: DataFrame) -> DataFrame:
    """Lines with what their page is measured by: ``__s`` pairs of sizes and letters, ``__g`` gaps
    and ``__c`` pairs of a gap and its number where a line has one gap throughout."""
    pair = lambda v, n: F.struct(v.alias("v"), n.cast("bigint").alias("n"))
    usable = lambda x: (x["v"] > 0) & ~F.isnan(x["v"])
    letters = F.aggregate("words.n_letters", F.lit(0).cast("bigint"), lambda acc, n: acc + n)
    sizes = F.when(_one_size(), F.array(pair(F.array_min("words.font_size"), letters))).otherwise(
        F.filter(F.transform("words", lambda w: pair(w["font_size"], w["n_letters"])), usable)
    )
    gaps = F.filter(word_gaps(F.col("words")), lambda g: (g > 0) & (g < 100))
    same = F.array_min("__g") == F.array_max("__g")
    return lines.withColumns({"__s": sizes, "__g": gaps}).withColumns({
        "__c": F.when(same, pair(F.array_min("__g"), F.size("__g"))), "__g": F.when(~same, F.col("__g")),
    })


def _page_values(sizes: Column, gaps: Column, counted: Column) -> dict[str, Column]:
    """Body size and usual gap of a page from the lists of its lines."""
    plain = F.flatten(gaps)
    pairs = F.concat(counted, F.transform(plain, lambda g: F.struct(g.alias("v"), F.lit(1).cast("bigint").alias("n"))))
    gap = F.when(F.size(counted) == 0, median(plain)).otherwise(weighted_median(pairs))
    return {
        "body_size": F.coalesce(weighted_median(F.flatten(sizes)), F.lit(DEFAULT_FONT_SIZE)),
        "median_gap": F.coalesce(gap, F.lit(DEFAULT_GAP)),
    }


def page_metrics(lines: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """Body size, margins and usual word gap per page."""
    gathered = _listed(lines).groupBy(*page).agg(
        *(F.collect_list(c).alias(c) for c in ("__s", "__g", "__c")),
        F.min("left").alias("min_left"), F.max("right").alias("max_right"), F.max("top").alias("max_top"),
    )
    values = _page_values(F.col("__s"), F.col("__g"), F.col("__c"))
    return gathered.select(*page, values["body_size"].alias("body_size"), "min_left", "max_right", "max_top", values["median_gap"].alias("median_gap"))


def _down(page: Sequence[str]) -> tuple[WindowSpec, WindowSpec]:
    """Lines of a page in order, and all of them at every line. Whatever follows lines uses this
    order, so that they are sorted once."""
    order = Window.partitionBy(*page).orderBy("line_no")
    return order, order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def with_metrics(lines: DataFrame, metrics: DataFrame | None = None, page: Sequence[str] = PAGE) -> DataFrame:
    """Lines with the metrics of their page: given ones by key, else measured in passing, on
    the first line of a page, and handed on to the others. Lines stay where they are."""
    if metrics is not None:
        return lines.join(metrics, list(page))
    order, whole = _down(page)
    lists = {c: F.collect_list(c).over(whole) for c in ("__s", "__g", "__c")}
    margins = {"min_left": F.min("left").over(whole), "max_right": F.max("right").over(whole), "max_top": F.max("top").over(whole)}
    seen = _listed(lines).select(
        *(c for c in lines.columns), *(v.alias(f"{c}s") for c, v in lists.items()), *(v.alias(c) for c, v in margins.items()),
        F.row_number().over(order).alias("__n"),
    )
    values = _page_values(F.col("__ss"), F.col("__gs"), F.col("__cs"))
    first = F.when(F.col("__n") == 1, F.struct(*(v.alias(c) for c, v in values.items())))
    known = seen.select(*lines.columns, *margins, first.alias("__m")).withColumn("__m", F.first("__m", ignorenulls=True).over(whole))
    return known.select(*lines.columns, "__m.body_size", "min_left", "max_right", "max_top", "__m.median_gap")


def column_gaps(lines: DataFrame, metrics: DataFrame | None = None, page: Sequence[str] = PAGE) -> DataFrame:
    """Left edges of the words that follow a wide gap, as an array per line."""
    threshold = F.greatest(2.5 * F.col("median_gap"), F.lit(4.0), 0.9 * F.col("body_size"))
    none = F.array().cast("array<double>")
    start = F.struct(F.lit(None).cast("double").alias("right"), none.alias("gaps"))

    def walked(limit: Column) -> Column:
        return F.aggregate(
            F.transform("words", lambda w: F.struct(w["left"].alias("left"), w["right"].alias("right"), limit.alias("limit"))),
            start,
            lambda acc, w: F.struct(
                F.greatest(acc["right"], w["right"]).alias("right"),
                F.when(w["left"] - acc["right"] >= w["limit"], F.concat(acc["gaps"], F.array(w["left"])))
                .otherwise(acc["gaps"])
                .alias("gaps"),
            ),
            lambda acc: acc["gaps"],
        )

    # Mostly every word ends behind the ones before it, and then only neighbours count.
    n, ends = F.greatest(F.size("words") - 1, F.lit(0)), F.col("words.right")
    edges = F.array(F.struct(F.slice("words.left", F.lit(2), n).alias("left"), ends.alias("right"), threshold.alias("limit")))
    direct = F.get(F.transform(edges, lambda e: F.filter(e["left"], lambda x, i: x - F.get(e["right"], i) >= e["limit"])), F.lit(0))
    gaps = F.when(F.sort_array(ends) == ends, direct).otherwise(walked(threshold))
    return with_metrics(lines, metrics, page).withColumn("gaps", gaps)


def _starts(lines: DataFrame, page: Sequence[str], line: Column, state: dict[str, Column], begins, after) -> DataFrame:
    """Lines in runs, as ``__n`` (place on the page), ``__at`` (place in the run, from 0) and ``__more``
    (whether the next line is of the same run). ``begins(state, line)`` says whether a line
    begins a run, ``after(state, line, begun)`` gives the state behind it. Only what ``line``
    holds is gathered, and walked once a page."""
    order, whole = _down(page)
    seen = lines.withColumns({"__n": F.row_number().over(order), "__all": F.collect_list(line).over(whole)})
    start = F.struct(F.lit(0).alias("__i"), F.lit(1).alias("__run"), F.array().cast("array<int>").alias("__runs"), *(c.alias(k) for k, c in state.items()))

    def step(acc: Column, x: Column) -> Column:
        begun = (acc["__i"] == 0) | begins(acc, x)
        run = F.when(begun, acc["__i"] + 1).otherwise(acc["__run"])
        return F.struct(
            (acc["__i"] + 1).alias("__i"), run.alias("__run"), F.concat(acc["__runs"], F.array(run)).alias("__runs"),
            *(c.alias(k) for k, c in after(acc, x, begun).items()),
        )

    walked = F.when(F.col("__n") == 1, F.aggregate("__all", start, step, lambda acc: acc["__runs"]))
    known = seen.withColumn("__runs", walked).drop("__all").withColumn("__runs", F.first("__runs", ignorenulls=True).over(whole))
    run = F.get("__runs", F.col("__n") - 1)
    return known.withColumns({"__at": F.col("__n") - run, "__more": F.coalesce(F.get("__runs", F.col("__n")) == run, F.lit(False))}).drop("__runs")


def detect_tables(gapped: DataFrame, page: Sequence[str] = PAGE, near: float = 5.0) -> DataFrame:
    """Number the tables of each page; lines outside a table have none.

    A table is two or more lines in a row whose gaps lie where those of its first line lie.
    Lines with another number of gaps part tables for certain.
    """
    order, _ = _down(page)
    count = F.size("gaps")

    def begins(acc: Column, line: Column) -> Column:
        far = F.exists(F.arrays_zip(acc["anchor"].alias("a"), line["gaps"].alias("b")), lambda z: F.abs(z["a"] - z["b"]) > near)
        n = F.size(line["gaps"])
        return F.when((n == 0) | (n != F.size(acc["anchor"])), True).otherwise(far)

    lines = _starts(
        gapped, page, F.struct("gaps"), {"anchor": F.array().cast("array<double>")}, begins,
        lambda acc, line, begun: {"anchor": F.when(begun, line["gaps"]).otherwise(acc["anchor"])},
    )
    tabular = ((F.col("__at") > 0) | F.col("__more")) & (count > 0)
    begun = F.when(tabular & (F.col("__at") == 0), 1).otherwise(0)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("__table", F.sum(begun).over(upto)).select(
        *gapped.columns, F.when(tabular, F.col("__table")).cast("int").alias("table_no"), F.when(tabular, F.col("__at") + 1).alias("row_no")
    )


def _edges(left: Column, right: Column, lines: Column) -> Column:
    """Edges of a table's columns from the gaps of its lines, in order."""
    # Lines of a table have equally many gaps.
    mean = lambda i: F.aggregate(lines, F.lit(0.0), lambda acc, x: acc + F.get(x, i)) / F.size(lines)
    inner = F.transform(F.sequence(F.lit(0), F.size(F.get(lines, F.lit(0))) - 1), mean)
    return F.concat(F.array(left - 1), F.transform(inner, lambda x: x - 2), F.array(right + 1))


def column_edges(tabled: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """Edges and relative widths of each table's columns."""
    table = [*page, "table_no"]
    listed = F.transform(F.sort_array(F.collect_list(F.struct("row_no", "gaps"))), lambda x: x["gaps"])
    tables = tabled.where("table_no IS NOT NULL").groupBy(*table).agg(F.min("left").alias("__left"), F.max("right").alias("__right"), listed.alias("__gaps"))
    columns = tables.select(*table, _edges(F.col("__left"), F.col("__right"), F.col("__gaps")).alias("edges"))
    raw = F.transform(
        F.sequence(F.lit(1), F.size("edges") - 1),
        lambda k: F.greatest(F.lit(1.0), F.get("edges", k) - F.get("edges", k - 1)),
    )
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    floor = total(F.col("__raw")) / F.size("__raw") * 0.6
    return (
        columns.withColumn("__raw", raw)
        .withColumn("__floor", floor)
        .withColumn("__wide", F.transform("__raw", lambda w: F.greatest(w, F.col("__floor"))))
        .withColumn("__sum", F.greatest(F.lit(1.0), total(F.col("__wide"))))
        .select(*table, "edges", F.transform("__wide", lambda w: w / F.col("__sum")).alias("widths"))
    )


def words_to_columns(tabled: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """Cells of every table: a word belongs to the column its middle falls into.

    Edges are worked out on a table's first line and handed on to its others, and the band
    test runs inside each row.
    """
    table = [*page, "table_no"]
    order = Window.partitionBy(*table).orderBy("row_no")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Of a word no more is kept than its middle and its text.
    middles = F.zip_with("words.left", "words.right", lambda left, right: (left + right) / 2)
    placed = F.arrays_zip(middles.alias("at"), F.col("words.text").alias("text"))
    lines = tabled.where("table_no IS NOT NULL").select(*table, "row_no", placed.alias("__ws"), "is_bold", "left", "right", "gaps")
    seen = lines.select(
        *table, "row_no", "__ws", "is_bold", F.min("left").over(whole).alias("__left"), F.max("right").over(whole).alias("__right"),
        F.collect_list("gaps").over(whole).alias("__gaps"),
    )
    edges = F.when(F.col("row_no") == 1, _edges(F.col("__left"), F.col("__right"), F.col("__gaps")))
    known = seen.select(*table, "row_no", "__ws", "is_bold", edges.alias("edges")).withColumn("edges", F.first("edges", ignorenulls=True).over(whole))

    bands = F.arrays_zip(F.slice("edges", F.lit(1), F.size("edges") - 1).alias("lo"), F.slice("edges", F.lit(2), F.size("edges")).alias("hi"))
    within = lambda b: F.array_join(F.filter("__ws", lambda w: (w["at"] >= b["lo"]) & (w["at"] < b["hi"]))["text"], " ")
    cells = F.transform(bands, within)
    return known.select(
        *table, "row_no", F.posexplode(cells).alias("__c", "text"), ((F.col("row_no") == 1) & F.col("is_bold")).alias("is_header")
    ).select(*table, "row_no", (F.col("__c") + 1).alias("col_no"), "text", "is_header")


def classify_lines(
    lines: DataFrame, metrics: DataFrame | None = None, page: Sequence[str] = PAGE, headings: bool = True
) -> DataFrame:
    """ListItem, Heading1-3 or Paragraph for each line."""
    ratio = F.col("font_size") / F.col("body_size")
    heading = (
        F.when(F.length("text") > 200, "Paragraph")
        .when(ratio >= 1.6, "Heading1")
        .when(ratio >= 1.3, "Heading2")
        .when((ratio >= 1.15) | (F.col("is_bold") & (F.length("text") <= 120)), "Heading3")
        .otherwise("Paragraph")
    )
    kind = F.when(is_list_item(F.col("text")), "ListItem").otherwise(
        F.when(F.col("body_size") > 0, heading).otherwise("Paragraph") if headings else F.lit("Paragraph")
    )
    return with_metrics(lines, metrics, page).withColumn("kind", kind)


def paragraph_groups(classified: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """Number the paragraphs of each page; table lines belong to none.

    What never continues a paragraph (another kind, a marker, a wide gap, a table) cuts the
    page; in between, lines are walked for their left edges.
    """
    order, _ = _down(page)
    before = lambda c: F.lag(c).over(order)
    tall = F.greatest(F.lit(1.0), before("font_size"), F.col("font_size"))
    gap = before("baseline") - F.col("baseline")
    in_table = F.col("table_no").isNotNull()
    cut = (
        before("line_no").isNull() | before(in_table) | (before("kind") != F.col("kind"))
        | (F.col("kind") == "ListItem") | (gap <= 0) | (gap > tall * 1.6)
    )
    marked = classified.withColumns({"__cut": F.coalesce(cut | in_table, F.lit(False)), "__tall": tall})
    state = {"count": F.lit(0), "second": F.lit(0.0), "previous": F.lit(0.0)}

    def begins(acc: Column, line: Column) -> Column:
        body = F.when(acc["count"] >= 2, acc["second"]).otherwise(acc["previous"])
        aligned = F.abs(line["left"] - body) <= F.greatest(F.lit(8.0), line["__tall"] * 1.2)
        indented = (
            (acc["count"] == 1) & (line["left"] < acc["previous"]) & (acc["previous"] - line["left"] <= line["__tall"] * 3)
        )
        return line["__cut"] | ~F.coalesce(aligned | indented, F.lit(False))

    def after(acc: Column, line: Column, begun: Column) -> dict[str, Column]:
        count = F.when(begun, 1).otherwise(acc["count"] + 1)
        return {"count": count, "second": F.when(count == 2, line["left"]).otherwise(acc["second"]), "previous": line["left"]}

    lines = _starts(marked, page, F.struct("left", "__tall", "__cut"), state, begins, after)
    begun = F.when(~in_table & (F.col("__at") == 0), 1).otherwise(0)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("__para", F.sum(begun).over(upto)).select(
        *classified.columns, F.when(~in_table, F.col("__para")).cast("int").alias("para_no")
    )


def alignment(left: Column, right: Column, width: float = PAGE_WIDTH) -> Column:
    """Left, Center or Right of a box on a page measured by ``page_metrics``."""
    centre, indent = (left + right) / 2, left - F.col("min_left")
    return (
        F.when((F.abs(centre - width / 2) <= width * 0.035) & (indent > width * 0.06), "Center")
        .when((F.col("max_right") - right <= 2) & (indent > width * 0.12), "Right")
        .otherwise("Left")
    )


def paragraph_build(
    grouped: DataFrame, page: Sequence[str] = PAGE, width: float = PAGE_WIDTH, height: float = PAGE_HEIGHT
) -> DataFrame:
    """One row per paragraph: text with end-of-line hyphens taken out, box, indent, spacing."""
    keys = [*page, "para_no"]
    gathered = grouped.where("para_no IS NOT NULL").groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("__lines"),
        F.min("left").alias("left"), F.max("right").alias("right"),
        F.max("top").alias("__top"), F.min("bottom").alias("__bottom"),
        F.first("kind").alias("kind"), F.first("min_left").alias("min_left"), F.first("max_right").alias("max_right"),
    )
    # The end of a text is enough to tell; it may hold a line break.
    hyphened = lambda text: F.substring(text, -4, 4).rlike(r"\p{L}[-‐]$")

    def join(acc: Column, line: Column) -> Column:
        glued = F.when(hyphened(acc), F.concat(F.left(acc, F.length(acc) - 1), line["text"])).otherwise(
            F.concat(acc, F.lit(" "), line["text"])
        )
        return F.when(acc == "", line["text"]).otherwise(glued)

    return gathered.select(
        *keys, "kind",
        F.aggregate("__lines", F.lit(""), join).alias("text"),
        alignment(F.col("left"), F.col("right"), width).alias("alignment"),
        "left",
        (height - F.col("__top")).alias("top"),
        F.greatest(F.lit(0.0), F.col("right") - F.col("left")).alias("width"),
        F.greatest(F.lit(0.0), F.col("__top") - F.col("__bottom")).alias("height"),
        F.greatest(F.lit(0.0), F.col("left") - F.col("min_left")).alias("indent"),
        F.when(F.col("kind").startswith("Heading"), 8.0).otherwise(6.0).alias("space_after"),
        F.size("__lines").alias("n_lines"),
    ).where(trim_space(F.col("text")) != "")


def font_half_points(size: Column) -> Column:
    """Size in 4..96, rounded to half points; unusable sizes are 11."""
    usable = F.when(F.isnan(size) | size.isNull() | (size <= 0), DEFAULT_FONT_SIZE).otherwise(size)
    return F.round(F.greatest(F.lit(4.0), F.least(F.lit(96.0), usable)) * 2) / 2


def coalesce_runs(pieces: DataFrame, keys: Sequence[str], order: Sequence[str], style: Sequence[str], text: str) -> DataFrame:
    """Merge neighbours of equal style. ``keys`` name a paragraph, which bounds a run."""
    window = Window.partitionBy(*keys).orderBy(*order)
    look = F.struct(*(F.col(c) for c in style))
    changed = F.when(F.lag(look).over(window).eqNullSafe(look), 0).otherwise(1)
    numbered = pieces.withColumn("__new", changed).withColumn("run_no", F.sum("__new").over(window))
    return numbered.groupBy(*keys, "run_no", *style).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("__t")))), lambda p: p["__t"]), "").alias("text")
    )


STYLE = ("family", "size", "bold", "italic", "color")


def run_style(pieces: DataFrame, font: str = "font", weight: str = "weight", slant: str = "slant", color: str = "color") -> DataFrame:
    """Pieces with all that makes up the look of a run: family, size, bold, italic, colour.

    ``font`` is the raw name, which tells the family and may tell bold and italic; ``weight``
    from 600 on is bold too, ``slant`` true is italic; ``color (r, g, b)`` is null where it
    is near black or near white. Nulls tell nothing."""
    bold = names_style(F.col(font), "bold", "black", "heavy") | F.coalesce(F.col(weight) >= 600, F.lit(False))
    italic = names_style(F.col(font), "italic", "oblique") | F.coalesce(F.col(slant), F.lit(False))
    look = {
        "family": font_family(F.col(font)), "size": font_half_points(F.col("size")), "bold": bold, "italic": italic,
        "color": color_hex(F.col(f"{color}.r"), F.col(f"{color}.g"), F.col(f"{color}.b")),
    }
    kept = [c for c in pieces.columns if c not in {font, weight, slant, color, *look}]
    return pieces.select(*kept, *(c.alias(k) for k, c in look.items()))


def drop_deleted_runs(runs: DataFrame, deleted: str = "is_deleted") -> DataFrame:
    return runs.where(~F.coalesce(F.col(deleted), F.lit(False)))


def document_totals(blocks: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """Characters and recognition per page, and per document where the page is null."""
    doc, number = page
    pages = blocks.groupBy(doc, number).agg(
        F.sum(F.length("text")).alias("chars"), F.bool_or("was_recognized").alias("used_ocr")
    )
    return pages.rollup(doc, number).agg(
        F.sum("chars").alias("chars"), F.bool_or("used_ocr").alias("used_ocr")
    ).where(F.col(doc).isNotNull())


def text_layer_pages(pages: DataFrame, text: str, least: int = 24, weak_below: int = 24, page: Sequence[str] = PAGE) -> DataFrame:
    """Letters per page, whether the page is weak, and whether its document has text at all."""
    doc = page[0]
    letters = F.length(F.regexp_replace(text, rf"[{SPACE}]", ""))
    counted = pages.select(*page, F.length(text).alias("chars"), letters.alias("letters"))
    known = counted.groupBy(doc).agg((F.max("letters") >= max(1, least)).alias("has_text"))
    return counted.join(known, doc).withColumn("weak", F.col("chars") < weak_below)


def ocr_fallback(pages: DataFrame, scans: DataFrame, least: int, page: Sequence[str] = PAGE) -> DataFrame:
    """Replace weak pages by their recognised twin where that has more characters."""
    twin = scans.select(*page, *(F.col(c).alias(f"__{c}") for c in ("chars", "width", "height", "text")))
    joined = pages.join(twin, list(page), "left")
    better = F.coalesce((F.col("chars") < least) & (F.col("__chars") > F.col("chars")), F.lit(False))
    sized = lambda c: F.when(better & (F.col(f"__{c}") > 0), F.col(f"__{c}")).otherwise(F.col(c)).alias(c)
    chosen = lambda c: F.when(better, F.col(f"__{c}")).otherwise(F.col(c)).alias(c)
    return joined.select(
        *page, chosen("chars"), chosen("text"), sized("width"), sized("height"),
        (F.col("was_recognized") | better).alias("was_recognized"),
    )


def recognised_blocks(paragraphs: DataFrame, keys: Sequence[str], order: str, least_confidence: float = 60.0) -> DataFrame:
    """Blocks of recognised pages: ``keys``, ``order``, kind, text, font_size, n_lines.

    ``paragraphs (keys, order, text, height, confidence)`` hold the raw text of each paragraph
    and how high its box is. A paragraph is a heading where its lines are a good third higher
    than is usual on its page, it is short, and it was read with confidence; a null confidence
    is none. Empty paragraphs are left out. The usual height is a value of the page's window, so
    texts are read and shuffled once; a page with a null key has none."""
    read = paragraphs.where(F.col("text").rlike(rf"[^{SPACE}]")).select(*keys, order, paragraph_text(F.col("text")).alias("text"), line_count(F.col("text")).alias("n_lines"), "height", "confidence")
    sized = read.withColumn("line_height", F.coalesce(F.col("height") / F.col("n_lines"), F.lit(0.0)))
    counts = (F.col("line_height") > 0) & reduce(and_, (F.col(k).isNotNull() for k in keys))
    usual = F.percentile(F.when(counts, F.col("line_height")), 0.5, _votes()).over(Window.partitionBy(*keys))
    size = F.bround(F.greatest(F.lit(7.0), F.least(F.lit(40.0), F.col("line_height") * 0.8)), 1)
    heading = (
        (F.col("__usual") > 0) & (F.col("line_height") > F.col("__usual") * 1.35) & (F.col("n_lines") <= 2)
        & (F.length("text") <= 90) & (F.col("confidence") >= least_confidence)
    )
    return sized.withColumn("__usual", usual).select(
        *keys, order, F.when(F.coalesce(heading, F.lit(False)), "Heading2").otherwise("Paragraph").alias("kind"), "text", size.alias("font_size"), "n_lines"
    )


def _votes() -> Column:
    return F.least(F.greatest(F.floor(F.length("text") / 10), F.lit(1)), F.lit(40))


def weighted_line_height(paragraphs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Usual line height: every paragraph votes once per ten characters, 1 to 40 times."""
    counted = (
        paragraphs.where("line_height > 0").groupBy(*keys, "line_height").agg(F.sum(_votes()).alias("__votes"))
    )
    return counted.groupBy(*keys).agg(F.percentile("line_height", 0.5, F.col("__votes")).alias("line_height"))


def complete_cells(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row of a table gets all of its columns; spans leave empty cells behind them."""
    row = [*keys, "row_no"]
    listed = F.sort_array(F.collect_list(F.struct("cell_no", "text", F.greatest("span", F.lit(1)).alias("span"))))
    rows = cells.groupBy(*row).agg(listed.alias("__cells"))
    # The table is as wide as its widest row.
    widths = cells.groupBy(*row).agg(F.sum("span").alias("__n")).groupBy(*keys).agg(F.max("__n").cast("int").alias("__cols"))
    filled = F.flatten(
        F.transform(
            "__cells",
            lambda c: F.concat(F.array(F.coalesce(c["text"], F.lit(""))), F.array_repeat(F.lit(""), c["span"] - 1)),
        )
    )
    padded = F.slice(F.concat(filled, F.array_repeat(F.lit(""), F.col("__cols"))), F.lit(1), F.col("__cols"))
    return rows.join(widths, list(keys)).select(*row, F.posexplode(padded).alias("__i", "text")).select(
        *row, (F.col("__i") + 1).alias("col_no"), "text"
    )


def sheet_rows(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All pages on one sheet: a header row per page, then its table rows."""
    doc, page_no = keys
    head = cells.select(doc, page_no).distinct().select(
        doc, page_no, F.lit(0).alias("table_no"), F.lit(0).alias("row_no"), F.lit(1).alias("col_no"),
        F.concat(F.lit("— page "), F.col(page_no), F.lit(" —")).alias("text"),
    )
    return head.unionByName(cells.select(doc, page_no, "table_no", "row_no", "col_no", "text"))
