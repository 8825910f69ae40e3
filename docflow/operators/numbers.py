"""Jobs over numbers and cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions import numbers as N
from docflow.functions.text import trim_space


def base_fanout(numbers: DataFrame, keys: Sequence[str], text: str, base: int, fraction_digits: int) -> DataFrame:
    """Every number written in all nine bases; numbers that fail to parse are left out."""
    limit, to, c = N.fraction_limit(fraction_digits), N.target(F.col("to")), F.col
    # As a row of its own a number is parsed once; fields of a struct are each worked out anew.
    parsed = numbers.select(*keys, F.inline(F.array(N.parse_number(F.col(text), base))))
    rows = parsed.select(
        *keys, "negative", "whole", "part",
        N.short_value(c("whole"), base).alias("whole_value"),
        N.short_value(c("part"), base, 54).alias("part_value"),
        N.part_scale(c("part"), base).alias("under"),
    ).select("*", F.explode(F.when(c("whole").isNotNull(), N.targets())).alias("to"))
    # Two rounds of digits are columns, which are compiled; a fraction that needs more is walked.
    # Numbers come before texts, so that no step is too long a method to be compiled.
    kept = [*keys, "negative", "whole", "part", "whole_value", "part_value", "under", "to"]
    first = rows.select(*kept, N.part_room(c("under"), to).alias("room")).select(
        *kept, (2 * c("room") >= limit).alias("short"), F.least(c("room"), F.lit(limit)).alias("n1"), (limit - F.least(c("room"), F.lit(limit))).alias("left"))
    one = first.select(*kept, "short", "n1", F.least(c("n1"), c("left")).alias("n2"), (c("part_value") * N.part_power(c("n1"), to)).alias("top")).select(
        *kept, "short", "n1", F.call_function("div", c("top"), c("under")).alias("d1"), (c("top") % c("under")).alias("rest"), "n2")
    two = one.select(*kept, "short", "n1", "d1", "n2", (c("rest") * N.part_power(c("n2"), to)).alias("top")).select(
        *kept, "short", "n1", "d1", "n2", F.call_function("div", c("top"), c("under")).alias("d2"), (c("top") % c("under")).alias("rest"))
    # Zeros of a round that had nothing left to write go with the others at the end of an exact fraction.
    spelled = F.concat(N.part_spelled(c("d1"), c("n1"), to), F.when(c("n2") > 0, N.part_spelled(c("d2"), c("n2"), to)).otherwise(""))
    written = two.select(
        *keys, "to.base", "negative",
        N.whole_text(c("whole_value"), c("whole"), base, to).alias("w"),
        F.when(c("short") & (F.size("part") > 0), N.part_done(c("rest"), spelled, to)).otherwise(
            N.part_text(c("part_value"), c("under"), c("part"), base, to, limit)).alias("f"),
    )
    has_part = c("f.digits").rlike("[^0:]") | ~c("f.exact")
    minus = F.when(c("negative") & ((c("w") != "0") | has_part), "-").otherwise("")
    behind = lambda digits: F.when(has_part, F.concat(F.lit("."), digits)).otherwise("")
    return written.select(
        *keys, "base",
        F.concat(minus, c("w"), behind(c("f.digits"))).alias("value"),
        c("f.exact").alias("is_exact"),
        F.concat(minus, N.group_whole(c("w"), c("base")), behind(N.group_part(c("f.digits"), c("base")))).alias("display"),
    )


def number_quality(numbers: DataFrame, text: str, base: str) -> DataFrame:
    """Numbers per base and reason of refusal; blank input is no error."""
    fault = N.by_base(F.col(base), lambda b: N.number_fault(F.col(text), b))
    blank = F.when(F.col(text).isNull() | (trim_space(F.col(text)) == ""), "blank")
    reason = F.coalesce(fault, blank, F.lit("ok"))
    return numbers.groupBy(base, reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def positional_value(digits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Value of digits in rows: whole digits have positions from 0 up, fraction digits from -1 down.

    Decimals of 38 digits bound the result; a value past them fails and is never wrong.
    """
    def power(exponent: Column) -> Column:
        one = F.lit(1).cast("decimal(38,0)")
        steps = F.slice(F.sequence(F.lit(1), F.greatest(exponent, F.lit(1))), F.lit(1), exponent)
        return F.aggregate(steps, one, lambda acc, _: (acc * F.col("base")).cast("decimal(38,0)"))

    depth = digits.groupBy(*keys).agg(F.max(F.greatest(-F.col("position"), F.lit(0))).alias("__depth"))
    rows = digits.hint("merge").join(depth, list(keys))
    up = F.when(F.col("position") >= 0, F.col("position")).otherwise(0)
    down = F.when(F.col("position") < 0, F.col("__depth") + F.col("position")).otherwise(0)
    whole = F.when(F.col("position") >= 0, F.col("digit") * power(up)).otherwise(0)
    part = F.when(F.col("position") < 0, F.col("digit") * power(down)).otherwise(0)
    return (
        rows.groupBy(*keys)
        .agg(
            F.sum(whole.cast("decimal(38,0)")).alias("integer"),
            F.sum(part.cast("decimal(38,0)")).alias("numerator"),
            F.max(power(F.col("__depth"))).alias("denominator"),
        )
    )


_LIMB = 6  # decimal digits of a limb: sums of billions of them fit 64 bits


def _powers(exponents: DataFrame) -> DataFrame:
    """``base, exponent, limb, value``: powers of each base up to its largest exponent, as
    limbs of six decimal digits from the lowest up, without those that are zero."""
    def run(frames):
        import pandas as pd

        for frame in frames:
            for base, most in zip(frame["base"].tolist(), frame["most"].tolist()):
                power, out = 1, []
                for exponent in range(most + 1):
                    text = str(power)
                    limbs = [int(text[max(0, end - _LIMB) : end]) for end in range(len(text), 0, -_LIMB)]
                    out += [(base, exponent, k, v) for k, v in enumerate(limbs) if v]
                    power *= base
                    if len(out) > 100_000 or exponent == most:
                        yield pd.DataFrame(out, columns=["base", "exponent", "limb", "value"])
                        out = []

    def unlimited(frames):
        import sys

        # Python refuses to write numbers of more than 4300 digits unless told otherwise.
        if hasattr(sys, "set_int_max_str_digits"):
            sys.set_int_max_str_digits(0)
        return run(frames)

    most = exponents.groupBy("base").agg(F.max("exponent").cast("int").alias("most"))
    return most.mapInPandas(unlimited, "base int, exponent int, limb int, value long")


def _carried(limbs: str) -> Column:
    """The number whose limb sums these are, as text: carries are resolved from the lowest up."""
    sums = F.map_from_entries(F.col(limbs))
    every = F.transform(F.sequence(F.lit(0), F.array_max(F.col(limbs)["limb"])), lambda k: F.coalesce(F.get(F.map_values(F.map_filter(sums, lambda i, _: i == k)), F.lit(0)), F.lit(0)))
    start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.lit("").alias("text"))
    unit = 10**_LIMB

    def step(acc, x):
        total = acc["carry"] + x
        return F.struct(F.floor(total / unit).alias("carry"), F.concat(F.lpad((total % unit).cast("string"), _LIMB, "0"), acc["text"]).alias("text"))

    done = F.aggregate(every, start, step)
    text = F.regexp_replace(F.concat(done["carry"].cast("string"), done["text"]), "^0+(?=[0-9])", "")
    return text


def positional_text(digits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, integer, numerator, denominator`` as decimal text: the value of digits in rows, for
    any number of digits and any base.

    Rows are ``keys, position, digit, base``; whole digits have positions from 0 up, fraction
    digits from -1 down, and a key has one base. A digit times a power of its base is a few
    limbs; limbs are summed like any other column, with partial sums before the shuffle, so
    the digits of one number may be spread over all tasks. Carries are resolved once, on the
    limbs of a number. Positions that are missing count as zero, repeated ones add up; rows without a
    position or a digit are left out.
    """
    known = digits.where("position IS NOT NULL AND digit IS NOT NULL").withColumn("base", F.col("base").cast("int"))
    depth = known.groupBy(*keys).agg(F.max(F.greatest(-F.col("position"), F.lit(0))).cast("int").alias("depth"), F.max("base").alias("base"))
    part = F.col("position") < 0
    # Rows made by an explode are estimated at the size of what they came from, and would be
    # broadcast for it; the digits stay where they are.
    placed = known.drop("base").hint("merge").join(depth, list(keys)).select(
        *keys, "base", F.when(part, 1).otherwise(0).alias("side"), F.when(part, F.col("depth") + F.col("position")).otherwise(F.col("position")).cast("int").alias("exponent"),
        F.col("digit").cast("bigint").alias("digit"),
    )
    whole = depth.select(*keys, "base", F.lit(2).alias("side"), F.col("depth").alias("exponent"), F.lit(1).cast("bigint").alias("digit"))
    terms = placed.unionByName(whole)
    limbs = terms.join(_powers(terms.select("base", "exponent")), ["base", "exponent"]).groupBy(*keys, "side", "limb").agg(F.sum(F.col("value") * F.col("digit")).alias("total"))
    listed = limbs.groupBy(*keys, "side").agg(F.sort_array(F.collect_list(F.struct("limb", "total"))).alias("limbs"))
    texts = listed.select(*keys, "side", _carried("limbs").alias("text"))
    side = lambda k, name: F.coalesce(F.max(F.when(F.col("side") == k, F.col("text"))), F.lit("0")).alias(name)
    return texts.groupBy(*keys).agg(side(0, "integer"), side(1, "numerator"), side(2, "denominator"))


def cell_types(cells: DataFrame, column: str, text: str) -> DataFrame:
    """How many cells of each column hold numbers, and what they add up to."""
    number = N.cell_number(F.col(text))
    return cells.withColumn("__n", number).groupBy(column).agg(
        F.count(F.lit(1)).alias("cells"),
        F.count("__n").alias("numeric"),
        F.bround(F.count("__n") / F.count(F.lit(1)), 6).alias("share"),
        F.sum(F.bround(F.col("__n") * 100).cast("bigint")).alias("cents"),
    )


def column_widths(cells: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    wide = F.max(F.length(text)) * 1.15 + 2.0
    return cells.groupBy(*keys).agg(F.bround(F.least(F.greatest(wide, F.lit(9.0)), F.lit(70.0)), 2).alias("width"))


def proportional_shares(items: DataFrame, keys: Sequence[str], weight: str, total: int, least: int = 400) -> DataFrame:
    """Split a total by weight; bad weights count as 0, all-zero groups are split evenly."""
    value = F.when((F.col(weight) > 0) & ~F.isnan(weight), F.col(weight)).otherwise(0.0)
    sums = items.groupBy(*keys).agg(F.sum(value).alias("__sum"), F.count(F.lit(1)).alias("__n"))
    share = F.when(F.col("__sum") > 0, total * value / F.col("__sum")).otherwise(F.lit(float(total)) / F.col("__n"))
    return items.join(sums, list(keys)).withColumn(
        "share", F.greatest(F.lit(least), F.bround(share).cast("int"))
    ).drop("__sum", "__n")
