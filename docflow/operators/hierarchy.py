"""Style chains and outline numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.operators.ordered import running
from docflow.sources.placing import settle

# Longest chain followed, bullets by level, Roman digits.
CHAIN_LIMIT = 16
BULLETS = ("•", "◦", "▪")
ROMAN = (
    ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"),
    ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"),
    ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"),
    ("", "M", "MM", "MMM"),
)


def style_chain(
    styles: DataFrame, keys: Sequence[str], attrs: Sequence[str], default: DataFrame | None = None, order: str | None = None
) -> DataFrame:
    """Effective attributes of each style: the nearest value up its ``based_on`` chain.

    Chains double in length at each join, so sixteen steps take four joins whatever the
    depth. A chain ends before a style it has already met. ``default`` names one style per
    key whose chain fills what is still missing. Of styles of one id, whatever their case,
    the last by ``order`` counts (without one, the greatest by all columns).
    """
    keys = list(keys)
    low = lambda c: F.lower(F.col(c).cast("string"))
    whole = F.struct("style_id", "based_on", *attrs)
    last = F.max_by(whole, F.struct(*([order] if order else []), whole.alias("row")))
    # Every join reads the chains twice, so what they start from is written, and the chains once.
    styles = settle(styles.groupBy(*keys, low("style_id").alias("__low")).agg(last.alias("__s")).select(*keys, "__s.*"))
    links = styles.select(*keys, low("style_id").alias("__id"), low("based_on").alias("__next"))
    known = links.select(*keys, F.col("__id").alias("__next"), F.lit(True).alias("__known"))
    paths = links.join(known, [*keys, "__next"], "left").select(
        *keys, "__id", F.array("__id").alias("__path"), F.when(F.col("__known"), F.col("__next")).alias("__jump")
    )
    steps = 1
    while steps < CHAIN_LIMIT:
        ahead = paths.select(*keys, F.col("__id").alias("__jump"), F.col("__path").alias("__more"), F.col("__jump").alias("__far"))
        paths = paths.join(ahead, [*keys, "__jump"], "left").select(
            *keys, "__id", F.concat("__path", F.coalesce("__more", F.array().cast("array<string>"))).alias("__path"),
            F.col("__far").alias("__jump"),
        )
        steps *= 2
        if steps * steps == CHAIN_LIMIT:
            paths = settle(paths)
    # A loop repeats; what counts is the stretch before the first repetition.
    chain = paths.select(*keys, "__id", F.posexplode(F.array_distinct(F.slice("__path", 1, CHAIN_LIMIT))).alias("__depth", "__up"))
    values = styles.select(*keys, low("style_id").alias("__up"), *attrs)
    found = chain.join(values, [*keys, "__up"]).groupBy(*keys, "__id").agg(
        *(F.min_by(a, F.when(F.col(a).isNotNull(), F.col("__depth"))).alias(a) for a in attrs)
    )
    if default is not None:
        base = default.select(*keys, low("style_id").alias("__id")).join(found, [*keys, "__id"]).select(
            *keys, *(F.col(a).alias(f"__d_{a}") for a in attrs)
        )
        found = found.join(base, keys, "left").select(
            *keys, "__id", *(F.coalesce(a, f"__d_{a}").alias(a) for a in attrs)
        )
    named = styles.select(*keys, "style_id", low("style_id").alias("__id"))
    return named.join(found, [*keys, "__id"]).select(*keys, "style_id", *attrs)


def letters(value: Column, capital: bool = False) -> Column:
    """1 is a, 26 is z, 27 is aa; five letters hold more than ten million."""
    first = ord("A" if capital else "a")
    start = F.struct(value.cast("int").alias("rest"), F.lit("").alias("text"))

    def step(acc: Column, _: Column) -> Column:
        left = acc["rest"] - 1
        return F.when(acc["rest"] <= 0, acc).otherwise(
            F.struct(
                F.floor(left / 26).cast("int").alias("rest"),
                F.concat(F.char(F.lit(first) + left % 26), acc["text"]).alias("text"),
            )
        )

    spelled = F.aggregate(F.sequence(F.lit(1), F.lit(7)), start, step, lambda acc: acc["text"])
    return F.when(value <= 0, chr(first)).otherwise(spelled)


def roman(value: Column) -> Column:
    """1 to 3999 in Roman digits; other numbers stay decimal."""
    places = [
        F.get(F.array(*map(F.lit, digits)), (F.floor(value / 10**p) % 10).cast("int")) for p, digits in enumerate(ROMAN)
    ]
    return F.when(value.between(1, 3999), F.concat(*reversed(places))).otherwise(value.cast("string"))


def numeral(value: Column, form: Column) -> Column:
    kind = F.lower(form)
    return (
        F.when(kind == "lowerletter", letters(value))
        .when(kind == "upperletter", letters(value, True))
        .when(kind == "lowerroman", F.lower(roman(value)))
        .when(kind == "upperroman", roman(value))
        .otherwise(value.cast("string"))
    )


def outline_numbers(paragraphs: DataFrame, keys: Sequence[str], seq: str, levels: int = 9) -> DataFrame:
    """Marker of each list paragraph.

    A level counts on from its start until a shallower paragraph comes, which is a row number
    within the stretch between two shallower ones. Stretches and the last value of each level
    are running values of a document, so all passes share one shuffle.
    """
    keys = list(keys)
    form, level = F.lower("form"), F.col("level")
    counted = paragraphs.where(~form.isin("bullet", "none"))
    cuts = running(
        counted, keys, [seq], sums={f"__c{k}": (level < k).cast("int") for k in range(1, levels)}
    )
    stretch = F.coalesce(*(F.when(level == k, F.col(f"__c{k}")) for k in range(1, levels)), F.lit(0))
    placed = cuts.withColumn("__stretch", stretch).drop(*(f"__c{k}" for k in range(1, levels)))
    valued = running(placed, [*keys, "level", "__stretch"], [seq], number="__n").withColumn(
        "__value", (F.col("start") + F.col("__n") - 1).cast("int")
    ).drop("__n", "__stretch")
    valued = valued.withColumn("__own", numeral(F.col("__value"), F.col("form")))
    above = running(
        valued, keys, [seq],
        lasts={
            f"__v{k}": F.when(level <= k, F.struct(F.when(level == k, F.col("__value")).alias("v")))
            for k in range(levels)
        },
    )
    other = lambda k: F.when(level > k, F.coalesce(F.col(f"__v{k}")["v"], F.lit(1))).otherwise(1).cast("string")
    own = F.col("__own")

    def fill(token: Column) -> Column:
        out = F.when(~token.rlike(r"^%\d$"), token)
        for k in range(levels):
            out = out.when(token == f"%{k + 1}", F.when(F.col("level") == k, own).otherwise(other(k)))
        return out.otherwise("1")

    filled = F.array_join(F.transform(F.regexp_extract_all("template", F.lit(r"(?s)%\d|."), F.lit(0)), fill), "")
    marker = F.when(F.coalesce(F.col("template"), F.lit("")) == "", F.concat(own, F.lit("."))).otherwise(filled)
    numbered = above.select(*paragraphs.columns, marker.alias("marker"))
    bullet = F.get(F.array(*map(F.lit, BULLETS)), F.least(level, F.lit(len(BULLETS) - 1)).cast("int"))
    plain = paragraphs.where(form.isin("bullet", "none")).withColumn("marker", F.when(form == "bullet", bullet))
    return numbered.unionByName(plain)
