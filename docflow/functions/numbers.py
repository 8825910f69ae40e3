"""Numbers in nine bases and numbers in spreadsheet cells, as Column expressions.

Digits travel in limbs: several digits of one base packed into one long. A conversion then
takes a few steps per limb, and holds for inputs of any accepted length.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from docflow.functions.text import SPACE, trim_space

# Bases, digit symbols, limits, group sizes of the display form.
BASES = (2, 4, 8, 10, 16, 32, 64, 128, 256)
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
MAX_SYMBOL_BASE = 32
MAX_INPUT = 512
FRACTION_LIMITS = (4, 64)
GROUP_SIZE = {2: 4, 4: 4, 16: 4, 8: 3, 10: 3}
# Digits per limb, so that the product of two limbs stays below 2^61.
LIMB_DIGITS = {2: 30, 4: 15, 8: 10, 10: 9, 16: 7, 32: 6, 64: 5, 128: 4, 256: 3}

_SPACER = rf"{SPACE}_'"
_LONGS = "array<bigint>"


def _body(text: Column) -> Column:
    return F.regexp_replace(trim_space(text), "^[-−+]", "")


def _digits(body: Column, base: int) -> tuple[Column, Column]:
    """Digit values before and after the separator of a number without faults."""
    if base <= MAX_SYMBOL_BASE:
        # Only bases above ten have letters.
        sides = F.split(F.regexp_replace(F.upper(body) if base > 10 else body, rf"[{_SPACER}]", ""), "[.,]")
        values = lambda side: F.transform(
            F.filter(F.split(side, ""), lambda c: c != ""), lambda c: (F.instr(F.lit(DIGITS), c) - 1).cast("bigint")
        )
    else:
        sides = F.split(body, "[.,]")
        values = lambda side: F.transform(
            F.filter(F.split(side, rf"[:{_SPACER}]+"), lambda g: g != ""),
            lambda g: F.right(g, F.lit(9)).try_cast("bigint"),
        )
    return values(F.get(sides, F.lit(0))), values(F.coalesce(F.get(sides, F.lit(1)), F.lit("")))


def number_fault(text: Column, base: int) -> Column:
    """Why a text is no number in ``base``, null for a number and for blank text.

    It is the first fault from left to right, as someone typing would meet it.
    """
    trimmed, body = trim_space(text), _body(text)
    if base <= MAX_SYMBOL_BASE:
        valid = rf"{DIGITS[:base]}{DIGITS[10:base].lower()}{_SPACER}"
        too_big = F.lit(False)
    else:
        valid = rf"0-9:{_SPACER}"
        groups = F.split(body, rf"[:.,{_SPACER}]+")
        bare = F.transform(groups, lambda g: F.regexp_replace(g, "^0+", ""))
        too_big = F.exists(bare, lambda g: (F.length(g) > 3) | (F.coalesce(g.try_cast("int"), F.lit(0)) >= base))
    return (
        F.when(text.isNull() | (trimmed == ""), None)
        .when(F.length(trimmed) > MAX_INPUT, "too_long")
        .when(body.rlike(rf"^[{valid}]*[.,][{valid}]*[.,]"), "two_separators")
        .when(body.rlike(rf"[^{valid}.,]"), "bad_digit")
        .when(too_big, "bad_digit")
        .when(~body.rlike("[0-9A-Za-z]"), "no_digits")
    )


def parse_number(text: Column, base: int) -> Column:
    """Sign and digits of a text in ``base``, or the reason it is no number."""
    reason = number_fault(text, base)
    ok = text.isNotNull() & (trim_space(text) != "") & reason.isNull()
    whole, part = _digits(_body(text), base)
    return F.struct(
        F.when(ok, trim_space(text).rlike("^[-−]")).alias("negative"),
        F.when(ok, whole).alias("whole"),
        F.when(ok, part).alias("part"),
        reason.alias("reason"),
    )


def _limbs(digits: Column, base: int, from_right: bool) -> Column:
    """Pack digits into limbs; whole numbers fill up on the left, fractions on the right."""
    size = LIMB_DIGITS[base]
    count = F.ceil(F.size(digits) / size).cast("int")
    pad = F.array_repeat(F.lit(0).cast("bigint"), count * size - F.size(digits))
    padded = F.concat(pad, digits) if from_right else F.concat(digits, pad)
    return F.transform(
        F.slice(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), F.lit(1), count),
        lambda k: F.aggregate(
            F.slice(padded, k * size + 1, F.lit(size)), F.lit(0).cast("bigint"), lambda acc, d: acc * base + d
        ),
    )


class Target(NamedTuple):
    """The base to write in, as columns: one expression serves all bases."""

    base: Column
    digits: Column  # per limb
    limb: Column  # base to the power of digits
    room: Column  # bits a limb surely holds
    bits: Column  # per digit, for the wide bases

    @property
    def wide(self) -> Column:
        return self.base > MAX_SYMBOL_BASE


def targets() -> Column:
    """All bases as an array of structs, one per base."""
    return F.array(
        *(
            F.struct(
                F.lit(b).alias("base"),
                F.lit(n).alias("digits"),
                F.lit(b**n).cast("bigint").alias("limb"),
                F.lit((b**n).bit_length() - 1).alias("room"),
                F.lit(b.bit_length() - 1).alias("bits"),
            )
            for b, n in LIMB_DIGITS.items()
        )
    )


def target(row: Column) -> Target:
    return Target(*(row[f] for f in Target._fields))


def _bits(base: int) -> int:
    """Bits that hold any digit of a base."""
    return (base - 1).bit_length()


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("bigint") if isinstance(b, int) else b)


def _groups(value: Column, count: Column, to: Target) -> Column:
    """``count`` digits of a wide base, highest first."""
    return F.transform(
        F.sequence(count - 1, F.lit(0)),
        lambda i: F.call_function("shiftright", value, i * to.bits).bitwiseAND((to.base - 1).cast("bigint")).cast("string"),
    )


def _symbols(limb: Column, to: Target) -> Column:
    """A limb as digits, one symbol each or values for the wide bases."""
    plain = F.split(F.lpad(F.call_function("conv", limb.cast("string"), F.lit(10), to.base), to.digits, F.lit("0")), "")
    return F.when(to.wide, _groups(limb, to.digits, to)).otherwise(plain)


def _join(symbols: Column, to: Target) -> Column:
    return F.when(to.wide, F.array_join(symbols, ":")).otherwise(F.array_join(symbols, ""))


def _turn(acc: Column, done: Column, out) -> Column:
    """One round of a long conversion; ``done`` is worked out once."""
    return F.get(F.transform(F.array(done), lambda d: F.struct(d["rest"].alias("rest"), out(acc, d).alias("out"))), F.lit(0))


def whole_symbols(digits: Column, base: int, to: Target) -> Column:
    """Digits of a whole number of any length: divide by a limb until nothing is left."""
    limb_from = base ** LIMB_DIGITS[base]

    def divide(rest: Column) -> Column:
        start = F.struct(F.array().cast(_LONGS).alias("rest"), F.lit(0).cast("bigint").alias("r"))

        def step(acc: Column, limb: Column) -> Column:
            value = acc["r"] * limb_from + limb
            return F.struct(F.concat(acc["rest"], F.array(_div(value, to.limb))).alias("rest"), (value % to.limb).alias("r"))

        return F.aggregate(rest, start, step)

    rounds = F.ceil(F.size(digits) * _bits(base) / to.room).cast("int")
    start = F.struct(_limbs(digits, base, True).alias("rest"), F.array().cast(_LONGS).alias("out"))
    made = F.aggregate(
        F.sequence(F.lit(1), F.greatest(rounds, F.lit(1))),
        start,
        lambda acc, _: _turn(acc, divide(acc["rest"]), lambda a, d: F.concat(F.array(d["r"]), a["out"])),
    )["out"]
    symbols = F.flatten(F.transform(made, lambda limb: _symbols(limb, to)))
    lead = F.array_position(F.transform(symbols, lambda s: s != "0"), True)
    return F.when(lead == 0, F.array(F.lit("0"))).otherwise(F.slice(symbols, lead.cast("int"), F.size(symbols)))


def part_symbols(digits: Column, base: int, to: Target, limit: int) -> Column:
    """Fraction digits, cut at the limit and never rounded, and whether that is exact:
    multiply by a limb, and what carries out is the next digits."""
    limb_from = base ** LIMB_DIGITS[base]

    def multiply(rest: Column) -> Column:
        start = F.struct(F.array().cast(_LONGS).alias("rest"), F.lit(0).cast("bigint").alias("carry"))

        def step(acc: Column, limb: Column) -> Column:
            value = limb * to.limb + acc["carry"]
            return F.struct(
                F.concat(F.array(value % limb_from), acc["rest"]).alias("rest"), _div(value, limb_from).alias("carry")
            )

        return F.aggregate(F.reverse(rest), start, step)

    start = F.struct(_limbs(digits, base, False).alias("rest"), F.array().cast(_LONGS).alias("out"))
    made = F.aggregate(
        F.sequence(F.lit(1), F.ceil(F.lit(limit) / to.digits).cast("int")),
        start,
        lambda acc, _: _turn(acc, multiply(acc["rest"]), lambda a, d: F.concat(a["out"], F.array(d["carry"]))),
    )
    symbols = F.flatten(F.transform(made["out"], lambda limb: _symbols(limb, to)))
    kept = F.slice(symbols, 1, limit)
    exact = ~F.exists(made["rest"], lambda v: v != 0) & ~F.exists(
        F.slice(symbols, limit + 1, F.greatest(F.size(symbols) - limit, F.lit(0))), lambda s: s != "0"
    )
    tail = F.array_position(F.transform(F.reverse(kept), lambda s: s != "0"), True)
    stripped = F.slice(kept, 1, F.when(tail == 0, 0).otherwise(F.size(kept) - tail + 1).cast("int"))
    return F.struct(F.when(exact, stripped).otherwise(kept).alias("symbols"), exact.alias("exact"))


def _value(digits: Column, base: int) -> Column:
    return F.aggregate(digits, F.lit(0).cast("bigint"), lambda acc, d: acc * base + d)


def short_value(digits: Column, base: int, bits: int = 60) -> Column:
    """Value of digits that surely stay below 2^bits, null for longer ones."""
    return F.when(F.size(digits) <= bits // _bits(base), _value(digits, base))


def _spelled(value: Column, count: Column, to: Target) -> Column:
    """``count`` digits of a wide base, as ``_groups``, joined: at most ten, as a value has at most 60 bits.
    Places are written out, as a lambda is not compiled."""
    digit = lambda i: F.call_function("shiftright", value, i * to.bits).bitwiseAND((to.base - 1).cast("bigint")).cast("string")
    return F.concat_ws(":", *(F.when(count > i, digit(F.lit(i))) for i in range(9, -1, -1)))


def whole_text(value: Column, digits: Column, base: int, to: Target) -> Column:
    """A whole number in another base; ``value`` is its short value where it has one."""
    places = F.greatest(F.ceil(F.length(F.bin(value)) / to.bits).cast("int"), F.lit(1))
    short = F.when(to.wide, _spelled(value, places, to)).otherwise(F.call_function("conv", value.cast("string"), F.lit(10), to.base))
    return F.when(value.isNotNull(), short).otherwise(_join(whole_symbols(digits, base, to), to))


def part_scale(digits: Column, base: int, bits: int = 54) -> Column:
    """The base to the power of how many digits a fraction has, null where it has no short value."""
    under = F.aggregate(digits, F.lit(1).cast("bigint"), lambda acc, _: acc * base)
    return F.when(F.size(digits) <= bits // _bits(base), under)


def part_width(under: Column) -> Column:
    """Bits of what is left of a fraction, at most."""
    return F.length(F.bin(under - 1))


def part_room(under: Column, to: Target) -> Column:
    """As many digits a round as surely fit: the rest is below ``under``."""
    return F.floor((63 - part_width(under)) / F.when(to.base == 10, 4).otherwise(to.bits)).cast("int")


def part_power(n: Column, to: Target) -> Column:
    tens = F.array(*(F.lit(10**n).cast("bigint") for n in range(16)))
    return F.when(to.base == 10, F.get(tens, n)).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), n * to.bits))


def part_spelled(value: Column, n: Column, to: Target) -> Column:
    """The next ``n`` digits of a fraction; those of a wide base each behind a colon."""
    return F.when(to.wide, F.concat(F.lit(":"), _spelled(value, n, to))).otherwise(
        F.call_function("lpad", F.call_function("conv", value.cast("string"), F.lit(10), to.base), n, F.lit("0"))
    )


def part_done(rest: Column, out: Column, to: Target) -> Column:
    """Digits and whether they are exact, from what is left and the digits spelled."""
    exact = rest == 0
    # Zeros at the end of an exact fraction carry no value.
    wide = F.substring(F.when(exact, F.regexp_replace(out, "(?::0)+$", "")).otherwise(out), 2, 1 << 30)
    plain = F.when(exact, F.rtrim(out, F.lit("0"))).otherwise(out)
    return F.struct(F.when(to.wide, wide).otherwise(plain).alias("digits"), exact.alias("exact"))


def part_text(value: Column, under: Column, digits: Column, base: int, to: Target, limit: int) -> Column:
    """Fraction digits in another base, and whether they are exact; ``value`` and ``under`` are its
    short value and scale where it has them."""
    def short_of(u: Column) -> Column:
        start = F.struct(value.alias("top"), F.lit(0).alias("done"), F.lit("").alias("out"))

        def step(acc: Column, _: Column) -> Column:
            n = F.least(u["room"], limit - acc["done"])
            shifted = acc["top"] * part_power(n, to)
            return F.when(acc["top"] == 0, acc).otherwise(
                F.struct(
                    (shifted % u["under"]).alias("top"), (acc["done"] + n).alias("done"),
                    F.concat(acc["out"], part_spelled(_div(shifted, u["under"]), n, to)).alias("out"),
                )
            )

        return F.aggregate(F.sequence(F.lit(1), F.ceil(F.lit(limit) / u["room"]).cast("int")), start, step)

    sized = F.array(F.struct(under.alias("under"), part_room(under, to).alias("room")))
    short = F.get(F.transform(F.transform(sized, short_of), lambda acc: part_done(acc["top"], acc["out"], to)), F.lit(0))
    long = F.get(
        F.transform(
            F.array(part_symbols(digits, base, to, limit)),
            lambda p: F.struct(_join(p["symbols"], to).alias("digits"), p["exact"].alias("exact")),
        ),
        F.lit(0),
    )
    none = F.struct(F.lit("").alias("digits"), F.lit(True).alias("exact"))
    return F.when(F.size(digits) == 0, none).when(value.isNotNull(), short).otherwise(long)


def by_base(base: Column, make) -> Column:
    """The expression made for the row's own base; a base outside the nine gives null."""
    chosen = F.when(base == BASES[0], make(BASES[0]))
    for b in BASES[1:]:
        chosen = chosen.when(base == b, make(b))
    return chosen


def fraction_limit(digits: int) -> int:
    return max(FRACTION_LIMITS[0], min(FRACTION_LIMITS[1], digits))


def _grouped(digits: Column, base: Column, by) -> Column:
    """Apply the grouping of the row's base; bases without one keep their digits."""
    fours = [b for b, n in GROUP_SIZE.items() if n == 4]
    threes = [b for b, n in GROUP_SIZE.items() if n == 3]
    return F.when(base.isin(fours), by(4)).when(base.isin(threes), by(3)).otherwise(digits)


def group_whole(digits: Column, base: Column) -> Column:
    """Blanks between groups counted from the right."""
    return _grouped(digits, base, lambda n: F.reverse(F.regexp_replace(F.reverse(digits), rf"(.{{{n}}})(?=.)", "$1 ")))


def group_part(digits: Column, base: Column) -> Column:
    """Blanks between groups counted from the left."""
    return _grouped(digits, base, lambda n: F.regexp_replace(digits, rf"(.{{{n}}})(?=.)", "$1 "))


def cell_number(text: Column) -> Column:
    """The number a cell holds, or null where it is text."""
    trimmed = trim_space(text)
    plain = F.regexp_replace(trimmed, rf"[{SPACE}]", "")
    digits = F.regexp_replace(trimmed, "^[+-]+", "")
    shape = (
        F.length(trimmed).between(1, 24)
        & trimmed.rlike(rf"^[\p{{Nd}}.,+{SPACE}-]+$")
        & trimmed.rlike(r"\p{Nd}")
        & ~digits.rlike("^0[^.,]")
    )
    last_comma = F.length(plain) - F.instr(F.reverse(plain), ",") + 1
    last_dot = F.length(plain) - F.instr(F.reverse(plain), ".") + 1
    comma, dot = plain.contains(","), plain.contains(".")
    no_dots = F.replace(F.replace(plain, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    no_commas = F.replace(plain, F.lit(","), F.lit(""))
    thousands = plain.rlike(r",.*,|,.{3}$") & ~plain.rlike("^[^,]*,.{0,2}$")
    cleaned = (
        F.when(comma & dot & (last_comma > last_dot), no_dots)
        .when(comma & dot, no_commas)
        .when(comma & thousands, no_commas)
        .when(comma, F.replace(plain, F.lit(","), F.lit(".")))
        .otherwise(plain)
    )
    return F.when(shape & cleaned.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"), cleaned.try_cast("double"))
