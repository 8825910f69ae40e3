"""Text rules as Column expressions: cleaning, list markers, font names, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"  # the same, one by one
# What opens a list item, and suffixes that are style and not family.
BULLETS = "•‣●○▪◦·⁃∙*"
DASHES = "-‐‒–—"
FONT_TAILS = ("PSMT", "PS", "MT")
FONT_STYLES = (
    "BoldItalic", "BoldOblique", "SemiBold", "ExtraBold", "DemiBold", "UltraBold",
    "Bold", "Italic", "Oblique", "Regular", "Roman", "Light", "Medium", "Black", "Heavy", "Thin",
)
DEFAULT_FONT = "Calibri"


def trim_space(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def collapse(text: Column) -> Column:
    """Runs of blanks to one space, no control characters, no blanks at the ends."""
    one = F.regexp_replace(F.coalesce(text, F.lit("")), rf"[{SPACE}]+", " ")
    return F.trim(F.regexp_replace(one, r"[\x{00}-\x{1F}\x{7F}-\x{9F}]", ""))


def paragraph_text(text: Column) -> Column:
    """Line breaks and other runs of blanks inside a paragraph to one space, none at its ends.
    What is no blank stays, control characters too; null is empty text."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), rf"[{SPACE}]+", " "))


def line_count(text: Column) -> Column:
    """Lines of a recognised paragraph: line feeds but for those at the end, and one."""
    body = F.rtrim(F.coalesce(text, F.lit("")), F.lit("\r\n"))
    feeds = F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit("")))
    return F.when(body.rlike(rf"[^{SPACE}]"), feeds + 1).otherwise(1).cast("int")


def names_style(font: Column, *words: str) -> Column:
    """Whether a font's name says that it is of a style."""
    low = F.lower(F.coalesce(font, F.lit("")))
    found = F.lit(False)
    for word in words:
        found = found | low.contains(word)
    return found


def cell_text(text: Column, limit: int = 32000) -> Column:
    """Text fit for a spreadsheet cell."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\r", "   ")
    return F.left(trim_space(F.regexp_replace(flat, r"[\x{00}-\x{1F}\x{7F}-\x{9F}]", "")), F.lit(limit))


def slide_text(text: Column, limit: int = 4000) -> Column:
    return F.left(collapse(text), F.lit(limit))


def shorten(text: Column, limit: int = 120) -> Column:
    """Cut to the limit with an ellipsis; short texts stay."""
    cut = F.concat(F.regexp_replace(F.left(text, F.lit(limit)), rf"[{SPACE}]+$", ""), F.lit("…"))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def is_list_item(text: Column) -> Column:
    return marker_kind(text).isNotNull()


def marker_kind(text: Column) -> Column:
    """bullet, dash, number, letter, or null for a line without a marker."""
    s = rf"[{SPACE}]"
    return (
        F.when(text.rlike(rf"^{s}*[{BULLETS}]"), "bullet")
        .when(text.rlike(rf"^{s}*[{DASHES}](?={s})"), "dash")
        .when(text.rlike(rf"^{s}*\(?\p{{Nd}}{{1,3}}{s}*[.)](?={s})"), "number")
        .when(text.rlike(rf"^{s}*\(?[a-zA-Zа-яА-Я]{s}*[.)](?={s})"), "letter")
    )


def font_family(raw: Column) -> Column:
    """Family name from a raw font name; blank names get the default."""
    name = F.regexp_replace(trim_space(raw), r"^[A-Z]{6}\+", "")
    name = F.regexp_replace(name, r"^([^,+_-]+)[,+_-].*$", "$1")
    # Tails come off the end in their order, so the one that comes off last stands first.
    tails = "".join(f"(?:{tail})?" for tail in reversed((*FONT_TAILS, *FONT_STYLES)))
    name = trim_space(F.regexp_replace(name, rf"(?<=.)(?=[A-Z]){tails}$", ""))
    # The name is worked out once, in an array of its own.
    spaced = lambda n: F.regexp_replace(n, rf"(?<=[^\p{{Lu}}{SPACE}])(?=\p{{Lu}})", " ")
    clean = F.get(F.transform(F.array(name), lambda n: F.when(n == "", DEFAULT_FONT).when(n.contains(" "), n).otherwise(spaced(n))), F.lit(0))
    return F.when(raw.isNull() | (trim_space(raw) == ""), DEFAULT_FONT).otherwise(clean)


def size_label(size: Column) -> Column:
    """Bytes as a label in steps of 1024, one digit above bytes."""
    kb = size / 1024.0
    step = lambda v, unit: F.concat(F.format_string("%.1f", v), F.lit(" " + unit))
    return (
        F.when(size < 0, None)
        .when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(kb < 1024, step(kb, "KB"))
        .when(kb < 1024.0**2, step(kb / 1024, "MB"))
        .otherwise(step(kb / 1024.0**2, "GB"))
    )


def column_letters(index: Column) -> Column:
    """0 is A, 25 is Z, 26 is AA; three letters cover every sheet."""
    letter = lambda v: F.char(F.lit(65) + v % 26)
    one = letter(index)
    two = F.concat(letter(F.floor(index / 26) - 1), one)
    three = F.concat(letter(F.floor((F.floor(index / 26) - 1) / 26) - 1), letter(F.floor(index / 26) - 1), one)
    return F.when(index < 26, one).when(index < 702, two).otherwise(three)


def extension(path: Column) -> Column:
    """The last dot and what follows it in the last part of a path, lower case."""
    return F.lower(F.regexp_extract(path, r"\.[^./\\]+$", 0))


def color_hex(r: Column, g: Column, b: Column) -> Column:
    """#RRGGBB of a colour in 0..1; near white and near black are the default colour."""
    byte = lambda v: F.lpad(F.hex(F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 255).cast("int")), 2, "0")
    light = (r >= 0.94) & (g >= 0.94) & (b >= 0.94)
    dark = (r <= 0.08) & (g <= 0.08) & (b <= 0.08)
    broken = F.isnan(r) | F.isnan(g) | F.isnan(b)
    return F.when(~(light | dark | broken), F.concat(F.lit("#"), byte(r), byte(g), byte(b)))
