"""Uzbek Cyrillic and Latin letters as Column expressions.

Conversion is a short list of passes over the text. Every pass reads only letters of the
source script, so no pass sees what an earlier one wrote as if it were input, and all of
them stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CYR_TO_LAT = "cyr_to_lat"
LAT_TO_CYR = "lat_to_cyr"

# Apostrophe spellings, vowels, letter pairs.
APOSTROPHES = "'`´‘’ʹʻʼ′"
CYRILLIC_VOWELS = "аеёиоуўэюяы"
CYRILLIC_SINGLE = "абвгджзийклмнопрстуфхцэқҳые"
LATIN_SINGLE = "abvgdjziyklmnoprstufxseqhie"
CYRILLIC_DOUBLE = {"ё": "yo", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "yu", "я": "ya"}
LATIN_LETTERS = "abcdefghijklmnopqrstuvwxyz"
LATIN_AS_CYRILLIC = "абсдефгҳижклмнопқрстуввхйз"
LATIN_DOUBLE = {"ya": "я", "yu": "ю", "ye": "е", "sh": "ш", "ch": "ч"}
LETTER_APOSTROPHE = {"ascii": "'", "typographic": "ʻ"}
HARD_SIGN_APOSTROPHE = {"ascii": "'", "typographic": "ʼ"}

_BMP = r"&&[\x{0}-\x{FFFF}]"
_LETTER = rf"[\p{{L}}{_BMP}]"
_UPPER = rf"[\p{{Lu}}{_BMP}]"
_WORDISH = rf"[\p{{L}}\p{{Nd}}{APOSTROPHES}{_BMP}]"
_WORD_START = rf"(?<!{_WORDISH})"
_SPACE = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Marks that live only between two passes; Unicode keeps them out of interchanged text.
_SOFT, _CAPS, _PAD, _LINK = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"
_MARKS = _SOFT + _CAPS + _PAD + _LINK


def script_counts(text: Column) -> tuple[Column, Column]:
    """Letters in the Cyrillic block and ASCII Latin letters of a text."""
    # What is left once all else is taken out in long stretches; counting match by match
    # would build an array of every letter.
    return (
        F.length(F.regexp_replace(text, r"[^\x{0400}-\x{04FF}]+", "")),
        F.length(F.regexp_replace(text, "[^A-Za-z]+", "")),
    )


def direction_of(n_cyr: Column, n_lat: Column) -> Column:
    """The majority script decides; a tie reads as Latin, no letters as unknown."""
    return F.when(n_cyr > n_lat, CYR_TO_LAT).when(n_lat > 0, LAT_TO_CYR)


def _latin_words_to_cyrillic(text: Column, pad: str = "") -> Column:
    """``pad`` stands in for the second letter of a pair, to keep source positions.

    Patterns name their letter first and look back from behind it, so that what stands before
    is read at such letters only and not at every place of the text."""
    after_letter = rf"[{APOSTROPHES}](?<=[\p{{L}}&&[^oOgG]{_BMP}][{APOSTROPHES}])"
    text = F.regexp_replace(text, after_letter, "ъ")
    for low, cyr in (("e", "э"), ("E", "Э")):
        text = F.regexp_replace(text, f"{low}(?<!{_WORDISH}{low})", cyr)
    loan = "(?=[iI](?:[yY][aA]|[oO][nN]))"
    for low, cyr in (("t", "ц"), ("T", "Ц")):
        text = F.regexp_replace(text, f"{low}[sS](?:(?<!{_WORDISH}{low}[sS])|{loan})", cyr + pad)
    for low, cyr in (("o", "ў"), ("g", "ғ")):
        text = F.regexp_replace(text, f"{low}[{APOSTROPHES}]", cyr + pad)
        text = F.regexp_replace(text, f"{low.upper()}[{APOSTROPHES}]", cyr.upper() + pad)
    for first, cyr in (("y", "ё"), ("Y", "Ё")):
        text = F.regexp_replace(text, f"{first}[oO](?![{APOSTROPHES}])", cyr + pad)
    # Plain replacing is several times faster than a pattern, and pairs cannot overlap.
    for (one, two), cyr in LATIN_DOUBLE.items():
        for second in (two, two.upper()):
            text = F.replace(text, F.lit(one + second), F.lit(cyr + pad))
            text = F.replace(text, F.lit(one.upper() + second), F.lit(cyr.upper() + pad))
    return F.translate(
        text, LATIN_LETTERS + LATIN_LETTERS.upper(), LATIN_AS_CYRILLIC + LATIN_AS_CYRILLIC.upper()
    )


def _mark_cyrillic(text: Column, style: str) -> Column:
    """Mark every letter whose spelling depends on its neighbours; one unit per letter."""
    vowels = CYRILLIC_VOWELS + CYRILLIC_VOWELS.upper()
    # A mark before each е that reads "ye" and each ц that reads "ts".
    soft = rf"[еЕцЦ](?:(?<=[{vowels}][еЕцЦ])|(?<=[еЕ])(?:(?<=[ъьЪЬ].)|(?<!{_WORDISH}.)))"
    text = F.regexp_replace(text, soft, _SOFT + "$0")
    # A mark after each capital that spells two letters inside a run of capitals.
    doubles = "".join(CYRILLIC_DOUBLE).upper()
    run = (
        rf"[{doubles}ЕЦ](?<=[{doubles}]|{_SOFT}[ЕЦ])"
        rf"(?:(?={_SOFT}?{_UPPER})|(?<={_UPPER}[{doubles}]|{_UPPER}{_SOFT}[ЕЦ])(?!{_SOFT}?{_LETTER}))"
    )
    text = F.regexp_replace(text, run, "$0" + _CAPS)
    sign = rf"[ъЪ](?<=(?:{_LETTER}|{_CAPS})[ъЪ])(?!{_SOFT}?[еёюяЕЁЮЯ])"
    return F.regexp_replace(text, sign, HARD_SIGN_APOSTROPHE[style])


def _spell_latin(text: Column, style: str) -> Column:
    """Spell marked Cyrillic letters; no rule looks at a neighbour any more."""
    for cyr, first in (("Е", "Y"), ("Ц", "T")):
        text = F.replace(text, F.lit(_SOFT + cyr + _CAPS), F.lit(first + cyr))
        text = F.replace(text, F.lit(_SOFT + cyr), F.lit(first + cyr.lower()))
        text = F.replace(text, F.lit(_SOFT + cyr.lower()), F.lit(first.lower() + cyr.lower()))
    for cyr, lat in CYRILLIC_DOUBLE.items():
        text = F.replace(text, F.lit(cyr.upper() + _CAPS), F.lit(lat.upper()))
        text = F.replace(text, F.lit(cyr.upper()), F.lit(lat.title()))
        text = F.replace(text, F.lit(cyr), F.lit(lat))
    mark = LETTER_APOSTROPHE[style]
    for cyr, lat in (("ў", "o"), ("ғ", "g")):
        text = F.replace(text, F.lit(cyr), F.lit(lat + mark))
        text = F.replace(text, F.lit(cyr.upper()), F.lit(lat.upper() + mark))
    return F.translate(
        text,
        CYRILLIC_SINGLE + CYRILLIC_SINGLE.upper() + "ьЬъЪ",
        LATIN_SINGLE + LATIN_SINGLE.upper(),
    )


def _around_links(text: Column, words, link=lambda kept: kept) -> Column:
    """Apply ``words`` to everything but links and addresses, which stay as written.

    The text is cut only where a token that may be a link begins, so ordinary texts stay
    one piece.
    """
    pieces = F.split(text, rf"(?<![^{_SPACE}])(?=[^{_SPACE}]*(?:://|@|[wW]{{3}}\.))")
    www = rf"^(?:.*?(?<![\p{{L}}\p{{Nd}}{APOSTROPHES}{_BMP}]))??(?=[wW]{{3}}\.)"

    def convert(piece: Column) -> Column:
        token = F.regexp_extract(piece, rf"^[^{_SPACE}]*", 0)
        rest = F.substring(piece, F.length(token) + 1, F.length(piece))
        whole = token.contains("://") | (token.contains("@") & token.contains("."))
        head = F.regexp_extract(token, www, 0)
        linked = token.rlike(www)
        kept = F.substring(token, F.length(head) + 1, F.length(token))
        done = F.when(whole, link(token)).when(linked, F.concat(words(head), link(kept))).otherwise(words(token))
        return F.concat(done, words(rest))

    suspicious = text.rlike(r"://|@|[wW]{3}\.")
    return F.when(suspicious, F.array_join(F.transform(pieces, convert), "")).otherwise(words(text))


def _beside_marks(text: Column, convert) -> Column:
    """Apply ``convert`` to the stretches between characters that serve as marks here, which
    stay as they are. They are no letters, so nothing is spelled across them."""
    parts = F.regexp_extract_all(text, F.lit(rf"(?s)[{_MARKS}]+|[^{_MARKS}]+"), F.lit(0))
    done = F.transform(parts, lambda p: F.when(p.rlike(f"^[{_MARKS}]"), p).otherwise(convert(p)))
    return F.when(_marked(text), F.array_join(done, "")).otherwise(convert(text))


def _marked(text: Column) -> Column:
    """Whether a text holds a character that serves as a mark; looked for byte by byte."""
    return text.contains(_SOFT) | text.contains(_CAPS) | text.contains(_PAD) | text.contains(_LINK)


def latin_to_cyrillic(text: Column) -> Column:
    return _beside_marks(text, lambda part: _around_links(part, _latin_words_to_cyrillic))


def cyrillic_to_latin(text: Column, style: str = "ascii") -> Column:
    spelled = lambda part: _spell_latin(_mark_cyrillic(part, style), style)
    return _beside_marks(text, lambda part: _around_links(part, spelled))


def transliterate(text: Column, direction: Column, style: str = "ascii") -> Column:
    return F.when(direction == CYR_TO_LAT, cyrillic_to_latin(text, style)).otherwise(
        latin_to_cyrillic(text)
    )


def slice_converter(text: Column, direction: Column, style: str = "ascii"):
    """Convert a whole text once, then hand out the part that starts in [offset, offset+n).

    Returns the converted text in a form where every source position is still countable,
    and a function from that form and a position to the finished slice. Characters of the
    source that serve as marks here travel behind a mark of their own.
    """
    marked = _marked(text)
    text = F.when(marked, F.regexp_replace(text, f"([{_MARKS}])", _LINK + "$1")).otherwise(text)
    cyrillic = direction == CYR_TO_LAT
    units = F.regexp_extract_all(
        _around_links(text, lambda part: _mark_cyrillic(part, style), lambda link: F.regexp_replace(link, rf"(?s){_LINK}?(.)", _LINK + "$1")),
        F.lit(rf"(?s){_LINK}.|{_SOFT}?[^{_SOFT}{_LINK}{_CAPS}]{_CAPS}?"), F.lit(0),
    )
    padded = _around_links(text, lambda part: _latin_words_to_cyrillic(part, _PAD))
    letters = F.when(marked, F.regexp_extract_all(padded, F.lit(rf"(?s){_LINK}.|."), F.lit(0))).otherwise(F.split(padded, ""))
    aligned = F.when(cyrillic, units).otherwise(letters)

    def finish(cells: Column, offset: Column, n: Column) -> Column:
        joined = F.array_join(F.slice(cells, offset + 1, n), "")
        parts = F.regexp_extract_all(joined, F.lit(rf"(?s)(?:{_LINK}.)+|[^{_LINK}]+"), F.lit(0))
        spelled = F.transform(
            parts,
            lambda p: F.when(p.startswith(_LINK), F.regexp_replace(p, f"(?s){_LINK}(.)", "$1"))
            .otherwise(_spell_latin(p, style)),
        )
        return F.when(cyrillic, F.array_join(spelled, "")).otherwise(
            F.when(joined.contains(_LINK), F.regexp_replace(joined, f"(?s){_LINK}(.)|{_PAD}", "$1"))
            .otherwise(F.replace(joined, F.lit(_PAD), F.lit("")))
        )

    return aligned, finish
