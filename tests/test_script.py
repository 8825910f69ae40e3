"""Transliteration: spelling rules, links, and a letter-by-letter check on random text."""

import random
import unicodedata

from pyspark.sql import functions as F

from docflow.functions import script as S
from docflow.operators import script as ops

TO_LATIN = [
    ("Ўзбек тили", "O'zbek tili"),
    ("қуш ғоз ҳаво", "qush g'oz havo"),
    ("чой ва шакар", "choy va shakar"),
    ("ёз юрт яхши", "yoz yurt yaxshi"),
    ("Эртага ер", "Ertaga yer"),
    ("поезд кетди", "poyezd ketdi"),
    ("милиция акция", "militsiya aksiya"),
    ("цирк", "sirk"),
    ("таъна объект", "ta'na obyekt"),
    ("фильм альбом", "film albom"),
    ("ШАҲАР Шаҳар Ш ЩИ", "SHAHAR Shahar Sh SHCHI"),
    ("ЎШ ЕР Ер ЕЕа", "O'SH YER Yer YEYea"),
    ("ъ еъе", " yeye"),
    ("сайт www.мисол.uz ва а@б.в е", "sayt www.мисол.uz va а@б.в ye"),
    ("(www.ер.uz ер", "(www.ер.uz yer"),
    ("12 + 3 = 15, да!", "12 + 3 = 15, da!"),
]
TO_CYRILLIC = [
    ("O'zbek tili", "Ўзбек тили"),
    ("qush g‘oz havo", "қуш ғоз ҳаво"),
    ("shahar choy", "шаҳар чой"),
    ("yo'l yog'och yaxshi yuk yer", "йўл ёғоч яхши юк ер"),
    ("eshik keldi", "эшик келди"),
    ("ma'no 'qosh' o''", "маъно 'қошъ ў'"),
    ("aktsiya tsirk ketsa aviatsion", "акция цирк кетса авиацион"),
    ("tsh ketshi", "цҳ кетши"),
    ("SHAHAR Shahar", "ШАҲАР Шаҳар"),
    ("http://a.uz/yo ko'r me@x.uz da", "http://a.uz/yo кўр me@x.uz да"),
    ("a.www.b.c da", "а.www.b.c да"),
]


def convert(spark, rows, column, style="ascii"):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, text string")
    return [r.out for r in frame.select("i", column(F.col("text")).alias("out")).orderBy("i").collect()]


def test_spelling_to_latin(spark):
    assert convert(spark, [c for c, _ in TO_LATIN], S.cyrillic_to_latin) == [lat for _, lat in TO_LATIN]


def test_spelling_to_cyrillic(spark):
    assert convert(spark, [lat for lat, _ in TO_CYRILLIC], S.latin_to_cyrillic) == [c for _, c in TO_CYRILLIC]


def test_typographic_apostrophes(spark):
    got = convert(spark, ["ўғ маъно"], lambda t: S.cyrillic_to_latin(t, "typographic"))
    assert got == ["oʻgʻ maʼno"]


def test_round_trip(spark):
    texts = ["Bugun havo iliq bo'ladi.", "Qishloqda yangi yo'l ochildi!", "Toshkent, 2-sentyabr", "G'alaba muborak"]
    back = convert(spark, texts, lambda t: S.cyrillic_to_latin(S.latin_to_cyrillic(t)))
    assert back == texts


# ---- the same rules, one letter at a time ------------------------------------------------

APOS = set(S.APOSTROPHES)
is_letter = lambda c: unicodedata.category(c).startswith("L")
is_digit = lambda c: unicodedata.category(c) == "Nd"
is_upper = lambda c: unicodedata.category(c) == "Lu"
SINGLE = dict(zip(S.CYRILLIC_SINGLE, S.LATIN_SINGLE))
LATIN = dict(zip(S.LATIN_LETTERS, S.LATIN_AS_CYRILLIC))


def starts(t, i):
    return i == 0 or not (is_letter(t[i - 1]) or is_digit(t[i - 1]) or t[i - 1] in APOS)


def link_at(t, i):
    if not starts(t, i) or t[i].isspace():
        return 0
    token = t[i:].split()[0]
    linked = "://" in token or token.lower().startswith("www.") or ("@" in token and "." in token)
    return len(token) if linked else 0


def slow_latin(t):
    out, i = [], 0
    while i < len(t):
        if n := link_at(t, i):
            out.append(t[i : i + n])
            i += n
            continue
        c, low = t[i], t[i].lower()
        before = t[i - 1].lower() if i else ""
        after = t[i + 1].lower() if i + 1 < len(t) else ""
        vowel = bool(before) and before in S.CYRILLIC_VOWELS
        if low == "е":
            word = "ye" if starts(t, i) or vowel or (before and before in "ъь") else "e"
        elif low == "ц":
            word = "ts" if vowel else "s"
        elif low == "ъ":
            word = "" if (after and after in "еёюя") or not (before and is_letter(before)) else "'"
        elif low == "ь":
            word = ""
        else:
            word = {"ў": "o'", "ғ": "g'", **S.CYRILLIC_DOUBLE, **SINGLE}.get(low)
        if word is None:
            word = c
        elif is_upper(c):
            if i + 1 < len(t) and is_letter(t[i + 1]):
                run = is_upper(t[i + 1])
            else:
                run = i > 0 and is_letter(t[i - 1]) and is_upper(t[i - 1])
            word = word.upper() if run else word[:1].upper() + word[1:]
        out.append(word)
        i += 1
    return "".join(out)


def slow_cyrillic(t):
    out, i = [], 0
    at = lambda j: t[j].lower() if j < len(t) else ""
    while i < len(t):
        if n := link_at(t, i):
            out.append(t[i : i + n])
            i += n
            continue
        low, pair, quoted = at(i), at(i) + at(i + 1), i + 1 < len(t) and t[i + 1] in APOS
        loan = starts(t, i) or t[i : i + 5].lower() in ("tsiya", "tsion")
        n, letter = 1, LATIN.get(low)
        if pair == "yo" and not (i + 2 < len(t) and t[i + 2] in APOS):
            n, letter = 2, "ё"
        elif pair in S.LATIN_DOUBLE:
            n, letter = 2, S.LATIN_DOUBLE[pair]
        elif pair == "ts" and loan:
            n, letter = 2, "ц"
        elif low in "og" and quoted:
            n, letter = 2, "ў" if low == "o" else "ғ"
        elif low == "e":
            letter = "э" if starts(t, i) else "е"
        elif t[i] in APOS and i and is_letter(t[i - 1]):
            letter = "ъ"
        out.append(t[i] if letter is None else letter.upper() if is_upper(t[i]) else letter)
        i += n
    return "".join(out)


def test_random_text_matches_letter_by_letter(spark):
    rng = random.Random(7)
    cyr = "аеёиоуўэюяыцъьбвшщчғқЕЁЦЪЬШЩЯАБЎ"
    lat = "aeouyshctgwxqzionAEOYSHCTG"
    both = ["".join(rng.choice(p) for _ in range(rng.randint(0, 14))) for p in [
        cyr + " .", lat + "'`ʻʼ‘ ", cyr + lat + "' -1@.ʻ", "Ее ЦцЪъаАzZ", "tsTSiyaonIYA 'o", "www.@:/ аеyoE"] * 400]
    both += [" ".join(w) for w in zip(both, reversed(both))] + ["x www.ё.a www.b (www.е http://е е@б.в"]
    got = convert(spark, both, S.cyrillic_to_latin)
    assert [(t, g) for t, g in zip(both, got) if g != slow_latin(t)] == []
    got = convert(spark, both, S.latin_to_cyrillic)
    assert [(t, g) for t, g in zip(both, got) if g != slow_cyrillic(t)] == []


def test_runs_get_back_their_own_pieces(spark):
    rows = [
        (1, "lat_to_cyr", 0, "O"), (1, "lat_to_cyr", 1, "'zbe"), (1, "lat_to_cyr", 2, "k s"), (1, "lat_to_cyr", 3, "hahar www.a"),
        (1, "lat_to_cyr", 4, ".uz da"), (2, "cyr_to_lat", 0, "Ў"), (2, "cyr_to_lat", 1, "збек"), (2, "cyr_to_lat", 2, "истон ъ"),
        (2, "cyr_to_lat", 3, ""), (2, "cyr_to_lat", 4, "Ш"), (2, "cyr_to_lat", 5, "аҳар www.ёб"), (2, "cyr_to_lat", 6, ".uz ер"),
    ]
    frame = spark.createDataFrame(rows, "p int, direction string, seq int, text string")
    got = {(r.p, r.seq): r.text for r in ops.convert_runs(frame, ["p"], "seq", "direction").collect()}
    assert [got[1, i] for i in range(5)] == ["Ў", "збе", "к ш", "аҳар www.a", ".uz да"]
    assert [got[2, i] for i in range(7)] == ["O'", "zbek", "iston ", "", "Sh", "ahar www.ёб", ".uz yer"]


def test_direction_follows_the_majority(spark):
    rows = spark.createDataFrame([("абв ab",), ("аб ab",), ("12 !",), ("abc а",)], "text string")
    n_cyr, n_lat = S.script_counts(F.col("text"))
    assert [r[0] for r in rows.select(S.direction_of(n_cyr, n_lat)).collect()] == [
        "cyr_to_lat", "lat_to_cyr", None, "lat_to_cyr"]
