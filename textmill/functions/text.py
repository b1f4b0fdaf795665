"""Scalar functions over text columns."""

import json
import unicodedata
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import profiles as P

ZERO_WIDTH = "\u200b\u200c\u200d\ufeff\u00ad"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def nfc(c: Column) -> Column:
    """Canonical composition, which needs Python."""
    return _nfc(c)


# -- cleaner of crawled pages
def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", " ")


def ascii_quotes(c: Column) -> Column:
    return F.translate(c, "«»“”‘’", "\"\"\"\"''")


def em_dashes(c: Column) -> Column:
    return F.translate(c, "–—―", "———")


def drop_zero_width(c: Column) -> Column:
    return F.translate(c, ZERO_WIDTH, "")


def squeeze_spaces(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, " {2,}", " "), "\n{3,}", "\n\n")


def clean_page(c: Column, compose: bool = True) -> Column:
    c = strip_tags(c)
    c = nfc(c) if compose else c
    return strip(squeeze_spaces(drop_zero_width(em_dashes(ascii_quotes(c)))))


# -- cleaner of corpus texts
def strip_markup(c: Column) -> Column:
    return F.regexp_replace(strip_tags(c), "&[a-zA-Z]+;|&#[0-9]+;", " ")


def squeeze_blanks(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), "\n{3,}", "\n\n")


def guillemets(c: Column) -> Column:
    return F.translate(c, "“”\"", "«»«")


def en_dashes(c: Column) -> Column:
    return F.translate(c, "–—―−", "––––")


def drop_controls(c: Column) -> Column:
    """Drop category C but for the newline and the tab."""
    return F.regexp_replace(c, r"[^\P{C}\n\t]", "")


def layout(c: Column) -> Column:
    return F.translate(c, "Ёё", "Ее")


def correction_table(words: dict[str, str]) -> Column | None:
    """Corrections as a constant array of small maps, in which a word is sought by its checksum."""
    if not words:
        return None
    table: list[dict[str, str]] = [{} for _ in range(len(words))]
    for wrong, right in words.items():
        table[zlib.crc32(wrong.encode()) % len(table)][wrong] = right
    return F.from_json(F.lit(json.dumps(table, ensure_ascii=False)), T.ArrayType(T.MapType(T.StringType(), T.StringType())))


def correct_words(c: Column, words: Column | None) -> Column:
    """Each token through a table of corrections; tokens are joined by one space."""
    if words is None:
        return c
    right = lambda w: F.coalesce(F.try_element_at(F.get(words, (F.crc32(w) % F.size(words)).cast("int")), w), w)
    # ends are trimmed by the caller, so empty edge tokens do no harm
    return F.array_join(F.transform(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""), right), " ")


def clean_corpus(c: Column, words: Column | None = None) -> Column:
    c = layout(drop_controls(en_dashes(guillemets(squeeze_blanks(strip_markup(c))))))
    return strip(correct_words(c, words))


# -- sentences
def sentences(c: Column, profile: P.Profile = P.KAZAKH, join_abbreviations: bool = False) -> Column:
    """Array of sentences. With ``join_abbreviations`` a part that ends in a listed
    abbreviation and its mark is joined to the next."""
    flat = strip(F.regexp_replace(c, r"(?U)\s+", " "))
    parts = F.split(flat, rf"(?<=[.!?])\s+(?={profile.begins})")
    if join_abbreviations:
        ends = rf"(?iu)(?:^|\s)(?:{'|'.join(a.replace('.', chr(92) + '.') for a in P.ABBREVIATIONS)})\.$"
        parts = F.split(F.aggregate(parts, F.lit(""), lambda a, p: F.when(a == "", p).otherwise(F.concat(a, F.when(a.rlike(ends), " ").otherwise("\x1e"), p))), "\x1e")
    return F.filter(F.transform(parts, strip), lambda s: (s != "") & (F.length(s) >= profile.min_chars))


# -- anchors
def is_anchor(c: Column) -> Column:
    return c.rlike(P.ANCHOR)


def has_entity(c: Column, label: str) -> Column:
    return c.rlike("(?U)" + P.ENTITY_PATTERNS[label].replace("(?i)", "(?iu)"))


def is_indicative(c: Column) -> Column:
    return F.lower(c).rlike(rf"(?U)[а-яғқңүұөәі]+(?:{'|'.join(P.INDICATIVE)})\b")


def is_anchor_sentence(c: Column) -> Column:
    found = has_entity(c, "QUANTITY") | has_entity(c, "ORG") | has_entity(c, "PERSON") | has_entity(c, "LOC")
    return found & is_indicative(c)


def is_harmonic(c: Column) -> Column:
    return ~(F.lower(c).rlike(f"[{P.BACK_VOWELS}]") & F.lower(c).rlike(f"[{P.FRONT_VOWELS}]"))


def latin_to_cyrillic(c: Column) -> Column:
    return F.translate(F.regexp_replace(F.regexp_replace(c, "S[hH]", "Ш"), "sh", "ш"), P.LATIN, P.CYRILLIC)


def cyrillic_to_latin(c: Column) -> Column:
    return F.translate(F.replace(F.replace(c, F.lit("Ш"), F.lit("Sh")), F.lit("ш"), F.lit("sh")), P.CYRILLIC, P.LATIN)


# -- cells
def lemma(c: Column) -> Column:
    """Strip one case suffix if three characters stay."""
    return F.regexp_replace(c, f"(?ius)^(.{{3,}})(?:{'|'.join(P.SUFFIXES)})$", "$1")


@F.pandas_udf(T.StringType())
def _expand(s: pd.Series) -> pd.Series:
    import regex

    found = [(regex.compile(rf"(\d+(?:\.\d+)?)\s*{w}", regex.I), m) for w, m in P.NUMBER_WORDS.items()]

    def one(t):
        for pattern, m in found if t else ():
            t = pattern.sub(lambda x, m=m: str(int(float(x[1]) * m)), t)
        return t

    return s.map(one)


def spell_out(c: Column, exact: bool = True) -> Column:
    """Decimal comma to point, number words to digits. A cell that is one number with one word
    is computed in expressions; ``exact`` hands cells with more to Python."""
    dotted = F.regexp_replace(c, r"(\d+),(\d+)", "$1.$2")
    whole = r"(?iu)^\s*(\d+(?:\.\d+)?)\s*(" + "|".join(P.NUMBER_WORDS) + r")\s*$"
    word = F.lower(F.regexp_extract(dotted, whole, 2))
    times = F.coalesce(*[F.when(word == w, F.lit(float(m))) for w, m in P.NUMBER_WORDS.items()])
    value = F.regexp_extract(dotted, whole, 1).try_cast("double") * times
    rest = r"(?iu)\d\s*(?:" + "|".join(P.NUMBER_WORDS) + ")"
    many = _expand(dotted) if exact else dotted
    return strip(F.when(dotted.rlike(whole), value.cast("bigint").cast("string")).when(dotted.rlike(rest), many).otherwise(dotted))


def parse_number(c: Column) -> Column:
    """struct(raw, value, unit, is_percent), null where there is no number."""
    part = lambda i: F.regexp_extract(c, P.NUMBER, i)
    digits = F.replace(part(2), F.lit(" "), F.lit(""))
    unit = F.lower(part(4))
    percent = unit.isin("пайыз", "%")
    times = F.coalesce(*[F.when(unit == u, F.lit(m)) for u, m in P.UNITS.items()], F.lit(1.0))
    value = F.when(part(3) == "", digits).otherwise(F.concat(digits, F.lit("."), part(3))).try_cast("double")
    value = value * F.when(part(1) == "-", -1.0).otherwise(1.0) * F.when(percent, 1.0).otherwise(times)
    return F.when(c.rlike(r"\d") & value.isNotNull(), F.struct(part(0).alias("raw"), value.alias("value"), unit.alias("unit"), percent.alias("is_percent")))


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``c``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def fixed(v: Column, digits: int) -> Column:
    """A double with so many decimals, rounded as its exact binary value demands and ties to even, where
    Java's formatter rounds the shortest decimal that stands for it, ties up. The fraction is split in two halves
    of 26 bits, whose products with the scale are exact."""
    scale = 10.0**digits

    def halves(v: Column) -> Column:
        part = F.abs(v) - F.floor(F.abs(v))
        return F.struct((v < 0).alias("minus"), F.floor(F.abs(v)).alias("whole"), (F.floor(part * 2.0**26) / 2.0**26 * scale).alias("high"), ((part - F.floor(part * 2.0**26) / 2.0**26) * scale).alias("low"))

    def said(x: Column) -> Column:
        down = F.floor(x["high"])
        over = x["high"] - down - 0.5
        n = down + ((over > -x["low"]) | ((over == -x["low"]) & (down % 2 == 1))).cast("bigint")
        return let(n, lambda n: F.concat(F.when(x["minus"], "-").otherwise(""), (x["whole"] + F.floor(n / scale)).cast("string"), F.lit("."), F.lpad((n % int(scale)).cast("string"), digits, "0")))

    return let(let(v, halves), said)


def format_number(n: Column) -> Column:
    def shown(n: Column) -> Column:
        v = n["value"]
        plain = F.regexp_replace(F.regexp_replace(fixed(v, 4), "0+$", ""), r"\.$", "")
        return (
            F.when(n["is_percent"], F.concat(fixed(v, 1), F.lit("%"))).when(v >= 1e9, F.concat(fixed(v / 1e9, 2), F.lit(" млрд")))
            .when(v >= 1e6, F.concat(fixed(v / 1e6, 2), F.lit(" млн"))).when((v >= 1e3) & (n["unit"] == "мың"), F.concat(fixed(v / 1e3, 2), F.lit(" мың"))).otherwise(plain)
        )

    return let(n, lambda n: F.when(n.isNotNull(), shown(n)))


def temporal(c: Column) -> Column:
    """Quarters, months and years in ISO-like form."""
    for roman, number in (("III", 3), ("II", 2), ("IV", 4), ("I", 1)):
        c = F.regexp_replace(c, rf"(?U)\b{roman}\s+тоқсан\s+(20\d{{2}})\b", f"$1-Q{number}")
        c = F.regexp_replace(c, rf"(?U)\b{roman}\s+тоқсан\b", f"Q{number}")
    # other numerals, and none at all after a word, give quarter 0
    for other in ("I{1,3}V?", "V?I{0,3}"):
        c = F.regexp_replace(c, rf"(?U)\b{other}\s+тоқсан\s+(20\d{{2}})\b", "$1-Q0")
        c = F.regexp_replace(c, rf"(?U)\b{other}\s+тоқсан\b", "Q0")
    for number, month in enumerate(P.MONTHS, 1):
        c = F.regexp_replace(c, rf"(?iuU)\b{month}\s+(20\d{{2}}|19\d{{2}})\b", f"$1-{number:02d}")
    return strip(F.regexp_replace(c, r"(?U)\b(20\d{2}|19\d{2})\s*(?:жыл[ы]?|ж\.?)?\b", "$1"))


def normal_cell(c: Column) -> Column:
    return F.coalesce(format_number(parse_number(c)), temporal(c))


_SPAN = T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("label", T.StringType())])


@F.pandas_udf(T.ArrayType(_SPAN))
def entities(s: pd.Series) -> pd.Series:
    """Entity spans by pattern; of overlapping ones the first, then the longest."""
    import regex

    patterns = {k: regex.compile(p) for k, p in P.ENTITY_PATTERNS.items()}

    def one(t):
        found = sorted(((m.start(), -len(m[0]), i, k, m) for i, (k, p) in enumerate(patterns.items()) for m in p.finditer(t or "")), key=lambda x: x[:3])
        out, free = [], 0
        for start, _, _, label, m in found:
            if start >= free:
                out.append({"text": m[0], "start": start, "end": m.end(), "label": label})
                free = m.end()
        return out

    return s.map(one)
