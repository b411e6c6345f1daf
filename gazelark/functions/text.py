"""Scalar text functions as Column builders; nothing here runs Python on executors."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates the values of a compound or alias field.
BAR = "|"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Letters that a full-text index keeps although they decompose, and letter variants that it reads as the plain letter.
KEPT = "Ǡǡ"
VARIANTS = {"ſ": "s", "ẛ": "s", "ς": "σ", "ϐ": "β", "ϑ": "θ", "ϕ": "φ", "ϖ": "π", "ϰ": "κ", "ϱ": "ρ", "ϵ": "ε"}


@lru_cache
def fold_map(form: str = "NFD", latin_only: bool = True) -> tuple[str, str]:
    """Letters with diacritics and the plain letters they fold to, from Unicode's decompositions."""
    source, target = [], []
    for point in [*range(0xC0, 0x3000), *range(0xFF01, 0xFF5F)]:
        char = chr(point)
        base, *marks = unicodedata.normalize(form, char)
        folds = base != char and all(unicodedata.combining(m) for m in marks)
        if folds and (not latin_only or marks and base.isascii() and base.isalpha()):
            source.append(char)
            target.append(base)
    if latin_only:
        pairs = {k: v for k, v in zip(source, target, strict=True) if k not in KEPT} | VARIANTS
        source, target = list(pairs), list(pairs.values())
    return "".join(source), "".join(target)


def fold_diacritics(c: Column | str) -> Column:
    """Latin letters without their diacritics; ł, ø, æ and ß stay. Loose combining marks go. Case stays."""
    source, target = fold_map()
    c = _col(c)
    return _unless_ascii(c, F.regexp_replace(F.translate(c, source, target), r"\p{Mn}+", ""))


def _unless_ascii(c: Column, changed: Column) -> Column:
    """changed, but for texts of ASCII characters alone, which stay and needn't be walked through."""
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(changed)


_TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def tokens(c: Column | str) -> Column:
    """The index tokens of a text: runs of letters and numbers, folded and lower-cased. Null: none."""
    # folded before it is lowered, as a lowered dotted capital I would leave a mark behind
    return F.coalesce(F.regexp_extract_all(F.lower(fold_diacritics(c)), F.lit(_TOKEN), F.lit(0)), F.array().cast("array<string>"))


def py_tokens(text: str) -> list[str]:
    """tokens() of a literal, on the driver."""
    source, target = fold_map()
    folded = "".join(c for c in text.translate(str.maketrans(source, target)) if unicodedata.category(c) != "Mn").lower()
    out, run = [], ""
    for c in folded:
        if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co":
            run += c
        elif run:
            out.append(run)
            run = ""
    return [*out, run] if run else out


def clean(c: Column | str) -> Column:
    """Null for blank texts."""
    c = _col(c)
    return F.when(F.regexp_replace(c, r"\s+", "") != "", c)


def zero_padded(c: Column | str, width: int = 8) -> Column:
    """The number as text of at least width characters; wider numbers aren't cut, and a sign counts."""
    return F.format_string(f"%0{width}d", _col(c).cast("long"))


def split_bar(c: Column | str) -> Column:
    """The values of a bar-separated text; blank: none."""
    c = _col(c)
    return F.when(c.isNull() | (c == ""), F.array().cast("array<string>")).otherwise(F.split(c, r"\|", -1))


def join_bar(*cs: Column | str) -> Column:
    """The compound of values; a null counts as blank, so that places stay."""
    return F.concat_ws(BAR, *[F.coalesce(_col(c).cast("string"), F.lit("")) for c in cs])


def compound(c: Column | str, names: tuple[str, ...], strict: bool = False) -> Column:
    """A compound text as a struct. strict: exactly so many parts, else an error; otherwise missing and blank parts are null."""
    parts = F.split(_col(c), r"\|", -1)
    out = F.struct(*[F.get(parts, i).alias(n) if strict else F.nullif(F.get(parts, i), F.lit("")).alias(n) for i, n in enumerate(names)])
    if strict:
        return F.when(F.size(parts) == len(names), out).otherwise(F.raise_error(F.concat(F.lit(f"{len(names)} parts expected: "), _col(c))).cast(f"struct<{','.join(f'{n}:string' for n in names)}>"))
    return F.when(_col(c).isNotNull() & (_col(c) != ""), out)


def like(c: Column | str, pattern: str) -> Column:
    """SQL LIKE that folds the case of ASCII letters only."""
    body = "".join(".*" if x == "%" else "." if x == "_" else re.escape(x) for x in pattern)
    return _col(c).rlike(f"^(?is-u){body}$" if pattern.isascii() else f"^(?is){body}$")


def titled(c: Column | str) -> Column:
    """Each letter that follows no letter in upper case, the others in lower case."""
    return F.array_join(
        F.transform(F.regexp_extract_all(_col(c), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0)), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), ""
    )


def deduped(c: Column | str) -> Column:
    """One spelling for each text whatever its case: the shortest, of those the first; sorted."""
    c = _col(c)
    spellings = F.transform(c, lambda x, i: F.struct(F.lower(x).alias("k"), F.length(x).alias("n"), i.alias("i"), x.alias("v")))
    ordered = F.array_sort(spellings)
    first = F.filter(ordered, lambda x, i: (i == 0) | (F.get(ordered, i - 1)["k"] != x["k"]))
    return F.array_sort(F.transform(first, lambda x: x["v"]))


def decomposed(c: Column | str) -> Column:
    """Lower case without combining marks, ligatures and width forms taken apart."""
    source, target = fold_map("NFKD", False)
    c = _col(c)
    out = F.translate(c, source, target)
    for char, plain in (("ﬁ", "fi"), ("ﬂ", "fl"), ("Ĳ", "IJ"), ("ĳ", "ij"), ("ŉ", "ʼn"), ("Ǆ", "DZ"), ("ǆ", "dz"), ("Ǉ", "LJ"), ("ǉ", "lj"), ("Ǌ", "NJ"), ("ǌ", "nj")):
        out = F.replace(out, F.lit(char), F.lit(plain))
    return F.lower(_unless_ascii(c, F.regexp_replace(out, r"\p{M}+", "")))


# Letters that decomposition leaves and their ASCII spelling; the first two come before all else.
ASCII_LETTERS = {
    "ə": "a", "ǝ": "a", "ß": "ss", "æ": "ae", "Æ": "AE", "ø": "o", "Ø": "O", "œ": "oe", "Œ": "OE", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D",
    "þ": "th", "Þ": "Th", "ħ": "h", "Ħ": "H", "ı": "i", "ŧ": "t", "Ŧ": "T", "ŋ": "ng", "Ŋ": "NG", "ĸ": "k", "ʻ": "'", "ʼ": "'", "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "--",
}


def ascii_name(c: Column | str) -> Column:
    """A name in ASCII letters, as far as the table of letters goes; case stays; trimmed."""
    source, target = fold_map("NFKD", False)
    out = F.regexp_replace(F.translate(_col(c), source, target), r"\p{M}+", "")
    single = {k: v for k, v in ASCII_LETTERS.items() if len(v) == 1}
    out = F.translate(out, "".join(single), "".join(single.values()))
    for char, plain in ASCII_LETTERS.items():
        if len(plain) > 1:
            out = F.replace(out, F.lit(char), F.lit(plain))
    return F.trim(out)


def hash_id(*parts: Column | str) -> Column:
    """The first 8 bytes of the MD5 of the bar-joined parts, as an unsigned number (decimal(20,0))."""
    return F.conv(F.substring(F.md5(join_bar(*parts).cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)")


def is_latin(c: Column | str) -> Column:
    """Only letters of the Latin script, spaces, hyphens and apostrophes."""
    # one class, so that a long text takes no stack
    return ~_col(c).rlike("[^[\\p{IsLatin}&&[^ªº\\x{2071}\\x{207F}\\x{2090}-\\x{209C}]] '’-]")


# Words for a direction, and words for a kind of place.
DIRECTIONS = ("north", "south", "east", "west", "northern", "southern", "eastern", "western", "upper", "lower", "central")
PLACE_KINDS = ("okrug", "oblast", "kray", "kraj", "lan", "län", "rayon", "comuna", "district", "province", "region", "state", "shi", "sheng")


def _words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != "")


def directions_differ(a: Column | str, b: Column | str) -> Column:
    """Whether a direction is in one name and not in the other."""
    of = lambda c: F.array_intersect(_words(_col(c)), F.array(*map(F.lit, DIRECTIONS)))
    return (F.size(F.array_except(of(a), of(b))) + F.size(F.array_except(of(b), of(a)))) > 0


def without_kinds(c: Column | str) -> Column:
    """Lower-cased words without those for a kind of place."""
    return F.array_join(F.filter(F.split(F.lower(_col(c)), r"(?U)\W+"), lambda x: (x != "") & ~x.isin(*PLACE_KINDS)), " ")


def comparable(c: Column | str) -> Column:
    """A name as entity resolution compares it."""
    out = F.translate(F.lower(ascii_name(c)), "-_", "  ")
    return without_kinds(F.trim(F.translate(out, ",()[]\"'", "")))


def match_threshold(a: Column | str, b: Column | str) -> Column:
    """The ratio that two names must reach: 90, less for short names and for single words."""
    a, b = _col(a), _col(b)
    mean = (F.length(a) + F.length(b)) / 2
    short = F.when(mean <= 5, 15).when(mean <= 8, 10).when(mean <= 12, 5).otherwise(0)
    single = F.when(F.greatest(F.size(_words(a)), F.size(_words(b))) == 1, 5).otherwise(0)
    return F.lit(90) - short - single
