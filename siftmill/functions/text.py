"""Column expressions on text that stay inside the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of other scripts that look like a Latin letter, and that letter.
CYRILLIC_LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j",
    "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
}
GREEK_LOOKALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x",
}
# Hyphens and minus signs that stand for the common hyphen in codes.
HYPHENS = "\u2010\u2011\u2012\u2212\ufe63\uff0d"
# Spaces other than U+0020.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
# Characters without a shape of their own.
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff"
# How a missing value is written, in lower case.
PLACEHOLDERS = ("", "unknown", "unknown_dn", "未知", "nan", "—")


def wide_pairs() -> dict[str, str]:
    """Full-width forms of ASCII, by their fixed distance."""
    return {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}


def radical_pairs() -> dict[str, str]:
    """Radicals and compatibility ideographs, from their decompositions."""
    out = {}
    for first, last in ((0x2E80, 0x2FD5), (0xF900, 0xFAD9)):
        for code in range(first, last + 1):
            plain = unicodedata.normalize("NFKC", chr(code))
            if plain != chr(code) and len(plain) == 1:
                out[chr(code)] = plain
    return out


@lru_cache
def code_table() -> tuple[str, str]:
    pairs = wide_pairs() | radical_pairs() | CYRILLIC_LOOKALIKES | GREEK_LOOKALIKES
    pairs |= {c: "-" for c in HYPHENS} | {c: " " for c in SPACES}
    return "".join(pairs), "".join(pairs.values())


def fold_code(text: Column) -> Column:
    """A copy of ``text`` for matching codes and labels: full-width, look-alike and hidden
    characters replaced one for one or removed. It isn't meant to be shown. NULL stays NULL."""
    source, target = code_table()
    return F.translate(text, source + INVISIBLE, target)


#: Blanks of any kind at either end.
OUTER_BLANKS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def strip(text: Column) -> Column:
    """``text`` without outer blanks of any kind."""
    return F.regexp_replace(text, OUTER_BLANKS, "")


def is_missing(text: Column) -> Column:
    """True for NULL, blanks and any spelling of a placeholder; ``无`` is a value."""
    return F.lower(strip(F.coalesce(text, F.lit("")))).isin(*PLACEHOLDERS)


def present(text: Column) -> Column:
    """``text`` or NULL where it is missing."""
    return F.when(~is_missing(text), text)


# Spark's \d and \w are ASCII; the value is folded before they see it.
DN_PATTERN = r"(?i)DN[-_\s]*(\d{8})[-_\s]+(\d{2,})"


def dn_of(text: Column, folded: bool = False) -> Column:
    """The record number of a value, ``DN-yyyymmdd-nn``, or NULL."""
    plain = text if folded else fold_code(text)
    day = F.regexp_extract(plain, DN_PATTERN, 1)
    return F.when(day != "", F.concat(F.lit("DN-"), day, F.lit("-"), F.regexp_extract(plain, DN_PATTERN, 2)))
