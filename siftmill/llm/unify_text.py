"""One form for texts that look the same but differ in characters.

A text is split by quick-check properties into segments that are stable (no character in them can change)
and segments that aren't. Only the latter, with the boundary characters they may combine with, are
normalised; the canonical segments are spliced back between the untouched ones.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill.functions.text import CYRILLIC_LOOKALIKES, GREEK_LOOKALIKES, HYPHENS, INVISIBLE, SPACES, radical_pairs
from siftmill.session import spread

LOOKALIKES = CYRILLIC_LOOKALIKES | GREEK_LOOKALIKES
# Full-width signs that Chinese and Japanese text uses as its own punctuation.
OWN_PUNCTUATION = "！，：；？（）～"
#: A character of which one that looks alike may be meant is judged by the word it stands in.
_LATIN = regex.compile(r"\p{Latin}")
_WORD = r"[\p{Latin}\p{Cyrillic}\p{Greek}\p{M}\p{Nd}" + INVISIBLE + r"]"
#: Signs that join the words of one code.
_JOINERS = "_-./" + HYPHENS + "＿．／"
_RUN = regex.compile(rf"(?:{_WORD}|[{regex.escape(_JOINERS)}])+")
_WORDS = regex.compile(rf"{_WORD}+")


#: Characters that join or part the letters of some scripts and the parts of a picture.
_JOIN, _PART = "\u200d", "\u200c"
_SHAPED = regex.compile(
    r"[\p{Arabic}\p{Syriac}\p{Mandaic}\p{Nko}\p{Mongolian}\p{Phags_Pa}\p{Devanagari}\p{Bengali}\p{Gurmukhi}\p{Gujarati}\p{Oriya}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}\p{Khmer}\p{Myanmar}\p{Tibetan}]"
)
_PICTURE, _MARK = regex.compile(r"\p{Extended_Pictographic}"), regex.compile(r"[\p{M}\U0001F3FB-\U0001F3FF]")


@lru_cache
def single_changes() -> dict[str, str]:
    """Characters that are replaced wherever they stand, and what they become.

    Full-width letters, digits and code signs; half-width kana; letters and digits of mathematical styles, of ligatures
    and of Roman numerals, the micro sign; spaces but the common one; invisible characters; hyphens; radicals and
    compatibility ideographs. Chinese punctuation isn't among them.
    """
    out = {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F) if chr(c + 0xFEE0) not in OWN_PUNCTUATION}
    out |= radical_pairs()
    for code in (0xB5, *range(0x2160, 0x2180), *range(0xFB00, 0xFB07), *range(0xFF61, 0xFFDD), *range(0x1D400, 0x1D800)):
        plain = unicodedata.normalize("NFKC", chr(code))
        if plain != chr(code):
            out[chr(code)] = plain
    return out | {c: " " for c in SPACES} | {c: "" for c in INVISIBLE} | {c: "-" for c in HYPHENS}


@lru_cache
def compose_no() -> frozenset[str]:
    """Characters whose quick check for composition is No: they never stand in composed text (the unit
    signs among them)."""
    blocks = ((0xA0, 0x3400), (0xF900, 0xFB50), (0x10000, 0x12000), (0x16000, 0x17000), (0x1D100, 0x1D200), (0x2F800, 0x2FA20))
    return frozenset(c for a, b in blocks for c in map(chr, range(a, b)) if unicodedata.normalize("NFC", c) != c)


#: What may combine with the character before: marks, vowels and finals of Hangul, half-width voicing marks.
_AFTER = r"\p{M}\x{1160}-\x{11ff}\x{ff9e}\x{ff9f}"


@lru_cache
def unstable_class() -> str:
    """Body of a character class for both regex dialects: whatever may be part of an unstable segment.
    Text without any of it is in canonical form already."""
    chars = set(single_changes()) | compose_no() | set(LOOKALIKES)
    points = sorted(map(ord, chars))
    spans: list[list[int]] = []
    for p in points:
        if spans and p == spans[-1][1] + 1:
            spans[-1][1] = p
        else:
            spans.append([p, p])
    one = lambda p: f"\\x{{{p:x}}}"
    return _AFTER + r"\x{1100}-\x{115f}" + "".join(one(a) if a == b else f"{one(a)}-{one(b)}" for a, b in spans)


#: Most text has nothing but these, all of which are stable: the class of few ranges is tried first.
_COMMON = r"\x{0}-\x{9f}\x{4e00}-\x{9fff}\x{c0}-\x{17f}\x{3001}\x{3002}" + OWN_PUNCTUATION


def quick_check(text: Column) -> Column:
    """False only for text that surely needs no change; runs inside the JVM."""
    return text.rlike(f"[^{_COMMON}]") & text.rlike(f"[{unstable_class()}]")


def _python(body: str) -> str:
    return regex.sub(r"\\x\{([0-9a-f]+)\}", lambda m: regex.escape(chr(int(m[1], 16)), special_only=False), body)


@lru_cache
def _python_class() -> regex.Pattern:
    # A starter in front of what combines with it is the boundary context, also across what is removed between.
    return regex.compile(rf"(?:[^{_python(_AFTER)}](?=[{INVISIBLE}]*+[{_python(_AFTER)}]))?[{_python(unstable_class())}]+")


def _other_script(word: str) -> dict[str, str]:
    """For a word that belongs to another script than Latin, what Latin letters in it stand for; else
    nothing. The word is the other script's if more of its letters are surely that script's than are
    surely Latin; one Greek letter alone is a symbol (of a unit or a difference)."""
    cyrillic = bool(regex.search(r"\p{Cyrillic}", word))
    back = {v: k for k, v in (CYRILLIC_LOOKALIKES if cyrillic else GREEK_LOOKALIKES).items()}
    latin = sum(1 for c in word if _LATIN.match(c) and c not in back)
    other = sum(1 for c in word if c.isalpha() and not _LATIN.match(c) and c not in LOOKALIKES)
    return back if other > latin and (cyrillic or other > 1) else {}


def _shapes(text: str, at: int) -> bool:
    """Whether a joiner or non-joiner is seen: between the parts of a picture, or where letters join."""
    before = at - 1
    while before >= 0 and (text[before] in INVISIBLE or _MARK.match(text[before])):
        before -= 1
    after = at + 1
    while after < len(text) and text[after] in INVISIBLE:
        after += 1
    if before < 0 or after >= len(text):
        return False
    if _SHAPED.match(text[before]) and _SHAPED.match(text[after]):
        return True
    return text[at] == _JOIN and bool(_PICTURE.match(text[before]) and _PICTURE.match(text[after]))


def canonical(text: str) -> tuple[str, int]:
    """The canonical form and how many segments of the text had to change."""
    singles = single_changes()
    parts, end, changed = [], 0, 0
    for segment in _python_class().finditer(text):
        start, stop = segment.span()
        out = [c if c in (_JOIN, _PART) and _shapes(text, start + i) else singles.get(c, c) for i, c in enumerate(segment[0])]
        new = unicodedata.normalize("NFC", "".join(out))
        if new != segment[0]:
            changed += 1
            parts += (text[end:start], new)
            end = stop
    if changed:
        text = "".join((*parts, text[end:]))
    if not text.isascii() and _TWO_SCRIPTS.search(text):
        text, turned = _one_script(text)
        changed += turned
    return text, changed


_TWO_SCRIPTS = regex.compile(r"[\p{Cyrillic}\p{Greek}]")


def _one_script(text: str) -> tuple[str, int]:
    """Letters that look like one of the word's own script become that: in Latin words and codes Latin ones, in words of
    another script that script's. A letter that changes is composed anew with its marks."""
    swaps: dict[int, str] = {}
    turned = 0
    for run in _RUN.finditer(text):
        if not _TWO_SCRIPTS.search(run[0]):
            continue
        code = bool(regex.search(r"[\p{Latin}\p{Nd}]", run[0]))
        for word in _WORDS.finditer(text, run.start(), run.end()):
            latin = bool(_LATIN.search(word[0]))
            if back := _other_script(word[0]):
                own = {word.start() + i: back[c] for i, c in enumerate(word[0]) if latin and c in back}
            else:
                whole = all(c in LOOKALIKES for c in word[0] if c.isalpha())
                own = {word.start() + i: LOOKALIKES[c] for i, c in enumerate(word[0]) if (latin or (code and whole)) and c in LOOKALIKES}
            turned += bool(own)
            swaps |= own
    parts, end = [], 0
    for i, c in sorted(swaps.items()):
        stop = i + 1
        while stop < len(text) and unicodedata.combining(text[stop]):
            stop += 1
        parts += (text[end:i], unicodedata.normalize("NFC", c + text[i + 1 : stop]))
        end = stop
    return "".join((*parts, text[end:])), turned


def _unify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [(None, 0) if t is None else canonical(t) for t in batch.column("__text").to_pylist()]
        kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "__text"]
        names = [n for n in batch.schema.names if n != "__text"]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.int32())], [*names, "__new", "__changes"]
        )


def unify_text(rows: DataFrame, key: str, text: str, only_changed: bool = False, strip: bool = False) -> DataFrame:
    """``(key, text, changes)``: the canonical form of ``text`` and how many segments were changed.

    NULL stays NULL, an empty text stays empty, both with 0 changes; texts of any length are taken whole;
    repeated rows come out repeated; an empty table gives none. Line breaks, Chinese punctuation, Greek
    symbols and words wholly in another script stay. ``strip`` also drops outer blanks, for codes.
    ``only_changed`` returns just the rows with changes. Other columns aren't read. Texts that pass the quick
    check never leave the JVM.
    """
    pairs = spread(rows.select(F.col(key).alias("__key"), F.col(text).alias("__text")))
    schema = T.StructType([pairs.schema["__key"], T.StructField("__new", T.StringType()), T.StructField("__changes", T.IntegerType())])
    moved = pairs.where(quick_check(F.col("__text"))).mapInArrow(_unify, schema)
    if only_changed:
        out = moved.where(F.col("__changes") > 0)
    else:
        stay = pairs.where(~F.coalesce(quick_check(F.col("__text")), F.lit(False)))
        out = stay.select("__key", F.col("__text").alias("__new"), F.lit(0).alias("__changes")).unionByName(moved)
    new = F.regexp_replace("__new", r"^\s+|\s+$", "") if strip else F.col("__new")
    return out.select(F.col("__key").alias(key), new.alias("text"), F.col("__changes").alias("changes"))
