"""Normalising, expanding and cutting text into search tokens, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftmill.functions.bind import let
from siftmill.functions.text import fold_code

# A phrase in a query or text, and the word that is added for it.
SYNONYMS = {
    "右下角": "bottom right", "右下": "bottom right",
    "左下角": "bottom left", "左下": "bottom left",
    "右上角": "top right", "右上": "top right",
    "左上角": "top left", "左上": "top left",
    "中心": "center", "中央": "center", "中间": "center",
    "随机分布": "random", "随机": "random",
    "残留": "residue", "残渣": "residue",
    "划伤": "scratch", "刮伤": "scratch",
    "颗粒": "particle", "粒子": "particle",
    "机台": "machine", "扫描机": "machine",
    "批次": "lotid", "批号": "lotid",
}
# Words without meaning for a search.
STOPWORDS = ("查询", "查找", "帮我", "请", "一下", "相关", "记录", "信息", "异常", "哪些", "所有", "有没有", "对应")
CODE = r"[a-z0-9]+(?:[_.-][a-z0-9]+)*"


def sanitize(text: Column) -> Column:
    """Folded text without question and exclamation marks, blanks squeezed, case kept."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold_code(F.coalesce(text, F.lit(""))), "[?!]+", " "), r"\s+", " "))


def normalize(text: Column) -> Column:
    return F.lower(sanitize(text))


def expand(text: Column) -> Column:
    """Normal form and, behind it, the words of all phrases it contains."""
    return let(normalize(text), lambda plain: F.concat_ws(" ", plain, *[F.when(plain.contains(k), F.lit(v)) for k, v in SYNONYMS.items()]))


def tokens(text: Column) -> Column:
    """Codes kept whole and single Chinese characters as they come, then all pairs of neighbouring Chinese characters;
    as often as they stand there, without words that mean nothing. Two linear passes of a pattern, no step for each token."""
    ones = "".join(w for w in STOPWORDS if len(w) == 1)
    twos = "|".join(w for w in STOPWORDS if len(w) == 2)
    single = F.lit(rf"({CODE}|[\x{{4e00}}-\x{{9fff}}&&[^{ones}]])")
    # Look-ahead yields overlapping pairs.
    pairs = F.lit(rf"(?=((?!{twos})[\x{{4e00}}-\x{{9fff}}]{{2}})).")
    return let(expand(text), lambda full: F.concat(F.regexp_extract_all(full, single, 1), F.regexp_extract_all(full, pairs, 1)))


def char_pairs(text: Column) -> Column:
    """All overlapping pairs of characters, lower case, blanks and line breaks kept; none of a short text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?s)(?=(..))."), 1)


def keywords(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\s，,。]+"), lambda w: w != "")
