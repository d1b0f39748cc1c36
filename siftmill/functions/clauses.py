"""One grammar for notes and questions: a label, a link, a value.

Every place where a label begins is a mark: the label, and what follows it in its clause. Marks are found in one pass over
the text, whatever the number of labels; fields are then read from the few marks, not from the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftmill.functions.bind import let

#: What ends a clause, on folded text.
ENDS = ",。;"
#: What may stand between a label and its value.
LINK = r"(?:为|是|:)?"
CODE = r"[A-Za-z0-9][A-Za-z0-9_.-]*+"
COUNT = r"\d++"
PHRASE = rf"[^{ENDS}]++"


@dataclass(frozen=True)
class Told:
    """Labels (a blank in one is any blanks or none) and the kind of value that follows them. With ``apart`` a label that
    ends in a Latin letter isn't the beginning of a longer word; ``remark`` lets a bracket stand behind the label."""

    labels: tuple[str, ...]
    value: str
    link: str = LINK
    apart: bool = False
    remark: bool = False

    def keys(self) -> tuple[str, ...]:
        return tuple(label.replace(" ", "").lower() for label in self.labels)

    def pattern(self) -> str:
        return ("^" + ("(?![A-Za-z])" if self.apart else "") + r"\s*+" + (r"(?:\([^)]*+\)\s*+)?" if self.remark else "") + self.link + r"\s*+(" + self.value + ")").replace("\\s*+\\s*+", "\\s*+")


Grammar = Mapping[str, Sequence[Told]]


def _alternatives(labels: set[str]) -> str:
    return "|".join(r"\s*".join(map(re.escape, x.split(" "))) for x in sorted(labels, key=lambda x: (-len(x), x)))


def marks(text: Column, grammar: Grammar) -> Column:
    """ARRAY<STRUCT<label, rest>> of a folded text, in its order; the longest label of each place."""
    labels = {label for told in grammar.values() for t in told for label in t.labels}
    firsts = "".join(sorted({c for label in labels for c in (label[0].lower(), label[0].upper())}))
    some = _alternatives(labels)
    found = F.regexp_extract_all(text, F.lit(rf"(?is)(?=[{firsts}])(?=((?:{some})[^{ENDS}]*+))."), 1)

    def cut(mark: Column) -> Column:
        return let(F.regexp_extract(mark, f"(?i)^(?:{some})", 0), lambda x: F.struct(F.lower(F.regexp_replace(x, r"\s+", "")).alias("label"), F.substring(mark, F.length(x) + 1, F.length(mark)).alias("rest")))

    return F.transform(found, cut)


def first_value(found: Column, told: Told) -> Column:
    """The value behind the first mark of these labels that has one; NULL if none has."""
    own = F.filter(found, lambda m: m["label"].isin(*told.keys()))
    values = F.transform(own, lambda m: F.regexp_extract(m["rest"], "(?i)" + told.pattern(), 1))
    return F.get(F.filter(values, lambda v: v != ""), F.lit(0))


def read(text: Column, grammar: Grammar, body: Callable[[dict[str, Column]], Column]) -> Column:
    """``body`` of the value of each field of a folded text: of a field's rules the first that has one."""
    return let(marks(text, grammar), lambda m: body({f: F.coalesce(*[first_value(m, t) for t in told]) for f, told in grammar.items()}))


def before(text: Column, labels: Sequence[str]) -> Column:
    """The code that stands in front of the first of these labels that has one."""
    parts = F.split(text, f"(?i)(?:{_alternatives(set(labels))})")
    tail = r"(?<![A-Za-z0-9_.-])[_.-]*+(" + CODE + r")\s*+$"
    return let(parts, lambda p: F.get(F.filter(F.transform(F.slice(p, 1, F.size(p) - 1), lambda x: F.regexp_extract(x, tail, 1)), lambda v: v != ""), F.lit(0)))
