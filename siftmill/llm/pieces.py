"""Oversized texts cut into pieces under a token limit, at natural boundaries, with an overlap.

Each token boundary of a text has a strength: paragraph, line, sentence, clause, blank, word, character. A sparse
table over the strengths answers, in constant time, which boundary of a window is the strongest (the rightmost
of equals). A piece ends at the strongest boundary its length allows; the next begins at the strongest one at
least the overlap before that end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill.llm.encode import VOCABULARY, Bpe, steps, tokenizer
from siftmill.session import spread

PARAGRAPH, LINE, SENTENCE, CLAUSE, BLANK, WORD, CHARACTER, NEVER = 6, 5, 4, 3, 2, 1, 0, -1
# Signs that end a sentence or a clause; the ASCII ones only before a blank.
ENDS, ENDS_ASCII = "。！？…｡", ".!?"
CLAUSES, CLAUSES_ASCII = "；：，、", ";:,"
CLOSERS = "”’」』）》】)\"']"
BLANKS = " \t\n\r\v\f  　"
#: Boundaries a sparse table spans at once; longer texts are indexed window by window.
TABLE_SPAN = 1 << 16


def _among(codes: np.ndarray, chars: str) -> np.ndarray:
    return np.isin(codes, np.array([ord(c) for c in chars], np.uint32))


def strengths(text: str) -> np.ndarray:
    """Strength of the boundary in front of each character and of the end."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.full(len(codes) + 1, CHARACTER, np.int8)
    if len(codes) < 2:
        return out
    blank, newline = _among(codes, BLANKS), codes == 10
    at, prev, nxt = out[1:-1], slice(None, -1), slice(1, None)
    at[(blank[nxt] & ~blank[prev]) | (blank[prev] & ~blank[nxt])] = BLANK
    ends = _among(codes, ENDS)
    ascii_end, ascii_clause = _among(codes, ENDS_ASCII), _among(codes, CLAUSES_ASCII)
    at[(_among(codes, CLAUSES)[prev]) | (ascii_clause[prev] & blank[nxt])] = CLAUSE
    done = ends[prev] | (ascii_end[prev] & blank[nxt])
    closer = _among(codes, CLOSERS)
    done[1:] |= closer[1:-1] & (ends[:-2] | (ascii_end[:-2] & blank[2:]))
    # Not between a closing quote and the sign that it follows.
    done &= ~(closer[nxt] | ends[nxt])
    at[done] = SENTENCE
    at[newline[prev]] = LINE
    empty = np.zeros(len(codes), bool)
    empty[1:] |= newline[1:] & newline[:-1]
    empty[2:] |= newline[2:] & (codes[1:-1] == 13) & newline[:-2]
    at[empty[prev]] = PARAGRAPH
    # Blank lines stay with the paragraph they end.
    at[(newline | (codes == 13))[nxt] & newline[prev]] = BLANK
    return out


class RangeMax:
    """Rightmost greatest of any window of values; blocks of the values are indexed as they are needed."""

    def __init__(self, values: np.ndarray, span: int):
        self.values, self.levels = values, max(1, int(span).bit_length())
        self.first, self.last, self.table = 0, 0, []

    def _index(self, low: int, high: int) -> None:
        self.first, self.last = low, min(len(self.values), max(high + 1, low + TABLE_SPAN))
        size = self.last - self.first
        row = (self.values[self.first : self.last].astype(np.int64) + 1) * size + np.arange(size)
        self.table = [row]
        for k in range(1, self.levels):
            half = 1 << (k - 1)
            if size < 2 * half:
                break
            row = np.maximum(row[:-half], row[half:])
            self.table.append(row)

    def best(self, low: int, high: int) -> int:
        """Position of the rightmost greatest value in [low, high]."""
        if not self.table or low < self.first or high >= self.last:
            self._index(low, high)
        size = self.last - self.first
        k = (high - low + 1).bit_length() - 1
        row = self.table[k]
        return self.first + int(max(row[low - self.first], row[high - self.first + 1 - (1 << k)]) % size)


class Boundaries:
    """The token boundaries of one text: the character each stands at (-1 inside one) and its strength."""

    def __init__(self, bpe: Bpe, text: str, cut: list[str]):
        self.bpe, self.text, self.cut = bpe, text, cut
        ids = [bpe.cache[p] for p in cut]
        flat = np.frombuffer(b"".join(ids), "<i4")
        byte_at = np.concatenate(([0], np.cumsum(bpe.sizes[flat])))
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        wide = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
        char_byte = np.concatenate(([0], np.cumsum(wide)))
        char = np.searchsorted(char_byte, byte_at)
        whole = char_byte[char] == byte_at
        self.char = np.where(whole, char, -1)
        self.strength = np.where(whole, strengths(text)[char], NEVER).astype(np.int8)
        #: Boundaries between pre-split pieces; only a part of such a piece can encode otherwise when alone.
        self.words = np.concatenate(([0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)))
        self.strength[self.words] = np.maximum(self.strength[self.words], WORD)

    def _alone(self, text: str) -> int:
        # The pieces of the step's other texts are still needed.
        return len(self.bpe.encode_many([text], keep=True)[0]) // 4

    def count(self, start: int, end: int) -> int:
        """How many tokens the text between two boundaries has when it stands alone."""
        first, last = np.searchsorted(self.words, (start, end))
        if self.words[first] != start or self.words[last] != end:
            return self._alone(self.text[self.char[start] : self.char[end]])
        # Blanks that were split because of what follows them are one piece at the end of a text.
        low = last
        while low > first and self.cut[low - 1].isspace():
            low -= 1
        tokens = int(end - start)
        if last - low > 1:
            tokens += self._alone("".join(self.cut[low:last])) - int(self.words[last] - self.words[low])
        return tokens


def cut_text(bpe: Bpe, text: str, cut: list[str], limit: int, overlap: int, slack: int) -> list[tuple[int, int, int]]:
    """``(start_char, end_char, n_tokens)`` of each piece of a text that is pre-split into ``cut``."""
    if not text:
        return []
    whole = sum(map(len, map(bpe.cache.__getitem__, cut))) // 4
    if whole <= limit:
        return [(0, len(text), whole)]
    at = Boundaries(bpe, text, cut)
    index, last = RangeMax(at.strength, limit), len(at.char) - 1
    out, start, least = [], 0, limit // 2
    while True:
        high = min(last, start + limit)
        while True:
            end = last if high == last else index.best(min(start + least, high), high)
            tokens = at.count(start, end)
            if tokens <= limit:
                break
            # A part of a word can have more tokens alone than it had there.
            high = max(start + 1, min(high, end) - max(1, tokens - limit))
        out.append((int(at.char[start]), int(at.char[end]), tokens))
        if end == last:
            return out
        # Step back by the overlap; only a boundary of at least a blank is worth going further back for.
        near = end - overlap
        back = index.best(max(start + 1, near - slack), near)
        if at.strength[back] < BLANK:
            back = index.best(max(start + 1, near - 8), near)
        start = back


OUT = T.StructType(
    [
        T.StructField("piece_no", T.IntegerType()),
        T.StructField("n_pieces", T.IntegerType()),
        T.StructField("start_char", T.LongType()),
        T.StructField("end_char", T.LongType()),
        T.StructField("n_tokens", T.IntegerType()),
        T.StructField("piece", T.StringType()),
    ]
)


def _cutter(path: str, limit: int, overlap: int, slack: int, with_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            for a, texts in steps(batch.column(1)):
                cuts = bpe.pieces(texts)
                row, no, of, start, end, size, text = [], [], [], [], [], [], []
                for i, whole in enumerate(texts):
                    pieces = cut_text(bpe, whole, cuts[i], limit, overlap, slack)
                    for j, (s, e, n) in enumerate(pieces):
                        row.append(a + i)
                        no.append(j)
                        of.append(len(pieces))
                        start.append(s)
                        end.append(e)
                        size.append(n)
                        text.append(whole[s:e] if with_text else None)
                arrays = [pa.array(no, pa.int32()), pa.array(of, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(size, pa.int32()), pa.array(text, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *arrays], ["key", *OUT.names])

    return run


def split_texts(
    rows: DataFrame, key: str, text: str, limit: int = 2048, overlap: int = 128, slack: int = 128, with_text: bool = True, path: str = VOCABULARY
) -> DataFrame:
    """``(key, piece_no, n_pieces, start_char, end_char, n_tokens, piece)``: each text in pieces of ``limit`` tokens
    at most.

    A text within the limit is one piece; NULL and empty texts have none. Pieces cover the text and never part a
    character. Each ends at the strongest boundary between half the limit and the limit; the next begins at least
    ``overlap`` tokens before that end, at the strongest boundary of the ``slack`` tokens before; a text without any
    break there is cut ``overlap`` tokens back (up to a character more). ``n_tokens`` is what the piece alone encodes to.
    Rows that repeat come out repeated; an empty table gives none; other columns aren't read. No shuffle. Without
    ``with_text`` the column ``piece`` is NULL.
    """
    if not 0 <= overlap + slack < limit // 2:
        raise ValueError("overlap and slack must leave half the limit")
    base = spread(rows.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")))
    out = base.mapInArrow(_cutter(path, limit, overlap, slack, with_text), T.StructType([base.schema["key"], *OUT.fields]))
    return out.withColumnRenamed("key", key) if key != "key" else out
