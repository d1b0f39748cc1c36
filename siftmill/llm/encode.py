"""Encoding texts with a byte-level BPE vocabulary, token ids or counts only.

A text is cut by the tokenizer's own pattern. A piece that isn't a token is merged with the help of a segment
tree over the ranks of its adjacent pairs: the root names the leftmost pair of the lowest rank, a merge changes
three leaves, and each change climbs to the root in as many steps as the logarithm of the length. Short pieces
of one batch are merged side by side, one tree a row; a very long one by itself. Each distinct piece is merged
once for a worker as long as it stays in a bounded cache.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces a worker remembers; with more it starts afresh, which costs time only.
CACHE_PIECES = 400_000
#: Characters of text taken into one step, so a batch of long texts doesn't pile up.
STEP_CHARS = 4_000_000
_NONE = np.iinfo(np.int64).max


class Bpe:
    """Ranks of a ``.tiktoken`` file (base64 token, rank)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(PATTERN).findall
        self.bytes = np.zeros(256, np.int64)
        for b in range(256):
            self.bytes[b] = self.ranks[bytes([b])]
        # Every pair of tokens whose join is a token; the join's rank is the pair's rank and its id.
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                if (a := self.ranks.get(token[:cut])) is not None and (b := self.ranks.get(token[cut:])) is not None:
                    pairs[a << 20 | b] = rank
        self.pairs = pairs
        self.sizes = np.zeros(max(self.ranks.values()) + 1, np.int64)
        for token, rank in self.ranks.items():
            self.sizes[rank] = len(token)
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.cache: dict[str, bytes] = {}

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, -1 where there is none; a negative symbol pairs with nothing."""
        key = np.where((a < 0) | (b < 0), -1, a << 20 | b)
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (int32, little endian) of pieces, merged side by side; all of a similar length."""
        rows, most = len(pieces), max(map(len, pieces))
        width = 1
        while width < most:
            width *= 2
        sizes = np.fromiter(map(len, pieces), np.int64, rows)
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        symbol = np.full((rows, width + 1), -1, np.int64)
        symbol[:, :width][np.arange(width) < sizes[:, None]] = self.bytes[flat]
        after = np.broadcast_to(np.minimum(np.arange(1, width + 2), width), (rows, width + 1)).copy()
        before = np.broadcast_to(np.maximum(np.arange(-1, width), 0), (rows, width + 1)).copy()
        tree = np.full((rows, 2 * width), _NONE, np.int64)
        rank = self._rank(symbol[:, :-1].ravel(), symbol[:, 1:].ravel()).reshape(rows, width)
        spots = np.arange(width)
        tree[:, width:] = np.where(rank >= 0, rank * width + spots, _NONE)
        level = width
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        live = np.arange(rows)
        root = min(1, 2 * width - 1)
        while True:
            best = tree[live, root]
            live = live[best != _NONE]
            if not len(live):
                break
            best = best[best != _NONE]
            at, new = best % width, best // width
            gone = after[live, at]
            then = after[live, gone]
            symbol[live, at] = new
            symbol[live, gone] = -1
            after[live, at] = then
            before[live, then] = at
            prior = before[live, at]
            first = at == 0
            right = self._rank(new, symbol[live, then])
            left = self._rank(np.where(first, -1, symbol[live, prior]), new)
            for spot, value in (
                (gone, np.full(len(live), _NONE)),
                (at, np.where(right >= 0, right * width + at, _NONE)),
                (np.where(first, at, prior), np.where(first, np.where(right >= 0, right * width + at, _NONE), np.where(left >= 0, left * width + prior, _NONE))),
            ):
                node = spot + width
                tree[live, node] = value
                node = node >> 1
                while node[0]:
                    tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, 2 * node + 1])
                    node = node >> 1
        kept = symbol[:, :width] >= 0
        ids = symbol[:, :width][kept].astype("<i4").tobytes()
        ends = np.cumsum(kept.sum(axis=1)) * 4
        return [ids[e - 4 * n : e] for e, n in zip(ends.tolist(), kept.sum(axis=1).tolist(), strict=True)]

    def merge_one(self, piece: bytes) -> bytes:
        """The same for one long piece."""
        n = len(piece)
        width = 1
        while width < n:
            width *= 2
        symbol = self.bytes[np.frombuffer(piece, np.uint8)].tolist() + [-1]
        after, before = list(range(1, n + 1)) + [n], list(range(-1, n))
        pairs, none = self.pairs, int(_NONE)
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = pairs.get(symbol[i] << 20 | symbol[i + 1])
            if rank is not None:
                tree[width + i] = rank * width + i
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(spot: int, value: int) -> None:
            node = spot + width
            if tree[node] == value:
                return
            tree[node] = value
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                low = a if a < b else b
                if tree[node] == low:
                    return
                tree[node] = low
                node >>= 1

        while (best := tree[1]) != none:
            at, new = best % width, best // width
            gone = after[at]
            then = after[gone]
            symbol[at], symbol[gone] = new, -1
            after[at] = then
            before[then] = at
            put(gone, none)
            rank = pairs.get(new << 20 | symbol[then]) if then < n else None
            put(at, none if rank is None else rank * width + at)
            prior = before[at]
            if prior >= 0:
                rank = pairs.get(symbol[prior] << 20 | new)
                put(prior, none if rank is None else rank * width + prior)
        return np.array([s for s in symbol if s >= 0], "<i4").tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of pieces into the cache."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            if (rank := self.ranks.get(raw)) is not None:
                self.cache[piece] = rank.to_bytes(4, "little")
            else:
                by_size.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
        for bits, group in by_size.items():
            # Side by side pays when enough pieces share the steps.
            if len(group) < 8 or bits > 12:
                for piece, raw in group:
                    self.cache[piece] = self.merge_one(raw)
                continue
            step = max(8, (1 << 20) >> bits)
            for i in range(0, len(group), step):
                some = group[i : i + step]
                for (piece, _), ids in zip(some, self.merge_many([r for _, r in some]), strict=True):
                    self.cache[piece] = ids

    def pieces(self, texts: list[str], keep: bool = False) -> list[list[str]]:
        """The pieces of each text; the ids of all of them are in the cache afterwards. With ``keep`` the cache isn't
        emptied before, so that the pieces of an earlier call stay in it as well."""
        cut = [self.split(t) for t in texts]
        if not keep and len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        if new := {p for c in cut for p in c if p not in self.cache}:
            self.learn(new)
        return cut

    def encode_many(self, texts: list[str], keep: bool = False) -> list[bytes]:
        """Ids (int32, little endian) of each text, without special tokens: text that looks like one is text."""
        cut, cache = self.pieces(texts, keep), self.cache
        return [b"".join([cache[p] for p in c]) for c in cut]


_LOADED: dict[str, Bpe] = {}


def tokenizer(path: str = VOCABULARY) -> Bpe:
    """One for a worker process."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def steps(texts: pa.Array, chars: int = STEP_CHARS) -> Iterator[tuple[int, list[str]]]:
    """``(start, texts)``: a column of texts in steps of about ``chars`` characters, at least one text each; NULL is empty.
    Only the texts of a step are made Python strings."""
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
    start = size = 0
    for i, n in enumerate([*sizes, chars + 1]):
        if i > start and (size + n > chars or i == len(sizes)):
            yield start, [t or "" for t in texts.slice(start, i - start).to_pylist()]
            start, size = i, 0
        size += n


def _encoder(path: str, counts: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            last = batch.num_columns - 1
            for a, texts in steps(batch.column(last)):
                ids, n = bpe.encode_many(texts), len(texts)
                sizes = np.fromiter(map(len, ids), np.int64, n) // 4
                if counts:
                    out = pa.array(sizes, pa.int64())
                else:
                    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                    out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32()))
                kept = [batch.column(i).slice(a, n) for i in range(last)]
                yield pa.RecordBatch.from_arrays([*kept, out], [f"c{i}" for i in range(last)] + ["out"])

    return run


def _run(rows: DataFrame, keep: list[str], text: str, path: str, counts: bool) -> DataFrame:
    base = spread(rows.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("__text")))
    fields = [T.StructField(f"c{i}", base.schema[f"c{i}"].dataType) for i in range(len(keep))]
    kind = T.LongType() if counts else T.ArrayType(T.IntegerType(), True)
    out = base.mapInArrow(_encoder(path, counts), T.StructType([*fields, T.StructField("out", kind)]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("out").alias("n_tokens" if counts else "ids"))


def encode(rows: DataFrame, keep: list[str], text: str, path: str = VOCABULARY) -> DataFrame:
    """``(*keep, ids)``: the token ids of ``text`` as ARRAY<INT>, without special tokens.

    A NULL and an empty text give an empty list. Marks of special tokens are encoded as the plain text they are.
    Texts are taken whole at any length; rows that repeat are repeated; an empty table gives none. Columns not in
    ``keep`` aren't read. There is no shuffle. ``path`` names a ``.tiktoken`` file all executors can read.
    """
    return _run(rows, keep, text, path, False)


def token_counts(rows: DataFrame, keep: list[str], text: str, path: str = VOCABULARY) -> DataFrame:
    """``(*keep, n_tokens)``: how many ids ``encode`` would give; 0 for a NULL or empty text."""
    return _run(rows, keep, text, path, True)
