"""Byte-level BPE as a monoid: encodings of halves are joined by re-encoding around the seam.

Two levels. A text is cut in halves down to leaves; a leaf is the list of its pattern matches.
Joining re-matches a window around the seam, growing to the right until a match begins where
one of the right half began: from there on the same text follows, and the pattern never looks
back. On the left a match stands once it ended LOOK characters before the seam, the farthest
the pattern looks ahead.

A long match is encoded alike on bytes: tokens around the seam are re-encoded in a growing
window until the pairs at both of its edges are ones that encoding their own bytes gives
again. A token list in which every neighbouring pair has that property is the encoding.
"""

from __future__ import annotations

import heapq
import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession, functions as F

#: Characters of a leaf, bytes of a match merged in one go, characters the pattern looks ahead.
LEAF, DIRECT, LOOK = 8192, 48, 3
_CACHE = 200_000


def read_ranks(spark: SparkSession, path: str) -> list[bytes]:
    """Token bytes by rank, from a file of base64 token and rank per line."""
    import base64

    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    tokens = [b""] * (max(int(rank) for _, rank in pairs) + 1)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Encoder:
    """Encodes and decodes with one vocabulary; caches are bounded."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.ranks = {t: i for i, t in enumerate(tokens) if t}
        self.match = regex.compile(pattern)
        self.pieces: dict[str, tuple] = {}
        self.pairs: dict[tuple, bool] = {}

    # -- bytes ------------------------------------------------------------------
    def merge(self, data: bytes) -> list[int]:
        """Lowest rank first, leftmost on ties, with a heap over a linked list of parts."""
        if data in self.ranks:
            return [self.ranks[data]]
        ranks, n = self.ranks, len(data)
        end, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if middle < 0 or middle >= n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, -1
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(data[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def stable(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b encode to a, b again."""
        key = (a, b)
        if key not in self.pairs:
            if len(self.pairs) > _CACHE:
                self.pairs.clear()
            self.pairs[key] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return self.pairs[key]

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left or right
        i = j = 2
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            seam = self.merge(self.decode(left[len(left) - i :] + right[:j]))
            ends = i == len(left) or self.stable(left[-i - 1], seam[0])
            begins = j == len(right) or self.stable(seam[-1], right[j])
            if ends and begins:
                return left[: len(left) - i] + seam + right[j:]
            i, j = i if ends else 2 * i, j if begins else 2 * j

    def encode_bytes(self, data: bytes) -> list[int]:
        if len(data) <= DIRECT:
            return self.merge(data)
        half = len(data) // 2
        return self.join_tokens(self.encode_bytes(data[:half]), self.encode_bytes(data[half:]))

    # -- text -------------------------------------------------------------------
    def split(self, text: str) -> list[str]:
        """The pattern's matches over the whole text, in order."""
        if len(text) <= LEAF:
            return self.match.findall(text)
        half = len(text) // 2
        return self.join_matches(self.split(text[:half]), self.split(text[half:]))

    def join_matches(self, left: list[str], right: list[str]) -> list[str]:
        taken, seam = 0, 0
        while taken < len(left) and seam < LOOK:
            taken += 1
            seam += len(left[-taken])
        tail, reach = "".join(left[len(left) - taken :]), 4
        while True:
            reach = min(reach, len(right))
            window, starts, at = tail + "".join(right[:reach]), {}, seam
            for k in range(reach + 1):
                starts[at] = k
                at += len(right[k]) if k < reach else 0
            whole, again, at = reach == len(right), [], 0
            for found in self.match.findall(window):
                again.append(found)
                at += len(found)
                if at in starts and (whole or at <= len(window) - LOOK):
                    return left[: len(left) - taken] + again + right[starts[at] :]
            if whole:
                return left[: len(left) - taken] + again
            reach *= 2

    def encode(self, text: str) -> list[int]:
        pieces, out = self.pieces, []
        for piece in self.split(text):
            ids = pieces.get(piece)
            if ids is None:
                ids = tuple(self.encode_bytes(piece.encode("utf-8")))
                if len(pieces) > _CACHE:
                    pieces.clear()
                if len(piece) <= DIRECT:
                    pieces[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode_tree(self, ids: list[int], leaf: int = 1 << 16) -> bytes:
        """Concatenation up a tree of halves."""
        if len(ids) <= leaf:
            return self.decode(ids)
        half = len(ids) // 2
        return self.decode_tree(ids[:half], leaf) + self.decode_tree(ids[half:], leaf)


_ENCODERS: dict = {}


def _encoder(shared, pattern: str) -> Encoder:
    key = (shared.id, pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(shared.value, pattern)
    return _ENCODERS[key]


class _Shared:
    """The broadcast vocabulary with an id of its own; its size is the file's, not the data's."""

    def __init__(self, spark: SparkSession, tokens: list[bytes]):
        self.broadcast = spark.sparkContext.broadcast(tokens)
        self.id = uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


def encode_column(text: Column, tokens: list[bytes], pattern: str, spark: SparkSession) -> Column:
    """struct(ids array<int>, decoded binary): the encoding of a text and the bytes it decodes to.

    Special tokens have no meaning; their strings are ordinary text. A missing text counts as
    empty and gives no ids and no bytes. Texts of any length are encoded whole.
    """
    shared = _Shared(spark, tokens)

    @F.arrow_udf("struct<ids:array<int>,decoded:binary>")
    def run(texts: pa.Array) -> pa.Array:
        encoder, sizes, flat, back = _encoder(shared, pattern), [0], [], []
        for text in texts:
            ids = encoder.encode(text.as_py() or "")
            flat.append(np.array(ids, np.int32))
            sizes.append(sizes[-1] + len(ids))
            back.append(encoder.decode_tree(ids))
        values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32), pa.int32())
        lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values)
        return pa.StructArray.from_arrays([lists, pa.array(back, pa.binary())], ["ids", "decoded"])

    return run(text)


def decode_column(ids: Column, tokens: list[bytes], spark: SparkSession) -> Column:
    """The bytes of a column of token ids; a missing list gives no bytes."""
    shared = _Shared(spark, tokens)

    @F.arrow_udf("binary")
    def run(lists: pa.Array) -> pa.Array:
        encoder = _encoder(shared, "")
        return pa.array([encoder.decode_tree(ids.as_py() or []) for ids in lists], pa.binary())

    return run(ids)
