"""Byte-level BPE in linear time: longest matches, backtracking, and memoised compatibility of neighbours.

A text is cut by the pre-split pattern; a piece's bytes are read as Latin-1, so an Aho-Corasick automaton over all
tokens finds the longest ones. A sequence of tokens is the result of the merges exactly if every two
neighbours merge to themselves. So the encoder takes the longest token at each place: where all of these neighbours are compatible, it is done. Else it falls back to shorter ones
where the pair with the token before isn't compatible, and steps back where none is; places found to be dead ends are marked,
which keeps the work linear. Compatibility of two tokens follows the merges at their border and is remembered.
Pieces and words are remembered too, in bounded tables.

Defined cases: null and empty texts have no tokens; repeated rows are encoded each for itself; only ``text`` is read.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import as_bytes, steps

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pieces, words and token pairs that a task remembers, each.
REMEMBERED = 1 << 19


def ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a rank file; read on the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def little_endian(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Remembered(dict):
    """Results of ``make`` by argument; emptied when it holds ``REMEMBERED`` of them."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= REMEMBERED:
            self.clear()
        self[key] = value
        return value


class Ragged(Exception):
    """White space of more than one character borders on a space."""


class Encoder:
    """Encodes by ``ranks``, every match of ``pattern`` separately, without special tokens.

    A single space between two other characters always begins a piece, so texts are looked up by what lies between
    their spaces; where a space borders on other white space, the whole text is cut by the pattern.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}
        self.spelt = [self.token.get(r, b"") for r in range(max(ranks.values(), default=-1) + 1)]
        self.longest = max(map(len, ranks), default=0)
        self.cut = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.halves = Remembered(self._halves)
        self.compatible = Remembered(self._compatible)
        self.pieces = Remembered(lambda piece: little_endian(self.encode_piece(piece.encode())))
        self.spaced = Remembered(lambda word: self._word(" " + word, word))

    def _halves(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; none for a single byte or a token that merges never reach."""
        parts = [self.ranks[self.token[rank][i:i + 1]] for i in range(len(self.token[rank]))]
        while len(parts) > 2:
            after = [self.ranks.get(self.token[a] + self.token[b], -1) for a, b in zip(parts, parts[1:])]
            best = min((r for r in after if r >= 0 and r != rank), default=None)
            if best is None:
                return None
            at = after.index(best)
            parts[at:at + 2] = [best]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _edge(self, rank: int, side: int) -> list[int]:
        """The tokens at one edge of a token from the single byte on, in the order the merges make them."""
        out = [rank]
        while (halves := self.halves[out[-1]]) is not None:
            out.append(halves[side])
        return out[::-1]

    def _compatible(self, pair: tuple[int, int]) -> bool:
        """Do the merges of both tokens' bytes together give the two tokens?

        Merges come by rank, the leftmost first. The tokens stay apart unless the pair at their border
        has its turn before the merge that next changes either side of it.
        """
        left, right = self._edge(pair[0], 1), self._edge(pair[1], 0)
        if len(self.token[left[0]]) > 1 or len(self.token[right[0]]) > 1:
            return False
        i = j = 0
        never = len(self.spelt)
        while True:
            across = self.ranks.get(self.token[left[i]] + self.token[right[j]], never)
            next_left = left[i + 1] if i + 1 < len(left) else never
            next_right = right[j + 1] if j + 1 < len(right) else never
            if across < next_left and across <= next_right and across < never:
                return False
            if next_left == never and next_right == never:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size, letters, compatible = len(piece), piece.decode("latin-1"), self.compatible
        longest = [rank for _, rank in self.automaton.iter_long(letters)]
        if all(map(compatible.__getitem__, zip(longest, longest[1:]))):
            return longest
        ranks, longest_prefix = self.ranks, self.automaton.longest_prefix
        dead = bytearray(size + 1)
        out: list[int] = []
        place = [0]
        longest_left = [longest_prefix(letters[:self.longest])]  # at each place in use: no longer token is untried
        while place[-1] < size:
            at, length = place[-1], longest_left[-1]
            while length:
                rank = ranks.get(piece[at:at + length])
                if rank is not None and not dead[at + length] and (not out or compatible[out[-1], rank]):
                    break
                length -= 1
            if length:
                longest_left[-1] = length - 1
                out.append(rank)
                at += length
                place.append(at)
                longest_left.append(longest_prefix(letters[at:at + self.longest]))
            else:
                dead[at] = 1
                if not out:
                    raise ValueError("the vocabulary lacks single bytes")
                out.pop()
                place.pop()
                longest_left.pop()
        return out

    def _word(self, word: str, bare: str) -> bytes:
        if not bare or bare[0].isspace() or bare[-1].isspace():
            raise Ragged
        return self._cut(word)

    def _cut(self, text: str) -> bytes:
        # Long pieces aren't worth remembering.
        return b"".join([
            self.pieces[p] if len(p) <= 64 else little_endian(self.encode_piece(p.encode())) for p in self.cut(text)
        ])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        first, *words = text.split(" ")
        try:
            return self._word(first, first) + b"".join(map(self.spaced.__getitem__, words))
        except Ragged:
            return self._cut(text)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.spelt.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` (little-endian unsigned 32-bit integers) and ``decoded``, the bytes they stand for.

    Columns of those names are replaced. The vocabulary, a file of fixed size, is read on the driver and broadcast, so executors need no copy.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    shared = docs.sparkSession.sparkContext.broadcast({"ranks": ranks(path)})
    docs = docs.drop("ids", "decoded")
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value  # a worker keeps it over its tasks, and with it what the encoder remembers
        if "encoder" not in held:
            held["encoder"] = Encoder(held["ranks"])
        encoder = held["encoder"]
        for batch in batches:
            for part in steps(batch.rename_columns([*map(str, range(batch.num_columns))]), str(text_at)):
                ids = [encoder.encode(t.decode()) for t in as_bytes(part.column(text_at))]
                back = [encoder.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary()), pa.array(back, pa.binary())], [*names, "ids", "decoded"])

    names = docs.columns
    schema = T.StructType([*docs.schema, T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
    return docs.mapInArrow(run, schema)
