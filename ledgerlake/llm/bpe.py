"""Byte-level BPE: exact merges in linear time by backtracking over longest matches.

The ranks of a tiktoken file define the merges.  Bytes are read as Latin-1
characters, so that pyahocorasick's trie over the tokens finds the longest token
that starts at a byte.  Encoding walks from match to match.  Two neighbours are kept only if BPE would leave a boundary between them;
that test undoes both tokens' merges from the last to the first and is memoised.
Where a match doesn't fit its left neighbour, the next shorter token is tried,
and where none is left, the walk steps back one token.  A byte position that
once proved to be a dead end isn't tried again, so the work stays linear.

The automaton and tables are built once per Python worker from the rank file's
content, which is as large as the vocabulary (under 1 MB) whatever the input.
"""

from __future__ import annotations

import base64
import sys
import unicodedata
from array import array
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns

#: Distinct chunks of text whose ids a worker remembers: up to twice as many, the older half goes first.
REMEMBERED = 150_000
#: And those it still remembers while it waits for its next task.
KEPT = 20_000


class Vocabulary:
    """Tokens with their merges undone one step, and the automaton over them."""

    def __init__(self, rank_lines: bytes):
        ranks = dict((base64.b64decode(token).decode("latin-1"), int(rank))
                     for token, rank in map(bytes.split, rank_lines.splitlines()))
        self.ranks = ranks
        self.text = {rank: token for token, rank in ranks.items()}
        self.length = [len(self.text.get(rank, "")) for rank in range(max(self.text, default=-1) + 1)]
        self.widest = max(self.length, default=1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.shorter: dict[int, int | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self._add(token, rank)
        self.fits.clear()
        for rank in [r for r in self.shorter if r in self.parts or self.length[r] == 1]:
            self.automaton.add_word(self.text[rank], rank)
        # a token that no sequence of merges reaches never appears inside a piece
        for rank, prefix in self.shorter.items():
            while prefix is not None and self.length[prefix] > 1 and prefix not in self.parts:
                prefix = self.shorter[prefix]
            self.shorter[rank] = prefix

    def _add(self, token: str, rank: int) -> None:
        """The longest shorter token that begins ``token``, and the pair whose merge makes it."""
        prefixes = [self.ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks]
        self.shorter[rank] = prefixes[0] if prefixes else None
        for left in prefixes:
            right = self.ranks.get(token[self.length[left]:])
            if right is not None and left < rank and right < rank and self._boundary(left, right):
                self.parts[rank] = (left, right)
                self.merged[left, right] = rank
                return

    def _boundary(self, left: int, right: int) -> bool:
        """Whether BPE over both tokens' bytes leaves exactly these two tokens.

        Undo the later of both tokens' last merges, again and again.  Each step
        shows the pair of tokens that met at the boundary at that time; had that
        pair a merge that was due before the one just undone, BPE would have
        crossed the boundary.
        """
        due = 1 << 62
        while True:
            if self.merged.get((left, right), due) < due:
                return False
            inner_left, inner_right = self.parts.get(left), self.parts.get(right)
            if inner_left and (not inner_right or left > right):
                due, left = left, inner_left[1]
            elif inner_right:
                # an equal merge to the left comes first, so it's due up to this rank itself
                due, right = right + 1, inner_right[0]
            else:
                return True

    def neighbours(self, left: int, right: int) -> bool:
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= 1_000_000:
                self.fits.clear()
            known = self.fits[left, right] = self._boundary(left, right)
        return known

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece (a match of the split pattern)."""
        data = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        size, length, shorter, fits = len(data), self.length, self.shorter, self.fits
        dead = bytearray(size + 1)
        out: list[int] = []
        at, token = 0, self.longest(data, 0)
        while True:
            end = at + length[token]
            if not dead[end]:
                fit = not out or fits.get((out[-1], token))
                if fit is None:
                    fit = self.neighbours(out[-1], token)
                if fit:
                    out.append(token)
                    if end == size:
                        return out
                    at, token = end, self.longest(data, end)
                    continue
            token = shorter[token]
            if token is None:
                dead[at] = 1
                token = out.pop()
                at -= length[token]

    def longest(self, data: str, at: int) -> int:
        """The longest token that starts at this byte; every single byte is a token."""
        window = data[at:at + self.widest]
        n = self.automaton.longest_prefix(window)  # as far as some token goes on like this
        while True:
            rank = self.automaton.get(window[:n], None)
            if rank is not None:
                return rank
            n -= 1


@lru_cache(maxsize=4)
def vocabulary(rank_lines: bytes) -> Vocabulary:
    return Vocabulary(rank_lines)


class _Irregular(Exception):
    """White space other than single spaces between words: the chunks depend on each other."""


class _Chunks(dict):
    """Packed ids of chunks, computed when first asked for.

    A chunk is what stands between two single spaces.  With the space before it
    and no white space at its ends, the pattern always has a match that begins
    at that space, so chunks are cut and encoded independently.
    """

    def __init__(self, pieces: _Pieces, split, space: str):
        super().__init__()
        self.pieces, self.split, self.space, self.older = pieces, split, space, {}

    def __missing__(self, chunk: str) -> bytes:
        packed = self.older.get(chunk)
        if packed is None:
            if not chunk or chunk[0].isspace() or chunk[-1].isspace():
                raise _Irregular
            packed = b"".join(map(self.pieces.__getitem__, self.split(self.space + chunk)))
            if len(chunk) > 64:
                return packed
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[chunk] = packed
        return packed


class _Pieces(dict):
    """Packed ids of pieces; forgets as chunks do."""

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.vocab, self.older = vocab, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            packed = array("i", self.vocab.encode_piece(piece)).tobytes()
            if len(piece) > 64:
                return packed
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[piece] = packed
        return packed


class Encoder:
    """Encodes whole texts by one vocabulary and split pattern."""

    def __init__(self, rank_lines: bytes, pattern: str, newer: str):
        self.pieces, self.split = _Pieces(vocabulary(rank_lines)), splitter(pattern, newer)
        self.first, self.later = (_Chunks(self.pieces, self.split, space) for space in ("", " "))
        # only this pattern is known to begin a match at every single space
        self.chunked = pattern == public_tokenizers.PATTERN

    def packed(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.chunked:
            head, space, rest = text.partition(" ")
            try:
                start = self.first[head]
                return start + b"".join(map(self.later.__getitem__, rest.split(" "))) if space else start
            except _Irregular:
                pass
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def forget(self) -> None:
        """Keep only the first of what was remembered last, which the commonest chunks are among."""
        for known in (self.pieces, self.first, self.later):
            known.older = {}
            if len(known) > KEPT:
                kept = dict(islice(known.items(), KEPT))
                known.clear()
                known.update(kept)

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts and the offsets of each text's ids."""
        packed = [self.packed(t) for t in texts]
        offsets = np.zeros(len(packed) + 1, np.int64)
        np.cumsum([len(x) // 4 for x in packed], out=offsets[1:])
        return np.frombuffer(b"".join(packed), "<i4"), offsets


@lru_cache(maxsize=4)
def encoder(rank_lines: bytes, pattern: str, newer: str) -> Encoder:
    return Encoder(rank_lines, pattern, newer)


def _ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=1)
def newer_characters() -> str:
    """Ranges of letters and numbers of Unicode versions that ``regex`` knows and tiktoken's pattern engine doesn't.

    Asks both engines about every code point that Python's own (older) tables
    leave unassigned; tiktoken keeps what its pattern matches and drops the rest.
    """
    word = regex.compile(r"[\p{L}\p{N}]")
    unassigned = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cn" and word.match(c)]
    probe = tiktoken.Encoding("probe", pat_str=r"[\p{L}\p{N}]", special_tokens={},
                              mergeable_ranks={bytes([b]): b for b in range(256)})
    known = set(bytes(probe.encode_ordinary("".join(unassigned))).decode())
    ranges: list[list[int]] = []
    for c in (ord(c) for c in unassigned if c not in known):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


def splitter(pattern: str, newer: str):
    """The function that cuts a text into the pattern's matches, as tiktoken's pattern engine would."""
    compiled = regex.compile(pattern)
    if not newer:
        return compiled.findall
    odd = regex.compile("[" + newer + "]")

    def split(text: str) -> list[str]:
        if text.isascii() or not odd.search(text):
            return compiled.findall(text)
        # neither letters nor numbers there: cut a copy that has an unassigned character instead
        return [text[m.start():m.end()] for m in compiled.finditer(odd.sub("\uffff", text))]

    return split


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the array column ``ids``: the ids of each whole text.

    Each match of ``pattern`` is encoded separately; no special tokens.  A null
    or empty text has no ids.  Repeated rows are encoded alike; an input column
    named ``ids`` is replaced.  The rank file is read on the driver.
    """
    lines, newer = _ranks(rank_file), newer_characters()

    def make():
        own = encoder(lines, pattern, newer)

        def step(column):
            values, offsets = own.ids(column.to_pylist())
            return [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))]
        step.end = own.forget
        return step

    return add_columns(df, [text], T.StructType([T.StructField(ids, T.ArrayType(T.IntegerType()))]), make)


def decode(df: DataFrame, rank_file: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the binary column ``decoded``: the bytes of the ids, joined.

    Null where ``ids`` is null or holds a null or an id outside the vocabulary;
    no ids give no bytes.  An input column named ``decoded`` is replaced.
    """
    lines = _ranks(rank_file)

    def make():
        tokens, present = _token_bytes(lines)
        none = len(present)                                   # the place of the empty token

        def step(column):
            ids, rows = column.flatten(), len(column)
            offsets = np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths().fill_null(0)))])
            at = ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            good = (at >= 0) & (at < none)
            good[good] = present[at[good]]
            missing = np.concatenate([[0], np.cumsum(~good)])
            valid = np.asarray(column.is_valid()) & (missing[offsets[1:]] == missing[offsets[:-1]])
            joined = tokens.take(pa.array(np.where(good, at, none)))      # all tokens of all rows, one after another
            ends = np.frombuffer(joined.buffers()[1], np.int32, len(joined) + 1)[offsets].astype(np.int32) if len(joined) \
                else np.zeros(rows + 1, np.int32)
            data = joined.buffers()[2] if len(joined) else pa.py_buffer(b"")
            return [pa.Array.from_buffers(pa.binary(), rows, [pa.py_buffer(np.packbits(valid, bitorder="little").tobytes()),
                                                              pa.py_buffer(ends.tobytes()), data])]
        return step

    return add_columns(df, [ids], T.StructType([T.StructField(decoded, T.BinaryType())]), make)


@lru_cache(maxsize=4)
def _token_bytes(rank_lines: bytes) -> tuple[pa.Array, np.ndarray]:
    """The tokens by rank with an empty one after the last, and which ranks there are."""
    known = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, rank_lines.splitlines())}
    size = max(known, default=-1) + 1
    return pa.array([known.get(i, b"") for i in range(size)] + [b""], pa.binary()), np.array([i in known for i in range(size)], bool)
