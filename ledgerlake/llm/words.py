"""Words of whole texts as 64-bit hashes, for a batch of texts at once in numpy.

A word is a run of bytes other than space and 0x09-0x0D.  Its hash is a
polynomial over random numbers drawn for each byte value, modulo 2**64, stirred
at the end; the sums of all words come from one running sum over the batch.
Two different words share a hash with a probability of about 2**-64 a pair.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 2**64, 256, np.uint64, endpoint=False) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return tuple(out)


def stir(h: np.ndarray) -> np.ndarray:
    """Spread each number's bits over all 64."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return _LOWER[raw]


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null: none), and where each text begins and the last ends."""
    texts = pa.array([], pa.large_string()) if not len(texts) else texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, and the number of the first word of each text (and of none after the last)."""
    solid = np.zeros(len(raw) + 1, bool)
    solid[:-1] = ~_SPACE[raw]
    cut = np.zeros(len(raw) + 1, bool)  # a text begins here
    cut[offsets] = True
    before = np.zeros(len(raw) + 1, bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (cut | ~before))
    ends = np.flatnonzero(before & (cut | ~solid))
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = _powers(max(16, int(len(raw)).bit_length()))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[:len(raw)], out=total[1:])
    return stir((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and the number of the first word of each text."""
    raw, offsets = bytes_of(texts)
    starts, ends, first = bounds(raw, offsets)
    return hashes(lowered(raw) if lower else raw, starts, ends), first


def shingle_sets(words: np.ndarray, first: np.ndarray, size: int) -> list[np.ndarray]:
    """Each text's distinct shingles of ``size`` consecutive words, sorted; the whole text if it has fewer words."""
    n = len(words)
    mixed = np.zeros(n, np.uint64)
    for i in range(size):
        mixed[:n - i] = (mixed[:n - i] + words[i:]) * np.uint64(_BASE)
        mixed ^= mixed >> np.uint64(29)
    mixed = stir(mixed)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            s = np.sort(mixed[a:b - size + 1])
        elif b > a:
            h = np.zeros(1, np.uint64)
            for w in words[a:b]:
                h = (h + w) * np.uint64(_BASE)
                h ^= h >> np.uint64(29)
            s = stir(h + np.uint64(b - a))
        else:
            s = np.zeros(0, np.uint64)
        out.append(s[np.r_[True, s[1:] != s[:-1]]] if len(s) else s)
    return out
