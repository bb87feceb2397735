"""Words and shingles of Arrow string columns as numpy arrays.

Texts stay UTF-8 bytes: only A-Z change case, and the word classes name ASCII
characters alone, so a byte decides for itself. A batch is worked through in
pieces of a quarter of a mebibyte, which bounds memory whatever the length of a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
LONG_WORD = 1 << 16
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U64)
    out[0] = 1
    filled = 1
    while filled < n:
        step = min(filled, n - filled)
        out[filled:filled + step] = out[:step] * U64(pow(base, filled, 1 << 64))
        filled += step
    return out


_UP = _powers(_BASE, PIECE + LONG_WORD + 1)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), PIECE + LONG_WORD + 1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing: digits, a-z and all beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[48:58] = LETTERS[97:123] = LETTERS[128:] = True
#: [^\x20\x09-\x0D]: everything but ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at.astype(np.int64)


def pieces(offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


class Words:
    """Words of the rows lo..hi of a column: where they start and end, a 64-bit
    hash of each, and ``first``: row d has the words first[d] .. first[d+1]."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lo: int, hi: int, letters: np.ndarray,
                 hashed: bool = True):
        at = offsets[lo:hi + 1] - offsets[lo]
        self.data = LOWER[raw[offsets[lo]:offsets[hi]]]
        inside = letters[self.data]
        before = np.empty(len(inside), bool)
        before[1:], before[:1] = inside[:-1], False
        cuts = at[:-1][at[:-1] < len(inside)]
        before[cuts] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.empty(len(inside), bool)
        after[:-1], after[-1:] = inside[1:], False
        after[cuts[cuts > 0] - 1] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.at = at
        self.first = np.searchsorted(self.starts, at)
        if hashed:
            self.hashes = self._hash()

    def _hash(self) -> np.ndarray:
        starts, ends = self.starts, self.ends
        out = np.empty(len(starts), U64)
        long_ = np.flatnonzero(ends - starts > LONG_WORD)
        for i in long_:
            out[i] = int.from_bytes(hashlib.blake2b(self.data[starts[i]:ends[i]].tobytes(), digest_size=8).digest(), "big")
        for a, b in zip(np.r_[0, long_ + 1], np.r_[long_, len(starts)]):
            while a < b:
                c = min(b, max(a + 1, int(np.searchsorted(starts, starts[a] + PIECE))))
                s, e = starts[a:c] - starts[a], ends[a:c] - starts[a]
                sums = np.empty(e[-1] + 1, U64)
                sums[0] = 0
                np.cumsum((self.data[starts[a]:ends[c - 1]].astype(U64) + U64(1)) * _UP[:e[-1]], out=sums[1:])
                out[a:c] = mix((sums[e] - sums[s]) * _DOWN[s] + (e - s).astype(U64))
                a = c
        return out

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()

    def joined(self, a: int, b: int) -> str:
        """The words a .. b with one space between."""
        return b" ".join(self.word(i) for i in range(a, b)).decode()

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive words (across rows too: mask those)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out = hashes[:n].copy()
    for i in range(1, k):
        out = out * U64(0xD6E8FEB86659FD93) + hashes[i:i + n]
    return mix(out)


def shingles(words: Words, k: int) -> Iterator[np.ndarray]:
    """Per row the sorted distinct shingle hashes; fewer than k words are one shingle, none are none."""
    every = rolled(words.hashes, k)
    for a, b in zip(words.first[:-1], words.first[1:]):
        n = b - a
        if n >= k:
            yield np.unique(every[a:b - k + 1])
        elif n:
            yield rolled(words.hashes[a:b], n) ^ U64(n)
        else:
            yield np.empty(0, U64)
