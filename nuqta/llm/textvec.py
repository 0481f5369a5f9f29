"""Whole-buffer text processing: an Arrow string column is treated as one byte array, so
that splitting into words and hashing take a few vector passes and no object per word.

A word is a longest run of ASCII letters and digits (case folded) and of bytes of
characters beyond ASCII; everything else separates. ``words_of`` is the plain equivalent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(BASE, -1, 1 << 64)
BASE2 = 0xC2B2AE3D27D4EB4F | 1
_INV2 = pow(BASE2, -1, 1 << 64)

FOLD = np.zeros(256, np.uint8)
for _c in range(256):
    if 48 <= _c < 58 or 97 <= _c < 123 or _c >= 128:
        FOLD[_c] = _c
    elif 65 <= _c < 91:
        FOLD[_c] = _c + 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = BASE, inverse: int = _INV) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept for reuse."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << max(0, n - 1).bit_length())
        both = []
        for b in (base, inverse):
            p = np.empty(size, U64)
            p[0] = 1
            k = 1
            while k < size:
                m = min(k, size - k)
                p[k : k + m] = p[:m] * U64(pow(b, k, 1 << 64))
                k += m
            both.append(p)
        have = _powers[base] = (both[0], both[1])
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def mix_int(x: int) -> int:
    m = (1 << 64) - 1
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & m
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & m
    return x ^ (x >> 31)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    kind = pa.large_binary()
    column = column.cast(pa.large_string()).view(kind) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo, hi = (int(off[0]), int(off[-1])) if len(off) else (0, 0)
    return raw[lo:hi], off - lo


#: Bytes of a chunk: a little under a power of two, the size of the tables kept for it.
CHUNK = (1 << 19) - 16


def chunks(offsets: np.ndarray, target: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of ``target`` bytes at most, but one row at least; every row is in one."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + target, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


class Words:
    """The words of a chunk of documents."""

    __slots__ = ("end", "first", "hash", "start")

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        """``first[d]:first[d + 1]`` are the words of document d; ``start`` and ``end`` are
        byte positions in ``data``; ``hash`` has 64 bits."""
        n = len(data)
        low = FOLD[data]
        word = low != 0
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        begins = word.copy()
        begins[1:] &= ~word[:-1] | edge[1:n]
        ends = word.copy()
        ends[:-1] &= ~word[1:] | edge[1:n]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        p, inv = powers(n + 1)
        total = np.empty(n + 1, U64)
        total[0] = 0
        np.cumsum(low.astype(U64) * p[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * inv[self.start] + (self.end - self.start).astype(U64))

    def __len__(self) -> int:
        return len(self.start)


def hash_word(word: bytes) -> int:
    """The plain equivalent of ``Words.hash`` for one folded word."""
    h = sum(b * pow(BASE, i, 1 << 64) for i, b in enumerate(word)) + len(word)
    return mix_int(h & (1 << 64) - 1)


def words_of(text: str | None) -> list[bytes]:
    """The plain equivalent of ``Words`` for one text."""
    folded = bytes(FOLD[b] for b in (text or "").encode())
    return [w for w in re.split(b"\0+", folded) if w]


def grams(hashes: np.ndarray, k: int, base: int = BASE2, inverse: int = _INV2) -> np.ndarray:
    """Hash of every k consecutive items, one for each start (len - k + 1)."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, U64)
    p, inv = powers(n + 1, base, inverse)
    total = np.empty(n + 1, U64)
    total[0] = 0
    np.cumsum(hashes * p[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * inv[: n - k + 1] + U64(k))


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..l-1 for each length l, one after the other."""
    total = int(lengths.sum())
    begin = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) - np.repeat(begin, lengths)


def take_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i]..starts[i]+lengths[i]-1 for each i, one after the other."""
    lengths = lengths.astype(np.int64)
    begin = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum()), dtype=np.int64) + np.repeat(starts.astype(np.int64) - begin, lengths)
