"""Vectorised text primitives over Arrow string columns.

A batch of texts is treated as one byte buffer with row offsets, so that words,
word hashes and shingle hashes of all its rows come from a few NumPy passes, with
no Python object for a word or a text. Batches are cut so that one pass handles
about ``PASS_BYTES``; a longer text is a pass of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PASS_BYTES = 1 << 18

_U = np.uint64


def give_back() -> None:
    """Return freed memory to the system: workers are kept between tasks and share a node with others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser: a bijection of 64-bit words."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def spread(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit words."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=_U) + _U(seed)) * _U(0x9E3779B97F4A7C15))


_BYTE = spread(256, 1 << 20)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of letters: a-z, A-Z and all of non-ASCII characters.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
_BASE, _STEP = int(spread(1, 77)[0]) | 1, _U(int(spread(1, 78)[0]) | 1)
_powers = (np.ones(1, _U), np.ones(1, _U))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, ``n`` at least."""
    global _powers
    if len(_powers[0]) < n:
        n = max(n, 1 << 16)
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, base & (2**64 - 1), _U)
            p[0] = 1
            with np.errstate(over="ignore"):
                made.append(np.multiply.accumulate(p))
        _powers = (made[0], made[1])
    return _powers


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string array as UTF-8 bytes and row offsets; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def passes(texts: pa.Array, limit: int = PASS_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``limit`` bytes: (first row, end row, bytes, offsets)."""
    data, offsets = buffers(texts)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Words:
    """The words of a pass: byte spans, 64-bit hashes, and the words of row r at first[r]:first[r+1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = _WORD) -> None:
        """``inside`` tells which bytes belong to words."""
        n = len(data)
        self.data, self.offsets = data, offsets
        self.first = np.zeros(len(offsets), np.int64)
        self.starts = self.ends = np.zeros(0, np.int64)
        self.hashes = np.zeros(0, _U)
        if not n:
            return
        word = inside[data]
        before = np.empty(n, bool)
        before[0], before[1:] = False, word[:-1]
        before[offsets[:-1][offsets[:-1] < n]] = False
        after = np.empty(n, bool)
        after[-1], after[:-1] = False, word[1:]
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        up, down = powers(n + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, _U)
            np.cumsum(_BYTE[_LOWER[data]] * up[:n], out=sums[1:])
            raw = (sums[self.ends] - sums[self.starts]) * down[self.starts]
            self.hashes = mix(raw + (self.ends - self.starts).astype(_U) * _STEP)
        self._sums, self._down = sums, down

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def prefixes(self, size: int) -> np.ndarray:
        """Hashes of each word's first ``size`` bytes."""
        if not len(self.starts):
            return self.hashes
        end = np.minimum(self.starts + size, self.ends)
        with np.errstate(over="ignore"):
            return mix((self._sums[end] - self._sums[self.starts]) * self._down[self.starts] ^ _STEP)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def shingles(self, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, row, first word) of each k-word shingle; a row of 1 to k-1 words has one, of them all."""
        w, first = self.hashes, self.first
        counts = np.diff(first)
        made = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
        row = np.repeat(np.arange(len(counts)), made)
        ends = np.cumsum(made)
        at = np.arange(len(row)) - np.repeat(ends - made, made) + np.repeat(first[:-1], made)
        with np.errstate(over="ignore"):
            padded = np.concatenate([w, np.zeros(k, _U)])
            h = padded[at]
            last = np.repeat(first[1:], made)
            for j in range(1, k):
                inside = at + j < last
                h = np.where(inside, h * _STEP + padded[np.minimum(at + j, len(padded) - 1)], h)
            h = mix(h + _U(k))
        return h, row, at

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each row's word sequence, as two 64-bit words; rows without words give 0, 0."""
        counts = np.diff(self.first)
        full = np.flatnonzero(counts)
        out = (np.zeros(len(counts), _U), np.zeros(len(counts), _U))
        if len(full):
            up, _ = powers(int(counts.max()) + 1)
            place = np.arange(len(self.hashes)) - np.repeat(self.first[:-1], counts)
            with np.errstate(over="ignore"):
                for o, salt in zip(out, spread(2, 99)):
                    term = mix(self.hashes ^ salt) * up[place]
                    o[full] = mix(np.add.reduceat(term, self.first[:-1][full]) + counts[full].astype(_U))
        return out


def distinct_by_row(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row, end to end, and the rows' offsets."""
    at = np.searchsorted(row, np.arange(rows + 1))
    out = h.copy()
    for a, b in zip(at[:-1], at[1:]):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    out = out[new]
    return out, np.searchsorted(row[new], np.arange(rows + 1))


def pack(values: np.ndarray) -> bytes:
    """Sorted distinct uint32 as the first, then differences in as few whole bytes as all fit in."""
    if not len(values):
        return b""
    values = values.astype(np.uint32)
    gaps = np.diff(values, prepend=np.uint32(0))
    width = max(1, -(-int(gaps.max()).bit_length() // 8))
    return bytes([width]) + np.ascontiguousarray(gaps.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    """The reverse of ``pack``."""
    if not packed:
        return np.zeros(0, np.uint32)
    width = packed[0]
    raw = np.frombuffer(packed, np.uint8, offset=1).reshape(-1, width)
    wide = np.zeros((len(raw), 4), np.uint8)
    wide[:, :width] = raw
    return np.cumsum(wide.view("<u4").ravel(), dtype=np.uint32)
