"""Vectorised words of an Arrow string column.

The text buffer of an Arrow column holds all texts of a batch back to back, so
words, their hashes and their shingles come from a few NumPy passes over bytes.
A word class that treats every byte from 0x80 up as part of a word is exact on
UTF-8, where those bytes only occur inside non-ASCII characters.

Words and shingles are identified by 64-bit hashes (keyed polynomial, then a
mixing step). Work runs over row groups of a few MB, so the memory of a task
does not follow the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
SEGMENT = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit finaliser (xor-shift and multiply); ``seed`` selects an independent hash."""
    x = (np.asarray(x, dtype=U64) + U64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF))
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_HASH = mix(np.arange(256, dtype=U64), 77)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def not_blank() -> np.ndarray:
    """Word bytes of ``[^\\x20\\x09-\\x0D]+``."""
    lut = np.ones(256, dtype=bool)
    lut[[0x20, *range(0x09, 0x0E)]] = False
    return lut


def alphanumeric() -> np.ndarray:
    """Word bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z (digits, a-z, non-ASCII)."""
    lut = np.zeros(256, dtype=bool)
    lut[0x30:0x3A] = lut[0x61:0x7B] = lut[0x41:0x5B] = lut[0x80:] = True
    return lut


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, at least ``n`` of each."""
    if not _powers or len(_powers["up"]) < n:
        inverse = pow(BASE, -1, 1 << 64)
        for name, b in (("up", BASE), ("down", inverse)):
            p = np.full(n, b, dtype=U64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p, dtype=U64)
    return _powers["up"], _powers["down"]


@dataclass
class Words:
    """Words of a row group: byte range, hash and row of each, and the first word of each row."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # len rows + 1: words of row r are first[r]:first[r + 1]
    prefix: np.ndarray | None = None  # words x lengths: hashes of the first bytes, 0 for a word that is no longer

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null row is an empty range."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:
        fill = column.fill_null("")
        return text_buffer(fill)
    return data, offsets


def row_groups(offsets: np.ndarray, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes (one row at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(data: np.ndarray, bounds: np.ndarray, lut: np.ndarray, prefixes: tuple[int, ...] = ()) -> Words:
    """Words of the rows whose byte ranges are ``bounds[r]:bounds[r + 1]``, hashed with A-Z lower-cased."""
    lo, hi = int(bounds[0]), int(bounds[-1])
    starts, ends, hashes, stems = [], [], [], []
    edges = np.unique(bounds)
    at = lo
    while at < hi:
        to = min(at + SEGMENT, hi)
        if to < hi:  # cut behind the last non-word byte, or extend to the next one
            blank = np.flatnonzero(~lut[data[at:to]])
            while not len(blank) and to < hi:
                to = min(to + SEGMENT, hi)
                blank = np.flatnonzero(~lut[data[at:to]])
            if len(blank) and to < hi:
                to = at + int(blank[-1]) + 1
        seg = data[at:to]
        is_word = lut[seg]
        begins = is_word.copy()
        begins[1:] &= ~is_word[:-1]
        cuts = edges[(edges > at) & (edges < to)] - at
        begins[cuts] = is_word[cuts]
        stops = np.zeros(len(seg) + 1, dtype=bool)
        stops[1:-1] = is_word[:-1] & ~is_word[1:]
        stops[cuts] |= is_word[cuts - 1]
        stops[-1] = is_word[-1]
        s, e = np.flatnonzero(begins), np.flatnonzero(stops)
        up, down = powers(len(seg) + 1)
        acc = np.zeros(len(seg) + 1, dtype=U64)
        np.cumsum(BYTE_HASH[LOWER[seg]] * up[: len(seg)], out=acc[1:])
        hashes.append(mix((acc[e] - acc[s]) * down[s] + (e - s).astype(U64)))
        if prefixes:
            some = np.zeros((len(s), len(prefixes)), dtype=U64)
            for k, n in enumerate(prefixes):
                long = np.flatnonzero(e - s > n)
                some[long, k] = mix((acc[s[long] + n] - acc[s[long]]) * down[s[long]] + U64(n), 40)
            stems.append(some)
        starts.append(s + at)
        ends.append(e + at)
        at = to
    if not starts:
        empty = np.zeros(0, dtype=np.int64)
        return Words(empty, empty, empty.astype(U64), np.zeros(len(bounds), dtype=np.int64),
                     np.zeros((0, len(prefixes)), dtype=U64) if prefixes else None)
    start = np.concatenate(starts)
    return Words(start, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(start, bounds),
                 np.concatenate(stems) if prefixes else None)


def shingle_sets(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of each row: (values sorted within rows, first index of each row).

    A shingle is ``size`` consecutive words; a row with fewer words, but not
    none, has its whole sequence as its only shingle.
    """
    counts = np.diff(w.first)
    n = len(w.hash)
    rows = np.repeat(np.arange(len(counts)), counts)
    h = np.zeros(n, dtype=U64)
    left = (np.repeat(w.first[1:], counts) - np.arange(n)) if n else np.zeros(0, dtype=np.int64)
    length = np.minimum(left, size)
    for k in range(size):
        ok = length > k
        idx = np.flatnonzero(ok)
        h[idx] = h[idx] * U64(BASE) + mix(w.hash[idx + k], 5)
    is_first = np.zeros(n, dtype=bool)
    is_first[w.first[:-1][counts > 0]] = True
    keep = (left >= size) | (is_first & (np.repeat(counts, counts) < size))
    h = mix(h[keep] + length[keep].astype(U64), 9)
    rows = rows[keep]
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    h, rows = h[fresh], rows[fresh]
    return h, np.searchsorted(rows, np.arange(len(counts) + 1))
