"""Vectorised text kernels over Arrow string columns.

Everything here works on the UTF-8 bytes of many documents at once with numpy,
in slices of bounded size, so that no Python loop runs per word.  A word is a
run of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 is the same as
``[^\\x20\\x09-\\x0D]+`` over characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that one kernel call works on, so that its arrays stay in cache; a longer document is a slice of its own.
SLICE_BYTES = 1 << 18
#: Bytes up to which tables of powers are kept (16 bytes each in every worker).
TABLE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class Texts(NamedTuple):
    """``data``: bytes of the documents one after another; ``bounds``: n+1 offsets; ``valid``: false for null."""

    data: np.ndarray
    bounds: np.ndarray
    valid: np.ndarray

    @property
    def n(self) -> int:
        return len(self.bounds) - 1


class Words(NamedTuple):
    """Words of a slice: byte ranges, document of each word, first word of each document (n+1 offsets)."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    bounds: np.ndarray


def texts_of(column: pa.Array) -> Texts:
    """Bytes, offsets and validity of an Arrow string column (null counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    valid = np.asarray(column.is_valid().to_numpy(zero_copy_only=False), dtype=bool)
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    bounds = np.frombuffer(offsets, dtype=np.int64, count=n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(raw[bounds[0] : bounds[-1]], bounds - bounds[0], valid)


def slices(texts: Texts, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """Consecutive runs of documents of at most ``limit`` bytes, or one longer document."""
    first = 0
    while first < texts.n:
        last = int(np.searchsorted(texts.bounds, texts.bounds[first] + limit, side="right")) - 1
        last = max(first + 1, min(last, texts.n))
        b = texts.bounds[first : last + 1]
        yield first, last, Texts(texts.data[b[0] : b[-1]], b - b[0], texts.valid[first:last])
        first = last


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return _LOWER[data]


def words_of(texts: Texts) -> Words:
    """All words; a document boundary always ends a word."""
    data, bounds = texts.data, texts.bounds
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] = inside[inner]
    ends[inner - 1] = inside[inner - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    at = np.searchsorted(start, bounds, side="left")
    return Words(start, end, np.repeat(np.arange(texts.n), np.diff(at)), at)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    filled, step = 1, np.array([base], dtype=np.uint64)  # an array, so that wrapping is silent
    while filled < n:
        more = min(filled, n - filled)
        out[filled : filled + more] = out[:more] * step
        step = step * step
        filled += more
    return out[:n]


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = TABLE_BYTES + 1
    if n > size:
        return powers(_BASE, n), powers(_INVERSE, n)
    if size not in _POWERS:
        _POWERS[size] = powers(_BASE, size), powers(_INVERSE, size)
    a, b = _POWERS[size]
    return a[:n], b[:n]


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, words: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from one prefix sum over the slice."""
    if not len(words.start):
        return np.zeros(0, np.uint64)
    up, down = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODE[data] * up[:-1], out=sums[1:])
    value = (sums[words.end] - sums[words.start]) * down[words.start]
    return mix(value ^ (words.end - words.start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def window_hashes(hashes: np.ndarray, bounds: np.ndarray, k: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows inside documents, and n+1 offsets of each document's windows.

    ``short``: a document of 1 to k-1 words has one window, its whole sequence.
    """
    counts = np.diff(bounds)
    n_windows = np.maximum(counts - k + 1, 0)
    if short:
        n_windows = np.where((counts > 0) & (counts < k), 1, n_windows)
    at = np.concatenate([[0], np.cumsum(n_windows)])
    total = int(at[-1])
    if not total:
        return np.zeros(0, np.uint64), at
    doc = np.repeat(np.arange(len(counts)), n_windows)
    first = bounds[doc] + (np.arange(total) - at[doc])
    out = np.zeros(total, dtype=np.uint64)
    last = bounds[doc + 1]
    for j in range(k):
        i = first + j
        inside = i < last
        h = np.where(inside, hashes[np.minimum(i, len(hashes) - 1)], np.uint64(0x5851F42D4C957F2D))
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + h)
    return out, at


def distinct_in_docs(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document, with n+1 offsets."""
    if not len(values):
        return values, np.zeros(len(at), dtype=np.int64)
    values = values.copy()
    edges = at.tolist()
    for first, last in zip(edges[:-1], edges[1:], strict=True):
        values[first:last].sort()
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = values[1:] != values[:-1]
    keep[at[:-1][at[:-1] < len(values)]] = True
    return values[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def shingle_sets(texts: Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each document's k-word shingles over lower-cased words."""
    data = lowered(texts.data)
    words = words_of(texts)
    windows, at = window_hashes(word_hashes(data, words), words.bounds, k, short=True)
    return distinct_in_docs(windows, at)


def sums_in_docs(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of each document's values (wrapping for unsigned integers)."""
    sums = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return sums[at[1:]] - sums[at[:-1]]
