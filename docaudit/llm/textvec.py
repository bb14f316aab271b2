"""Vectorised hashing of words and shingles of Arrow text columns (numpy, inside tasks).

A word is a run of bytes other than the six ASCII blanks, with A-Z lower-cased.
Its fingerprint is a 64-bit polynomial hash over random byte values, taken for
all words of a batch from one running sum, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_PLACE = _RNG.integers(1, 2**63, 6, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Bytes of text that are hashed at once (a longer single text is taken alone).
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    col = texts.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(col) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def row_chunks(texts: pa.Array, rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, byte offsets by row) for runs of at most ``rows`` rows of about CHUNK bytes."""
    raw, at = text_bytes(texts)
    first, n = 0, len(texts)
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + CHUNK, "right")) - 1)
        last = min(last, first + rows, n)
        yield first, last - first, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def word_chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, word hashes, word offsets by row) for runs of rows of about CHUNK bytes."""
    for first, n, raw, at in row_chunks(texts):
        start, end = word_spans(raw, at)
        yield first, n, word_hashes(raw, start, end), np.searchsorted(start, at)


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end bytes of all words; a row's end ends a word."""
    inside = ~_SPACE[raw]
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = at[:-1][at[:-1] < len(raw)]
    begins[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    lasts = at[1:][at[1:] > 0] - 1
    ends[lasts] = inside[lasts]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of words, A-Z as a-z."""
    up, down = _powers(len(raw) + 1)
    run = np.empty(len(raw) + 1, np.uint64)
    run[0] = 0
    np.cumsum(_BYTE[_LOWER[raw]] * up[:-1], out=run[1:])
    return mix((run[end] - run[start]) * down[start])


def byte_ngrams(raw: np.ndarray, at: np.ndarray, dims: int, orders: tuple[int, ...] = (1, 2, 3)) -> np.ndarray:
    """Rows of hashed byte n-gram counts (rows x dims, float32); n-grams do not cross rows.  ``dims`` is a power of two."""
    n = len(at) - 1
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(at))
    shift = np.uint32(32 - (dims.bit_length() - 1))
    out = np.zeros(n * dims, np.float32)
    code = np.zeros(len(raw), np.uint32)
    wide = raw.astype(np.uint32)
    for order in range(1, max(orders) + 1):
        left = len(raw) - order + 1
        if left <= 0:
            break
        code = code[:left] * np.uint32(257) + wide[order - 1 :] + np.uint32(1)
        if order in orders:
            h = ((code ^ np.uint32(order * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)) >> shift
            own = row[:left] == row[order - 1 :]
            out += np.bincount(row[:left][own] * np.int64(dims) + h[own], minlength=n * dims)
    return out.reshape(n, dims)


def unit_roots(counts: np.ndarray) -> np.ndarray:
    """Square roots of counts, each row scaled to length one (zero rows stay zero)."""
    x = np.sqrt(counts)
    norm = np.sqrt(counts.sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def shingles(words: np.ndarray, at: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, offsets by row): runs of ``k`` words; a shorter text with words is one shingle."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    left = np.repeat(at[1:], np.diff(at)) - np.arange(n)
    valid = left >= k
    valid[at[:-1][np.diff(at) > 0]] = True
    total = np.minimum(left, k).astype(np.uint64) * _PLACE[5]
    for i in range(k):
        total[: n - i] += np.where(left[: n - i] > i, words[i:], np.uint64(0)) * (_PLACE[i % 5] + np.uint64(2 * (i // 5)))
    counts = np.zeros(n + 1, np.int64)
    np.cumsum(valid, out=counts[1:])
    return mix(total[valid]), counts[at]


def pack_rows(x: np.ndarray) -> pa.Array:
    """Feature rows as bytes: 16-bit columns and half-precision values of what is not zero."""
    out = []
    for row in x:
        at = np.flatnonzero(row)
        out.append(at.astype("<u2").tobytes() + row[at].astype("<f2").tobytes())
    return pa.array(out, pa.binary())


def unpack_rows(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """The float32 matrix of packed rows with a last column of ones; the one large array that is made."""
    x = np.zeros((len(column), dims + 1), np.float32)
    x[:, -1] = 1
    for i, item in enumerate(column):
        raw = item.as_buffer()
        n = raw.size // 4
        x[i, np.frombuffer(raw, "<u2", n)] = np.frombuffer(raw, "<f2", n, 2 * n)
    return x
