"""Vectorised text primitives over Arrow string columns.

A batch of texts is one UTF-8 buffer plus offsets; words, hashes and
shingles of all its texts are computed with numpy at once. Words are runs
of bytes outside ``\\x20 \\x09-\\x0D``. Temporary arrays cover ``PIECE``
bytes at a time, so one long text needs no more working memory than many
short ones (beyond its own bytes and its list of words).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

BASE = np.uint64(0x9E3779B97F4A7C15)   # odd, so invertible modulo 2**64
_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * _C1
    h = h ^ (h >> np.uint64(33))
    h = h * _C2
    return h ^ (h >> np.uint64(33))


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    col = pa.array([], pa.large_string()) if len(col) == 0 else col.fill_null("").cast(pa.large_string())
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[col.offset: col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0]: offsets[-1]] if data else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = PIECE):
    """Ranges (lo, hi) of texts with about ``limit`` bytes each, one text at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, counts): byte spans of all words and the number per text."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~_SPACE[data]
    cut = np.zeros(n + 1, dtype=bool)      # a text starts here
    cut[offsets] = True
    cut[0] = cut[n] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:n]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    at = np.searchsorted(starts, offsets)
    return starts, ends, np.diff(at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes (starts ascending, no overlaps)."""
    out = np.empty(len(starts), dtype=np.uint64)
    if not len(starts):
        return out
    size = np.cumsum(ends - starts)
    lo = 0
    while lo < len(starts):
        done = size[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, done + PIECE, "right")))
        s, lens = starts[lo:hi], (ends - starts)[lo:hi]
        base = np.cumsum(lens) - lens
        pos = np.arange(int(lens.sum())) - np.repeat(base, lens)
        got = data[pos + np.repeat(s, lens)].astype(np.uint64)
        got += np.uint64(1)
        got *= powers(int(lens.max()))[pos]
        out[lo:hi] = np.add.reduceat(got, base)
        lo = hi
    return mix(out)


def ngram_hashes(h: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` consecutive words at every word position, and whether
    the n words are all in the position's own text."""
    if len(h) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    text = np.repeat(np.arange(len(counts)), counts)
    left = np.cumsum(counts)[text] - np.arange(len(h))
    out = np.zeros(len(h), dtype=np.uint64)
    for k, p in enumerate(powers(n, np.uint64(0xD6E8FEB86659FD93))):
        out[: max(0, len(h) - k)] += h[k:] * p
    return mix(out), left >= n


def rows(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    return text_buffer(batch.column(batch.schema.get_field_index(name)))
