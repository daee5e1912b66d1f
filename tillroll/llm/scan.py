"""Vectorised scanning of Arrow text columns with numpy, used inside Spark tasks.

Substring names: a table value per byte times a power of an odd base, summed modulo 2**64 by one running sum;
the name of any substring is a difference of two sums. Names are used in pairs (128 bits) where a
false match would change a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
#: bytes of text that one vectorised step handles at once
SLAB = 1 << 20
U = np.uint64


def _splitmix(n: int, seed: int) -> np.ndarray:
    x = np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = _splitmix(256, 77)
LOWER = np.arange(256)
LOWER[65:91] += 32
BYTE_LOWER = BYTE[LOWER]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_POWERS = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i (mod 2**64) for i < n."""
    if len(_POWERS[0]) < n:
        m = max(n, 2 * SLAB)
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            x = np.full(m, b, U)
            x[0] = 1
            _POWERS[k] = np.cumprod(x, dtype=U)
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    return h ^ (h >> U(29))


def running(buf: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """Running sums c with c[0] = 0; see :func:`span`."""
    pw, _ = powers(len(buf) + 1)
    c = np.empty(len(buf) + 1, U)
    c[0] = 0
    np.cumsum(table[buf] * pw[:len(buf)], dtype=U, out=c[1:])
    return c


def span(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Names of the substrings [start, end)."""
    _, ipw = powers(len(c))
    return mix((c[end] - c[start]) * ipw[start])


def spans_of(buf: np.ndarray, start: np.ndarray, length: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pair of names (first half, second half) of buf[s:s+length] for each s, in steps of bounded memory."""
    length = np.broadcast_to(np.asarray(length, np.int64), start.shape)
    mid, end = start + length // 2, start + length
    if len(buf) <= 8 * SLAB or not len(start):
        c = running(buf)
        return span(c, start, mid), span(c, mid, end)
    a, b = np.empty(len(start), U), np.empty(len(start), U)
    order = np.argsort(start, kind="stable")
    at, halo = start[order], int(length.max())
    for lo in range(0, len(buf), SLAB):
        i, j = np.searchsorted(at, [lo, lo + SLAB])
        if i < j:
            c, x = running(buf[lo:lo + SLAB + halo]), order[i:j]
            a[x], b[x] = span(c, start[x] - lo, mid[x] - lo), span(c, mid[x] - lo, end[x] - lo)
    return a, b


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = pc.fill_null(col, b"")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def slabs(off: np.ndarray, limit: int = SLAB) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most ``limit`` bytes, or of one longer row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the words (runs of other bytes than space and 0x09-0x0D, A-Z lowered) of rows buf[off[i]:off[i+1]],
    and for each row the index of its first word (one more entry at the end)."""
    if len(buf) == 0:
        return np.zeros(0, U), np.zeros(len(off), np.int64)
    ink = ~SPACE[buf]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(buf))]
    first[inner] = ink[inner]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    last[inner - 1] = ink[inner - 1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    c = running(buf, BYTE_LOWER)
    w = span(c, start, end) + (end - start).astype(U)
    return w, np.searchsorted(start, off)


def row_words(data: np.ndarray, off: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`words` of rows i..j-1; a single long row is cut at white space into steps of bounded memory."""
    lo, hi = int(off[i]), int(off[j])
    if hi - lo <= 2 * SLAB or j - i > 1:
        return words(data[lo:hi], off[i:j + 1] - lo)
    parts, at = [], lo
    while at < hi:
        end = min(at + SLAB, hi)
        if end < hi:
            gap = np.flatnonzero(SPACE[data[end:hi]][:64 * SLAB])
            end = end + int(gap[0]) if len(gap) else hi
        parts.append(words(data[at:end], np.array([0, end - at]))[0])
        at = end
    w = np.concatenate(parts) if parts else np.zeros(0, U)
    return w, np.array([0, len(w)])


def grams(w: np.ndarray, k: int) -> np.ndarray:
    """Names of the k-word shingles starting at each word (row borders are not looked at)."""
    n = len(w) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    h = w[:n].copy()
    for i in range(1, k):
        h *= U(0xD6E8FEB86659FD93)
        h += w[i:i + n]
    return mix(mix(h))


def shingle_sets(data: np.ndarray, off: np.ndarray, i: int, j: int, k: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct shingle names of each of the rows i..j-1: k-word shingles; a row of fewer words
    has its whole sequence as one shingle, a row without words none."""
    w, first = row_words(data, off, i, j)
    g = grams(w, k)
    for r in range(j - i):
        a, b = int(first[r]), int(first[r + 1])
        if b - a >= k:
            x = np.sort(g[a:b - k + 1])
            yield x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif b > a:
            yield grams(w[a:b], b - a) ^ U(b - a)
        else:
            yield np.zeros(0, U)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U, copy=False).view(np.int64)
