"""Vectorised word handling over Arrow string columns.

Python workers get texts as Arrow buffers; words are found, lower-cased and
hashed with NumPy over the raw UTF-8 bytes, many documents at a time, so there
is no Python object per word. All byte classes used here are ASCII-only or
"every byte from 0x80", which never splits a multi-byte character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; bounds a worker's working memory.
BLOCK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV_BASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = []


def byte_class(separators: bytes) -> np.ndarray:
    """Table byte -> True where the byte belongs to a word."""
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: `[^\x20\x09-\x0D]+`
SPACE_WORDS = byte_class(bytes([0x20, *range(0x09, 0x0E)]))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (taken after A-Z became a-z)
ALNUM_WORDS = byte_class(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))

#: Byte -> the byte with A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        size = max(n, BLOCK_BYTES) + 1
        out = []
        for base in (_BASE, _INV_BASE):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _powers[:] = out
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), so that every output bit depends on all input bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, offsets


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes together (one row at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def _segments(raw: np.ndarray, table: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cuts of a long text just after a separator, so that no word is split."""
    a, n = 0, len(raw)
    while a < n:
        b = min(n, a + limit)
        while b < n:
            seps = np.flatnonzero(~table[raw[a:b]])
            if len(seps):
                b = a + int(seps[-1]) + 1
                break
            b = min(n, b + limit)
        yield a, b
        a = b


def words(raw: np.ndarray, bounds: np.ndarray, table: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of consecutive texts.

    `bounds` holds the texts' byte offsets within `raw`, first and last
    included. Returns (hash, start, end) per word, in order; words never cross
    a bound.
    """
    hashes, starts, ends = [], [], []
    for a, b in _segments(raw, table, BLOCK_BYTES) if len(raw) > 2 * BLOCK_BYTES else [(0, len(raw))]:
        part = raw[a:b]
        inside = table[part]
        inner = bounds[(bounds > a) & (bounds < b)] - a
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        before[inner] = False
        after[inner - 1] = False
        s = np.flatnonzero(inside & ~before)
        e = np.flatnonzero(inside & ~after) + 1
        power, inverse = _power_tables(len(part))
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        code = (LOWER[part] if lower else part).astype(np.uint64)
        code += np.uint64(1)
        code *= power[: len(part)]
        np.cumsum(code, out=total[1:])
        h = (total[e] - total[s]) * inverse[s]
        hashes.append(mix(h ^ (e - s).astype(np.uint64)))
        starts.append(s + a)
        ends.append(e + a)
    if not hashes:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position; the last k-1 positions have none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[j : j + n]
    return mix(out)


def word_bounds(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Index of the first word of each text, and the number of words at the end."""
    return np.searchsorted(starts, bounds)


def texts_words(column: pa.Array, table: np.ndarray, lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, text bytes, word hashes, starts, ends) of each text, found block by block."""
    raw, offsets = text_buffers(column)
    for i, j in blocks(offsets):
        base = offsets[i]
        part = raw[base : offsets[j]]
        bounds = offsets[i : j + 1] - base
        h, s, e = words(part, bounds, table, lower)
        at = word_bounds(s, bounds)
        for r in range(i, j):
            x, y = at[r - i], at[r - i + 1]
            lo, hi = bounds[r - i], bounds[r - i + 1]
            yield r, part[lo:hi], h[x:y], s[x:y] - lo, e[x:y] - lo
