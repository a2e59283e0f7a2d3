"""Vectorised word splitting and hashing over Arrow string columns.

A word is a maximal run of characters other than space and U+0009..U+000D.  Both are single bytes in
UTF-8, so splitting works on the raw bytes of the column; nothing is decoded and no Python object per word
is made.  Temporary arrays are bounded by ``CHUNK`` bytes of text at a time, whatever the length of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)     # a random odd number per byte
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]                                                # A-Z hash as a-z
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(int(_BASE), -1, 1 << 64))
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_POWERS: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mixer (bijective)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK + 4096)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, int64 offsets of length rows + 1) of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0]:at[-1]], at - at[0]


def word_spans(body: np.ndarray, at: np.ndarray, letters: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) byte positions of every run of ``letters`` (256 flags) and, per row, its first one
    (rows + 1 entries)."""
    inside = letters[body]
    before = np.zeros(len(body), bool)
    before[1:] = inside[:-1]
    edges = at[1:-1]
    before[edges[edges < len(body)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(body), bool)
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def hash_spans(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hash of each span [start, end); spans are disjoint and ascending."""
    out = np.empty(len(starts), np.uint64)
    table = _LOWER if lower else _BYTE
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK, "right")))
        lo, hi = int(starts[a]), int(ends[b - 1])
        up, down = _powers(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[body[lo:hi]] * up[:hi - lo], out=total[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        out[a:b] = mix64((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        a = b
    return out


def column_words(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all rows in order, first word of each row: rows + 1 entries)."""
    body, at = raw_bytes(column)
    starts, ends, first = word_spans(body, at)
    return hash_spans(body, starts, ends, lower), first


def sequence_hash(words: np.ndarray, width: int, step: int = 1 << 20) -> np.ndarray:
    """Hash of each run of ``width`` consecutive words (over the whole array; callers drop runs
    that cross a row)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(min(n + width, step + width) + 1)
    out = np.empty(n, np.uint64)
    for a in range(0, n, step):
        b = min(n, a + step)
        part = words[a:b + width - 1]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[:len(part)], out=total[1:])
        out[a:b] = mix64((total[width:] - total[:-width]) * down[:b - a] + _U(width))
    return out


def bounded(batches, column: str = "text", limit: int = 8 << 20):
    """The same rows in batches of about ``limit`` bytes of ``column`` (a longer text is a batch alone)."""
    for b in batches:
        at = raw_bytes(b.column(b.schema.get_field_index(column)))[1]
        a = 0
        while a < b.num_rows:
            z = max(a + 1, int(np.searchsorted(at, at[a] + limit, "right")) - 1)
            yield b.slice(a, z - a)
            a = z
