"""n-grams of whole Arrow batches as numbers (T3-T6): no string per occurrence, no Python object per row.

A batch has few distinct symbols (words, or characters).  An n-gram is the number whose digits, to the base of the
symbols, are its symbols; shorter n-grams end in zeros.  Counting is sorting whole numbers; strings are made for the
distinct n-grams that are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18                 # symbols handled at once, unless one row has more
_SPACES = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
                    0x202F, 0x205F, 0x3000])
_IS_SPACE = np.zeros(0x110000, bool)
_IS_SPACE[_SPACES] = True


@dataclass
class Grams:
    """Occurrences of the n-grams of some rows: ``row`` and ``key`` (digits to the base ``len(symbols) + 1``)."""

    row: np.ndarray
    key: np.ndarray
    symbols: pa.Array
    size: int                   # digits of a key
    between: str                # what joins symbols
    n_rows: int
    whole: bool = False         # every n-gram is a symbol

    @property
    def base(self) -> int:
        return len(self.symbols) + 1

    def strings(self, key: np.ndarray) -> pa.Array:
        cols, rest = [], key
        for _ in range(self.size):
            digit, rest = rest % self.base, rest // self.base
            cols.append(self.symbols.take(pa.array(digit - 1, mask=digit == 0)))
        return pc.binary_join_element_wise(*reversed(cols), self.between, null_handling="skip")

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, key) of what occurs, each once."""
        span = self.base ** self.size
        both, _ = runs(self.row * span + self.key)
        return both // span, both % span

    def totals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct keys, rows that hold each, occurrences of each)."""
        key, cf = runs(self.key)
        _, df = runs(self.pairs()[1])
        return key, df, cf

    def codes(self, terms: list[str]) -> np.ndarray:
        """Index in ``terms`` of every occurrence, -1 if it is not there."""
        terms = [[t] if self.whole else t.split(self.between) if self.between else list(t) for t in terms]
        size = np.array([len(t) for t in terms], np.int64)
        digit = np.zeros((len(terms), self.size), np.int64)
        fits = size <= self.size
        row = np.repeat(np.arange(len(terms)), size)
        place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        at = pc.index_in(pa.array([s for t in terms for s in t], pa.string()), value_set=self.symbols)
        at = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        fits &= np.bincount(row, at == 0, len(terms)) == 0 if len(row) else size > 0
        inside = fits[row]
        digit[row[inside], place[inside]] = at[inside]
        known = np.flatnonzero(fits)
        if not len(known) or not len(self.key):
            return np.full(len(self.key), -1)
        value = digit[known] @ self.base ** np.arange(self.size - 1, -1, -1, dtype=np.int64)
        order = np.argsort(value)
        value, known = value[order], known[order]
        i = np.minimum(np.searchsorted(value, self.key), len(value) - 1)
        return np.where(value[i] == self.key, known[i], -1)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values in order, how often each occurs)."""
    s = np.sort(values)
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    return s[first], np.diff(np.append(first, len(s)))


def _whole(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _pieces(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of bounded pieces."""
    size = pc.binary_length(column) if pa.types.is_string(column.type) else column.value_lengths()
    upto = np.cumsum(size.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(column):
        z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PIECE, "right")))
        yield a, column.slice(a, z - a)
        a = z


def word_grams(tokens: pa.Array, lo: int, hi: int) -> Grams | None:
    """n-grams of the rows of words, or None if their keys do not fit a number."""
    flat = tokens.flatten().dictionary_encode()
    words = flat.dictionary.cast(pa.string())
    base = len(words) + 1
    if base ** hi * max(len(tokens), 1) >= 1 << 62:
        return None
    code = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    row = np.repeat(np.arange(len(tokens), dtype=np.int64), tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return Grams(*_keys(code, row, row, base, lo, hi), words, hi, " ", len(tokens))


def char_grams(text: pa.Array, lo: int, hi: int) -> Grams | None:
    """n-grams of the characters of each word of the rows, padded by one space on both sides, or None if their keys do
    not fit a number."""
    text = pc.fill_null(text.cast(pa.string()), "")
    cut = np.frombuffer(text.buffers()[1], np.int32)[text.offset:text.offset + len(text) + 1].astype(np.int64)
    body = text.buffers()[2]
    body = np.frombuffer(body, np.uint8)[cut[0]:cut[-1]] if body is not None else np.zeros(0, np.uint8)
    cut = cut - cut[0]
    if len(body) and body.max() > 127:
        cut = np.append(0, np.cumsum((body & 0xC0) != 0x80))[cut]
        body = np.frombuffer(body.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    is_char = ~_IS_SPACE[body]
    first = np.zeros(len(body) + 1, bool)
    first[cut] = True
    starts = np.flatnonzero(is_char & (first[:-1] | ~np.append(False, is_char[:-1]))) if len(body) else np.zeros(0, np.int64)
    ends = np.flatnonzero(is_char & (first[1:] | ~np.append(is_char[1:], False))) + 1 if len(body) else starts
    seen = np.zeros(int(body.max()) + 1 if len(body) else 1, np.int64)
    seen[body[is_char]] = 1
    points = np.flatnonzero(seen)
    symbols = pa.array([" ", *map(chr, points)], pa.string())
    base = len(symbols) + 1
    if base ** hi * max(len(text), 1) >= 1 << 62:
        return None
    size = ends - starts
    code = np.ones(int(size.sum()) + 2 * len(size), np.int64)                 # 1: the space
    seen[points] = np.arange(len(points)) + 2
    code[np.arange(int(size.sum())) + 2 * np.repeat(np.arange(len(size)), size) + 1] = seen[body[is_char]]
    row = np.searchsorted(cut, starts, "right") - 1
    return Grams(*_keys(code, np.repeat(np.arange(len(size)), size + 2), np.repeat(row, size + 2), base, lo, hi), symbols, hi, "", len(text))


def _keys(code: np.ndarray, run: np.ndarray, row: np.ndarray, base: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all n-grams within a run."""
    rows, keys = [], []
    key, n_all = code * base ** (hi - 1), len(code)
    for n in range(1, hi + 1):
        if n > 1:
            key = key[:max(n_all - n + 1, 0)] + code[n - 1:] * base ** (hi - n)
        if n >= lo:
            inside = run[:len(key)] == run[n - 1:]
            rows.append(row[:len(key)][inside])
            keys.append(key[inside])
    return np.concatenate(rows), np.concatenate(keys)


def _one_row(column: pa.Array, lo: int, hi: int, chars: bool) -> Grams:
    """A row whose keys fit no number: its n-grams as symbols of their own."""
    words = column[0].as_py() or []
    if chars:
        padded = [f" {''.join(chr(c) for c in w)} " for w in _split(words or "")]
        grams = [w[i:i + n] for w in padded for n in range(lo, hi + 1) for i in range(len(w) - n + 1)]
    else:
        grams = [" ".join(words[i:i + n]) for n in range(lo, hi + 1) for i in range(len(words) - n + 1)]
    flat = pa.array(grams, pa.string()).dictionary_encode()
    code = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    return Grams(np.zeros(len(code), np.int64), code, flat.dictionary, 1, "", 1, True)


def _split(text: str) -> list[list[int]]:
    out: list[list[int]] = [[]]
    for c in map(ord, text):
        if _IS_SPACE[c]:
            out.append([])
        else:
            out[-1].append(c)
    return [w for w in out if w]


def grams(column: pa.Array | pa.ChunkedArray, lo: int, hi: int, chars: bool) -> Iterator[tuple[int, Grams]]:
    """(first row, n-grams) of bounded pieces of a column of texts (``chars``) or of lists of words."""
    todo = list(_pieces(_whole(column)))[::-1]
    while todo:
        a, part = todo.pop()
        g = (char_grams if chars else word_grams)(part, lo, hi)
        if g is None and len(part) > 1:
            half = len(part) // 2
            todo += [(a + half, part.slice(half)), (a, part.slice(0, half))]
        else:
            yield a, g if g is not None else _one_row(part, lo, hi, chars)
