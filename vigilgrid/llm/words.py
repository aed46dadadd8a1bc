"""Vectorised bytes, words and word shingles of text columns, for use inside tasks.

Texts of a batch lie end to end in one byte array. Words are runs of bytes other than space and
0x09-0x0D; letters A-Z are lowered for hashing. A word's hash is a slice of a polynomial prefix sum.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.random.default_rng(20240607).integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_VALUES = np.random.default_rng(20240608).integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWERED_VALUES = _BYTE_VALUES[_LOWER]
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, inverse: bool = False, known: dict[bool, np.ndarray] = {}) -> np.ndarray:
    """Powers 0..n of the base, or of its inverse, modulo 2**64; kept up to the size of a slice."""
    if len(known.get(inverse, ())) <= n:
        out = np.full(max(n, SLICE_BYTES // 2) + 1, pow(_BASE, -1, 1 << 64) if inverse else _BASE, np.uint64)
        out[0] = 1
        out = np.multiply.accumulate(out)
        if n > SLICE_BYTES:
            return out[:n + 1]
        known[inverse] = out
    return known[inverse][:n + 1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end and each text's offset; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def slices(batches: Iterable[pa.RecordBatch], text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows of about ``size`` bytes of text; a longer text stands alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, at = text_bytes(batch.column(text))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


@dataclass
class Words:
    """Words of a batch: byte bounds, row and hash; ``first[r]`` is row r's first word."""

    raw: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    first: np.ndarray
    hashes: np.ndarray


def _marks(raw: np.ndarray) -> np.ndarray:
    """Bytes of ASCII marks and of U+2000-U+203F, typographic quotes and dashes among them."""
    marks = _MARK[raw]
    at = np.flatnonzero((raw[:-2] == 0xE2) & (raw[1:-1] == 0x80)) if len(raw) > 2 else np.zeros(0, np.int64)
    for i in range(3):
        marks[at + i] = True
    return marks


def words_of(column: pa.Array, bare: bool = False, space: np.ndarray = _SPACE) -> Words:
    """``bare`` words are hashed without the marks at their edges; words of marks alone are left out.
    ``space`` tells for every byte value whether it parts words."""
    raw, offsets = text_bytes(column)
    n = len(raw)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~space[raw]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    heads, tails = starts, ends
    if bare:
        core = np.flatnonzero(inside[1:-1] & ~_marks(raw))
        i, j = np.searchsorted(core, starts), np.searchsorted(core, ends)
        has = i < j
        starts, ends, heads, tails = starts[has], ends[has], core[i[has]], core[j[has] - 1] + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    first = np.searchsorted(starts, offsets, "left")
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LOWERED_VALUES[raw] * powers(n)[:n], out=sums[1:])
    hashes = mixed((sums[tails] - sums[heads]) * powers(n, inverse=True)[heads] + (tails - heads).astype(np.uint64))
    return Words(raw, offsets, starts, ends, rows, first, hashes)


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``width`` words; a row with fewer words gives its whole sequence."""
    h, first = words.hashes, words.first
    counts = np.diff(first)
    if len(h) >= width:
        runs = sum(h[i:len(h) - width + 1 + i] * _MIX[i] for i in range(width))
        whole = words.rows[:len(runs)] == words.rows[width - 1:]
        runs, rows = runs[whole], words.rows[:len(runs)][whole]
    else:
        runs, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        few = np.zeros(len(short), np.uint64)
        for i in range(width - 1):
            has = counts[short] > i
            few[has] += h[first[short[has]] + i] * _MIX[i]
        few += counts[short].astype(np.uint64) * _MIX[15]
        runs, rows = np.concatenate([runs, few]), np.concatenate([rows, short])
    return mixed(runs), rows


def distinct_by_row(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value) pairs, ordered by row and value."""
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[new], rows[new]
