"""Vectorised 64-bit hashes of words and shingles over Arrow text columns.

A block is a run of rows whose texts lie in one byte array; prefix sums of keyed bytes give the hash of any span in
constant time, so a word or shingle costs a few array operations whatever its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK_BYTES = 1 << 20
_U = np.uint64
_STEP = 0x9E3779B97F4A7C15
_KEYS = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_INVERSE = pow(_STEP, -1, 2**64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; works on a copy."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def salt(*parts: int) -> np.uint64:
    return _U(xxhash.xxh64_intdigest(repr(parts).encode()))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_STEP, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def forget_powers() -> None:
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES):
    """(first row, bytes, offsets) for runs of rows of about `limit` bytes; a null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Spans:
    """Hashes of byte spans of one block."""

    def __init__(self, data: np.ndarray):
        self.powers, self.inverse = _power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_KEYS[data] * self.powers[: len(data)], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = self.sums[ends] - self.sums[starts]
        h *= self.inverse[starts]
        return mix(h + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block, and the place of each row's first word (one more at the end)."""
    filled = ~BLANK[data]
    first, last = filled.copy(), filled.copy()
    first[1:] &= ~filled[:-1]
    last[:-1] &= ~filled[1:]
    some = offsets[1:] > offsets[:-1]
    head, tail = offsets[:-1][some], offsets[1:][some] - 1
    first[head] = filled[head]
    last[tail] = filled[tail]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word with A-Z lower-cased, and the place of each row's first word."""
    data = LOWER[data]
    starts, ends, place = words(data, offsets)
    return Spans(data).hash(starts, ends), place


_GRAM = np.array([salt("gram", j) | _U(1) for j in range(16)])


def word_shingles(h: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row's runs of k words, and their counts by row.

    A row of fewer words has one shingle, the whole sequence; a row without words has none.
    """
    counts = np.diff(place)
    n = len(h) - k + 1
    runs = np.zeros(max(n, 0), np.uint64)
    for j in range(k if n > 0 else 0):
        runs += h[j : j + n] * _GRAM[j]
    runs = mix(runs)
    parts = []
    for row, (a, c) in enumerate(zip(place[:-1].tolist(), counts.tolist(), strict=True)):
        if c >= k:
            part = np.sort(runs[a : a + c - k + 1])
            keep = np.ones(len(part), bool)
            np.not_equal(part[1:], part[:-1], out=keep[1:])
            parts.append(part[keep])
        elif c:
            parts.append(mix((h[a : a + c] * _GRAM[:c]).sum(keepdims=True) + _U(c)))
        else:
            parts.append(np.zeros(0, np.uint64))
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), sizes


def char_shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of k characters (repeats stay), and the place of each row's first.

    A row of fewer characters has one shingle, the whole text.
    """
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    place = np.searchsorted(chars, offsets)
    counts = np.diff(place)
    per_row = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    total = int(per_row.sum())
    first = np.zeros(len(per_row) + 1, np.int64)
    np.cumsum(per_row, out=first[1:])
    at = np.arange(total) + np.repeat(place[:-1] - first[:-1], per_row)
    stop = np.append(chars, len(data))[np.minimum(at + k, np.repeat(place[1:], per_row))]
    return Spans(data).hash(chars[at], stop), first


def bounds(sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


def similar(sets_a: tuple, sets_b: tuple, num: int, den: int) -> np.ndarray:
    """For each row, whether den * intersection >= num * union of its two shingle sets; empty sets are never similar."""
    def keyed(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
        both = mix(h + row * _U(0xD1B54A32D192ED03))
        both, first = np.unique(both, return_index=True)
        return both, row[first].astype(np.int64)

    n = len(sets_a[1])
    ka, ra = keyed(*sets_a)
    kb, rb = keyed(*sets_b)
    size = np.bincount(ra, minlength=n) + np.bincount(rb, minlength=n)
    spot = np.minimum(np.searchsorted(kb, ka), max(len(kb) - 1, 0))
    shared = (kb[spot] == ka) if len(kb) else np.zeros(len(ka), bool)
    common = np.bincount(ra[shared], minlength=n)
    return (common > 0) & (den * common >= num * (size - common))
