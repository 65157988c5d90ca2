"""Words of whole Arrow string columns as numpy arrays: found, hashed and grouped without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of the six word separators.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_UNDO = pow(_BASE, -1, 1 << 64)
_LETTERS = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
_FOLDED = _LETTERS.copy()
_FOLDED[65:91] = _LETTERS[97:123]
#: Odd multipliers of the places in a run of words; they are drawn apart, so that no two orders of words add up alike.
_PLACES = np.random.default_rng(6).integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x + U64((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, U64)
        have[0] = 1
        have = np.cumprod(have)
        if size <= 1 << 23:
            _powers[base] = have
    return have[:n]


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets into them) of runs of rows of about `most` bytes; null is empty."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], kind, n + 1 + column.offset)[column.offset :].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; no word crosses a row."""
    inside = ~SPACES[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    start[cuts] = inside[cuts]
    end[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z lower-cased if `fold`."""
    if not len(starts):
        return np.zeros(0, U64)
    terms = (_FOLDED if fold else _LETTERS)[data] * _powers_of(_BASE, len(data))
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(terms, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers_of(_UNDO, len(data))[starts] + (ends - starts).astype(U64))


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word and, per row, where its words begin (one more than rows)."""
    starts, ends = bounds(data, offsets)
    return hashes(data, starts, ends, fold), np.searchsorted(starts, offsets)


def shingles(hashed: np.ndarray, firsts: np.ndarray, n: int, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a row, and each row's count; a shorter row that has words gives one hash of all."""
    counts = np.diff(firsts)
    runs = np.maximum(counts - n + 1, 0)
    total = len(hashed)
    if total >= n:
        acc = np.zeros(total - n + 1, U64)
        for k in range(n):
            acc = acc + hashed[k : total - n + 1 + k] * _PLACES[k]
        keep = np.zeros(total - n + 1 + n, np.int64)  # +1 where a row's runs begin, -1 where they end
        has = runs > 0
        np.add.at(keep, firsts[:-1][has], 1)
        np.add.at(keep, firsts[:-1][has] + runs[has], -1)
        full = mix(acc[np.cumsum(keep)[: total - n + 1] > 0], n)
    else:
        full = np.zeros(0, U64)
    short = np.flatnonzero((counts > 0) & (runs == 0)) if whole_if_short else np.zeros(0, np.int64)
    if not len(short):
        return full, runs
    ones = []
    for r in short:
        w = hashed[firsts[r] : firsts[r + 1]]
        ones.append((w * _PLACES[-len(w) :]).sum(dtype=U64) + U64(len(w)))
    ones = mix(np.array(ones, U64), 77)
    at = np.concatenate([[0], np.cumsum(runs)])[short]
    runs[short] = 1
    return np.insert(full, at, ones), runs


def sorted_sets(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row in order, and their number."""
    values = values.copy()
    ends = np.cumsum(counts)
    begins = ends - counts
    for a, b in zip(begins[counts > 1], ends[counts > 1], strict=True):
        values[a:b].sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    fresh[begins[counts > 0]] = True
    have = np.concatenate([[0], np.cumsum(fresh)])
    return values[fresh], have[ends] - have[begins]
