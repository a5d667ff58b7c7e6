"""Vectorised tokenising and hashing of whole Arrow string batches in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at a time.
BLOCK = 1 << 20
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_bytes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text begins and ends in them; null counts as empty."""
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(offsets) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    return (_LOWER[data] if lower else data), offsets


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and for each text the index of its first word, with the total last."""
    inside = ~_SPACE[data]
    before = np.empty_like(inside)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
        edges = offsets[:-1][np.diff(offsets) > 0]
        before[edges] = False  # a text's first byte begins a word of its own
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros_like(inside)
    after[:-1] = inside[1:] & before[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * BLOCK)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, b, U64)]), dtype=U64) for b in (_BASE, _BASE_INVERSE)]
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.empty(len(starts), U64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + BLOCK, "right")))
        low, high = int(starts[first]), int(ends[last - 1])
        power, inverse = _power_tables(high - low + 1)
        sums = np.zeros(high - low + 1, U64)
        np.cumsum((data[low:high].astype(U64) + U64(1)) * power[: high - low], out=sums[1:])
        s, e = starts[first:last] - low, ends[first:last] - low
        out[first:last] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))
        first = last
    return out


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words of every text, in order, and where each text's begin, total last.

    A text with some words but fewer than ``size`` has its whole sequence as one run.
    """
    n = len(words)
    counts = np.diff(first)
    runs = np.zeros(n, U64)
    for k in range(size):
        shifted = np.zeros(n, U64)
        shifted[: max(n - k, 0)] = words[k:]
        runs += shifted * U64(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64))
    runs = mix(runs)
    keep = np.ones(n, bool)
    tail = np.repeat(first[1:], counts) - np.arange(n)  # words left from here to the text's end
    keep[tail < size] = False
    short = np.flatnonzero((counts > 0) & (counts < size))
    for t in short:
        at = first[t]
        keep[at] = True
        h = U64(counts[t])
        for w in words[at : first[t + 1]]:
            h = mix(np.array([h ^ w], U64))[0]
        runs[at] = h
    return runs[keep], np.concatenate([[0], np.cumsum(np.where(counts >= size, counts - size + 1, np.minimum(counts, 1)))])
