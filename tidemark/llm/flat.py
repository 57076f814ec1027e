"""Whole Arrow columns of texts as one array of bytes, and their words by numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after lower-casing A-Z; every byte of a character beyond ASCII is one.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
_WEIGHTS = np.random.default_rng(20_24).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    column = column.fill_null(b"") if column.null_count else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 4 << 20):
    """Ranges of rows of at most ``most`` bytes together; a longer row stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end
        at = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words in lower-cased bytes; rows bound words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mask = is_word[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.concatenate([[False], mask[:-1]])
    after = np.concatenate([mask[1:], [False]])
    return np.flatnonzero(mask & (~before | first[:-1])), np.flatnonzero(mask & (~after | first[1:])) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: weighted sums of bytes, mixed with the length. Equal words have equal hashes; not more is promised."""
    out = np.empty(len(starts), np.uint64)
    for lo in range(0, len(starts), 200_000):
        s, e = starts[lo : lo + 200_000], ends[lo : lo + 200_000]
        length = e - s
        at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        values = (data[np.repeat(s, length) + at].astype(np.uint64) + (at >> 6).astype(np.uint64) * np.uint64(0x9E37)) * _WEIGHTS[at & 63]
        sums = np.add.reduceat(values, np.cumsum(length) - length) + length.astype(np.uint64)
        out[lo : lo + len(s)] = (sums ^ (sums >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def contains(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found, place) of values in a sorted array."""
    if not len(table):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values, at
