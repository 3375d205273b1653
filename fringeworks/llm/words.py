"""Words of many texts at once as 64-bit numbers, from the bytes of an Arrow string column.

A word's number is made eight bytes at a time: each eight are added to what came before and go through a bijection that
spreads every bit, so no family of words (periodic ones, say) collides by its structure; a word over ``LONG`` bytes takes
64 bits of its BLAKE2b digest. Of n different words, n * n / 2**65 pairs are expected to share a number: none for a billion.
Texts are worked on in slices of about a MB, so memory doesn't depend on the batch; a longer text is a slice of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

SLICE, LONG = 1 << 20, 64
_VALUES = np.random.default_rng(20240601).integers(1, 2**63, 256, np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of words: all but white space, or ASCII digits, a-z and whatever is not ASCII.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[32, 9, 10, 11, 12, 13]] = False
LETTERS_DIGITS = np.zeros(256, bool)
LETTERS_DIGITS[48:58] = LETTERS_DIGITS[97:123] = LETTERS_DIGITS[128:] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self):
        self.n, self.up, self.down = -1, None, None

    def get(self, n: int):
        if n > self.n:
            self.n = max(n, SLICE + 1)
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(self.n, _BASE, np.uint64)])
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(self.n, pow(_BASE, -1, 2**64), np.uint64)])
        return self.up, self.down


_POWERS = _Powers()


def slices(column, size: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, bounds of its texts) of an Arrow string column; nulls are empty."""
    import pyarrow as pa

    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if not len(column):
        return
    bounds = np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    if column.null_count:  # a null's bytes, if it has any, are no text
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        lengths = np.where(valid, np.diff(bounds), 0)
        data = np.concatenate([data[:0], *[data[a : a + n] for a, n in zip(bounds[:-1], lengths, strict=True) if n]])
        bounds = np.r_[0, np.cumsum(lengths)]
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + size, "right")) - 1)
        yield row, data[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row]
        row = end


_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)  # of eight bytes, the first k


def numbers(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, long: int = LONG) -> np.ndarray:
    """Of the strings from ``starts`` to ``ends``."""
    size = ends - starts
    number = mixed(size.astype(np.uint64) + np.uint64(_BASE))
    padded = np.zeros(len(low) + 8, np.uint8)
    padded[: len(low)] = low
    eight = np.ndarray((len(low) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    for k in range(0, min(long, int(size.max(initial=0))), 8):
        own = slice(None) if not k else np.flatnonzero(size > k)
        number[own] = mixed(number[own] ^ (eight[starts[own] + k] & _KEEP[np.minimum(size[own] - k, 8)]))
    for w in np.flatnonzero(size > long).tolist():
        number[w] = int.from_bytes(hashlib.blake2b(low[starts[w] : ends[w]].tobytes(), digest_size=8).digest(), "little")
    return number


def numbered_words(data: np.ndarray, bounds: np.ndarray, kind: np.ndarray):
    """(number of each word, rows' first words): A-Z lower-cased; the words of row k are first[k] to first[k + 1]."""
    low = _LOWER[data]
    inside = kind[low]
    opened = inside.copy()
    opened[1:] &= ~inside[:-1]
    cut = bounds[1:-1]
    cut = cut[cut < len(data)]
    opened[cut] |= inside[cut]
    starts = np.flatnonzero(opened)
    closed = inside.copy()
    closed[:-1] &= ~inside[1:]
    last = cut[cut > 0] - 1
    closed[last] |= inside[last]
    ends = np.flatnonzero(closed) + 1
    return numbers(low, starts, ends), np.searchsorted(starts, bounds)
