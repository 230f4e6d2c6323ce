"""Words and hashes of a whole Arrow batch of texts at once, in numpy.

A batch is one run of UTF-8 bytes with row offsets, so words, their hashes and their n-grams are
found with array operations over the bytes, without a Python object for each word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
SEED = 20240229
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(SEED).integers(1, 1 << 64, 256, dtype=np.uint64)

# white space as in [\x20\x09-\x0D]
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
# everything in ASCII but digits and letters
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of rows of about ``most`` bytes; a longer row is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if row > first and held + size > most:
            yield first, row
            first, held = row, 0
        held += size
    if first < len(sizes):
        yield first, len(sizes)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows and each row's offset in them; a null row has none."""
    col = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    held = col.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of consecutive rows. ``row`` is each word's row, ``first[r]:first[r+1]`` a row's words."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, from prefix sums of a polynomial over the bytes."""
        return span_hashes(self.data, self.starts, self.ends)

    def text(self, start: int, end: int) -> str:
        """Words ``start`` to ``end`` (exclusive), joined with single blanks."""
        data = self.data
        return b" ".join(
            data[s:e].tobytes() for s, e in zip(self.starts[start:end], self.ends[start:end], strict=True)
        ).decode()


def words(texts: pa.Array, breaks: np.ndarray = BLANK, lower: bool = True) -> Words:
    """Find the maximal runs of bytes that ``breaks`` doesn't hold, row by row."""
    data, offsets = raw(texts)
    if lower:
        data = LOWER[data]
    inside = ~breaks[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    starts[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[edges[edges > 0] - 1] = inside[edges[edges > 0] - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    first = np.searchsorted(starts, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, offsets, starts, ends, row, first)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, wherever it lies."""
    return place_hashes(_BYTE_VALUES[data], starts, ends)


def place_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of places that hold 64-bit values, wherever it lies."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(BASE, len(values)), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _powers(INVERSE, len(values) + 1)[starts])


def grams(hashes: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each k consecutive words, and whether they lie in one row."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    powers = _powers(BASE, k)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += hashes[j:j + n] * powers[j]
    return mixed(total + np.uint64(k)), row[:n] == row[k - 1:k - 1 + n]


def minimizers(hashes: np.ndarray, row: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowing: the last smallest of every w consecutive k-gram hashes of a row.

    Any k + w - 1 words keep the same k-gram wherever they stand. Returns word positions, which
    rise, and the hashes there.
    """
    values, _ = grams(hashes, row, k)
    n = len(values) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, at = values[:n].copy(), np.arange(n)
    for j in range(1, w):
        later = values[j:j + n]
        lower = later <= least
        least = np.where(lower, later, least)
        at = np.where(lower, np.arange(j, j + n), at)
    whole = row[:n] == row[k + w - 2:k + w - 2 + n]
    at = at[whole]
    # positions never fall along a row, so equal ones are neighbours
    keep = np.ones(len(at), bool)
    keep[1:] = at[1:] != at[:-1]
    at = at[keep]
    return at, values[at]
