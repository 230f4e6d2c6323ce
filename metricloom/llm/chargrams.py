"""Hashed character n-grams of a batch of texts, as arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from metricloom.llm.segments import mixed

STEP = np.uint64(0x9E3779B97F4A7C15)


def _word_characters() -> np.ndarray:
    """For code points below 0x3100: letters and digits, as a rule of ranges; above, everything is one."""
    table = np.ones(0x3100, bool)
    table[:0xC0] = False
    for low, high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
        table[low:high] = True
    table[[0xAA, 0xB5, 0xBA]] = True
    table[[0xD7, 0xF7]] = False
    table[0x2000:0x2C00] = False
    table[0x3000:0x3005] = False
    return table


def _lower() -> np.ndarray:
    """Lower case where it is a fixed step: Latin, Greek, Cyrillic."""
    table = np.arange(0x3100, dtype=np.uint32)
    for low, high, step in ((0x41, 0x5B, 32), (0xC0, 0xDF, 32), (0x391, 0x3AA, 32), (0x410, 0x430, 32), (0x400, 0x410, 80)):
        table[low:high] += step
    table[0xD7] = 0xD7
    return table


IS_WORD, LOWER = _word_characters(), _lower()
CODES = np.where(IS_WORD, LOWER, 0).astype(np.uint32)


@dataclass
class Characters:
    """Lower-cased code points of all rows, zero for what is in no word; a zero stands around every row.

    Row r's grams start at ``first[r]`` (the zero before it) to ``first[r + 1]`` (exclusive).
    """

    codes: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1


def characters(texts: pa.Array) -> Characters:
    held = [t or "" for t in texts.to_pylist()]
    codes = np.frombuffer("\0".join(["", *held, ""]).encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(codes < len(CODES), CODES[np.minimum(codes, len(CODES) - 1)], codes)
    first = np.concatenate([[0], np.cumsum(np.array([len(t) + 1 for t in held], np.int64))])
    return Characters(codes, first)


def grams(chars: Characters, sizes: tuple[int, ...], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size: the buckets (0 to 2**bits - 1) of the n-grams that start at every place, and which count.

    An n-gram counts if nothing but its first or last character lies outside of a word; of one
    character, if it is in a word; of two, if one is.
    """
    codes = chars.codes
    inside = codes > 0
    out, value = [], np.zeros(len(codes), np.uint64)
    for n in range(1, max(sizes) + 1):
        keep = len(codes) - n + 1
        if keep <= 0:
            out += [(np.zeros(0, np.int64), np.zeros(0, bool)) for s in sizes if s >= n]
            break
        value = value[:keep] * STEP + codes[n - 1:n - 1 + keep].astype(np.uint64) + np.uint64(1)
        if n in sizes:
            if n <= 2:
                counts = inside[:keep] | inside[n - 1:n - 1 + keep]
            else:
                counts = inside[1:1 + keep].copy()
                for j in range(2, n - 1):
                    counts &= inside[j:j + keep]
            out.append(((mixed(value + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int64), counts))
    return out


def row_sums(chars: Characters, values: np.ndarray) -> np.ndarray:
    """Per row, the sum of values that belong to places."""
    sums = np.zeros(len(chars.codes) + 1)
    np.cumsum(values, out=sums[1:len(values) + 1])
    sums[len(values) + 1:] = sums[len(values)]
    return sums[chars.first[1:]] - sums[chars.first[:-1]]
