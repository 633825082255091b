"""Words of UTF-8 texts and hashes of words and word windows, in numpy.

Hashes are polynomials modulo 2**64 from prefix sums: the hash of any stretch is one
subtraction and one multiplication, then bits are mixed. Equal stretches have equal
hashes wherever they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SECOND = np.uint64(0xD1B54A32D192ED03)


def byte_table(outside: list[tuple[int, int]]) -> np.ndarray:
    """Which bytes belong to words, given the ranges that do not."""
    table = np.ones(256, dtype=bool)
    for low, high in outside:
        table[low : high + 1] = False
    return table


# Letters, digits and everything beyond ASCII.
ALNUM = byte_table([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
# Everything but ASCII white space.
SPACED = byte_table([(0x20, 0x20), (0x09, 0x0D)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    """Powers of ``base`` from 0 to n - 1, kept up to two million."""
    have = _powers.get(name)
    if have is not None and len(have) >= n:
        return have[:n]
    steps = np.full(max(n, 1 << 12), base, dtype=np.uint64)
    steps[0] = 1
    made = np.cumprod(steps, dtype=np.uint64)
    if n <= 1 << 21:
        _powers[name] = made
    return made[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a permutation of them)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums whose differences give the hash of any stretch; see :func:`stretch`."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _power("up", BASE, len(values)), dtype=np.uint64, out=out[1:])
    return out


def stretch(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair."""
    down = _power("down", INVERSE, len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


def window_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of ``size`` consecutive values."""
    if len(values) < size:
        return np.empty(0, dtype=np.uint64)
    sums = prefix(values)
    down = _power("down", INVERSE, len(sums))
    return mix((sums[size:] - sums[:-size]) * down[: len(sums) - size])


@dataclass
class Words:
    """Words of several texts one after the other.

    ``first`` has, for each text and for the end, the number of its first word;
    ``starts`` and ``ends`` are byte places in ``flat``, the texts joined by a blank.
    """

    flat: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray


def split_words(texts: list[bytes], table: np.ndarray, lower: bool) -> Words:
    """Words of the texts and a 64-bit hash of each."""
    flat = np.frombuffer(b" ".join(texts), dtype=np.uint8)
    if lower:
        flat = LOWER[flat]
    inside = np.zeros(len(flat) + 2, dtype=np.int8)
    inside[1:-1] = table[flat]
    edges = np.diff(inside)
    starts = np.flatnonzero(edges == 1)
    ends = np.flatnonzero(edges == -1)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    first = np.searchsorted(starts, offsets)
    hashes = stretch(prefix(flat.astype(np.uint64) + np.uint64(1)), starts, ends)
    return Words(flat, starts, ends, first, hashes)


def in_blocks(values: list, size_of, most: int) -> Iterator[slice]:
    """Slices of a list with at most ``most`` in each by ``size_of``, one value at least."""
    at, size = 0, 0
    for i, value in enumerate(values):
        n = size_of(value)
        if i > at and size + n > most:
            yield slice(at, i)
            at, size = i, 0
        size += n
    if at < len(values):
        yield slice(at, len(values))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenation of start, start + 1, … for each start and size."""
    total = int(sizes.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    ends = np.cumsum(sizes)
    return np.arange(total) - np.repeat(ends - sizes - starts, sizes)
