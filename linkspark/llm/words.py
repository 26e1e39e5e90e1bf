"""Words, lines and their hashes for many texts at once, in NumPy over the bytes of a slice of texts.

Hashes of spans are pairs of polynomials modulo the prime 2**31 - 1, over bases and byte values drawn once at random, cut out
of running sums. Two given spans of ``n`` bytes have equal pairs with a chance of ``(n / 2**31)**2`` at most over the
draw, whatever their texts; modulo a power of two there are texts that collide for every base.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_PRIME = np.uint64((1 << 31) - 1)
_draw = np.random.default_rng(12345)
_BASES = _draw.integers(1 << 20, int(_PRIME), 2).tolist()
_VALUES = _draw.integers(1, int(_PRIME), (2, 256), dtype=np.uint64)
#: Powers of the bases, then of their inverses.
_powers: list[np.ndarray] = [np.ones(1, np.uint32)] * 4


def _folded(x: np.ndarray) -> np.ndarray:
    """The same modulo the prime, below 2**33 for any 64-bit number, below 2**32 for products."""
    return (x & _PRIME) + (x >> np.uint64(31))


def powers(n: int, which: int) -> np.ndarray:
    """The first ``n`` powers of base ``which``, for 2 and 3 of the inverses, modulo the prime."""
    have = _powers[which]
    if len(have) < n:
        base = _BASES[which % 2] if which < 2 else pow(_BASES[which % 2], -1, int(_PRIME))
        while len(have) < max(n, 1 << 16):
            have = np.concatenate([have, (have * np.uint64(pow(base, len(have), int(_PRIME))) % _PRIME).astype(np.uint32)])
        if len(have) <= 1 << 24:  # those for a very long text are not kept
            _powers[which] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def running(data: np.ndarray) -> np.ndarray:
    """Two running sums from which :func:`span_hashes` cuts hashes."""
    out = np.zeros((2, len(data) + 1), np.uint64)
    for k in range(2):
        np.cumsum(_folded(_VALUES[k][data] * powers(len(data), k)), dtype=np.uint64, out=out[k, 1:])
    return out


def span_hashes(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span, with its length."""
    pair = []
    for k in range(2):
        span = _folded(_folded(total[k][ends] - total[k][starts]))
        pair.append(span % _PRIME * powers(total.shape[1], 2 + k)[starts] % _PRIME)
    return mix(mix(pair[0] << np.uint64(31) | pair[1]) + (ends - starts).astype(np.uint64))


_STRIDE = np.uint64(0x9E3779B97F4A7C15)


def short_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int, seed: int = 0) -> np.ndarray:
    """Hash of each span of ``most`` bytes at most: eight bytes at a time, each mixed in after the last."""
    padded = np.concatenate([data, np.zeros(most + 8, np.uint8)])
    eights = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
    out = mix(sizes.astype(np.uint64) + np.uint64(seed * int(_STRIDE) % (1 << 64)))
    for at in range(0, most, 8):
        left = sizes - at
        live = np.flatnonzero(left > 0)
        if not len(live):
            break
        part = np.ascontiguousarray(eights[starts[live] + at]).view(np.uint64).ravel()
        blank = np.uint64(8) * (8 - np.minimum(left[live], 8)).astype(np.uint64)
        out[live] = mix(out[live] * _STRIDE ^ part << blank) + out[live]
    return out


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    #: First word of each text, and the number of words at the end.
    offsets: np.ndarray
    space: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def split_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Runs of bytes that are no white space; words end where texts end."""
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    word = ~space
    first, last = word.copy(), word.copy()
    first[1:] &= space[:-1] | edge[1:-1]
    last[:-1] &= space[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets), space)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


_FACTORS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of ``width`` following words, for every place where they fit."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total += hashes[i : i + n] * _FACTORS[i]
    return mix(total + np.uint64(width))


def windows_inside(offsets: np.ndarray, width: int) -> np.ndarray:
    """Start places of the windows that do not cross a text's end."""
    n = int(offsets[-1]) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    inside = np.ones(n, bool)
    for end in np.unique(offsets[1:-1]):
        inside[max(0, end - width + 1) : end] = False
    return np.flatnonzero(inside)


def keyed(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes that differ between texts."""
    return mix(hashes + mix(owner.astype(np.uint64) + np.uint64(1)))


def repeated(at: Words, hashes: np.ndarray, width: int) -> np.ndarray:
    """For each word: it lies in a window of ``width`` words that its text has twice or more."""
    marks = np.zeros(len(hashes) + 1, np.int64)
    inside = windows_inside(at.offsets, width)
    if len(inside):
        _, which, count = np.unique(keyed(window_hashes(hashes, width)[inside], at.text_of()[inside]), return_inverse=True, return_counts=True)
        again = inside[count[which] > 1]
        np.add.at(marks, again, 1)
        np.add.at(marks, again + width, -1)
    return np.cumsum(marks)[:-1] > 0
