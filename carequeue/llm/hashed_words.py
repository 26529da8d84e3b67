"""Words of whole texts as 64-bit hashes, a batch of documents at a time.

Words are runs of bytes other than space and \\x09-\\x0D. The hash of a word is a
polynomial over random values of its bytes, taken from running sums over the batch, and
then mixed; equal words have equal hashes and 64 bits keep others apart.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTE_VALUES = np.random.default_rng(20).integers(1, 1 << 64, 256, dtype=np.uint64)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
TO_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int, kind: str) -> np.ndarray:
    """BASE^i or BASE^-i, for i below n."""
    have = _powers[kind]
    if len(have) < n:
        steps = np.full(max(n, 2 * len(have)), BASE if kind == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        _powers[kind] = have = np.multiply.accumulate(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that makes all bits depend on all others."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each document's begin (one more at last)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = _IS_WORD[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(len(data), "up"), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * powers(len(data), "down")[starts] + (ends - starts).astype(np.uint64))
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    return hashes, np.searchsorted(starts, bounds)
