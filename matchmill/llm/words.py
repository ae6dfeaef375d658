"""Words of many texts at once, as 64-bit hashes in numpy arrays.

A word is a run of bytes other than the six ASCII white-space characters. Its hash is a sum of bytes times fixed random
odd numbers by place in the word, then mixed; windows of words are hashed from the hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes of text that one pass of numpy takes; a single longer text is a pass of its own.
PASS_BYTES = 1 << 20

_factors = np.zeros(0, np.uint64)


def factors(n: int) -> np.ndarray:
    """The first n of a fixed sequence of random odd numbers."""
    global _factors
    if len(_factors) < n:
        _factors = np.random.default_rng(20250101).integers(0, 1 << 64, max(4096, 2 * n), dtype=np.uint64) | np.uint64(1)
    return _factors[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    """first[d]:first[d + 1] are the words of text d; start and end are their places in blob."""

    blob: bytes
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def hashes(self) -> np.ndarray:
        n = self.end - self.start
        if not len(n):
            return np.zeros(0, np.uint64)
        a = np.frombuffer(self.blob, np.uint8)
        begin = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(begin, n)
        byte = a[place + np.repeat(self.start, n)].astype(np.uint64) + np.uint64(1)
        total = np.add.reduceat(byte * factors(int(n.max()))[place], begin)
        return mix(total + n.astype(np.uint64))

    def windows(self, k: int, hashes: np.ndarray, other: int = 7) -> tuple[np.ndarray, np.ndarray]:
        """A hash for each place at which k words of one text start, and the hash's own place there; others are left out.
        Another number in `other` gives another hash."""
        at = np.arange(max(0, len(hashes) - k + 1))
        text = np.searchsorted(self.first, at, "right") - 1
        at = at[at + k <= self.first[text + 1]]
        h = np.zeros(len(at), np.uint64)
        for j, f in enumerate(factors(k + other)[other:]):
            h += hashes[at + j] * f
        return mix(h), at


def passes(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, Words]]:
    """The words of texts, a bounded number of bytes at a time: the first text's index, and the words."""
    i, sizes = 0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + PASS_BYTES)))
        parts = [t or b"" for t in texts.slice(i, j - i).cast(pa.binary()).to_pylist()]
        blob = b"\n".join(parts)
        if lower:
            blob = blob.translate(LOWER)
        inside = np.concatenate(([False], ~SPACE[np.frombuffer(blob, np.uint8)], [False]))
        turn = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = turn[::2], turn[1::2]
        offset = np.cumsum([0, *(len(p) + 1 for p in parts)])
        yield i, Words(blob, np.searchsorted(start, offset), start, end)
        i = j
