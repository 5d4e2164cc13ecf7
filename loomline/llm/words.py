"""Words of UTF-8 texts as numpy arrays: where they stand, and a hash of each."""

from __future__ import annotations

import re

import numpy as np

#: Bytes that are worked on at a time; a word is never cut.
SEGMENT = 1 << 20
STEP = 0x9E3779B97F4A7C15
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_INSIDE = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit integers with all bits of ``x`` spread over each of them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of parts of a sequence of integers, from the running sum of its terms times the
    powers of an odd step: a part's sum is divided by the power of its first place."""

    def __init__(self) -> None:
        self.powers = self.inverses = np.ones(1, np.uint64)

    def __call__(self, terms: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(terms)
        if len(self.powers) <= n:
            self.powers, self.inverses = (np.cumprod(np.array([1, *[p] * (2 * n)], np.uint64)) for p in (STEP, pow(STEP, -1, 1 << 64)))
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(terms * self.powers[:n], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self.inverses[starts])


class Words:
    """(starts, ends, hashes) of a text's words: byte offsets, and 64 bits of each word."""

    def __init__(self) -> None:
        self.rolling = Rolling()

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(data) <= SEGMENT:
            return self._part(data)
        found, at = [], 0
        while at < len(data):
            gap = _GAP.search(data, at + SEGMENT)
            end = gap.start() if gap else len(data)
            starts, ends, hashes = self._part(data[at:end])
            found.append((starts + at, ends + at, hashes))
            at = end
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _part(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b = np.frombuffer(data, np.uint8)
        inside = np.zeros(len(b) + 2, bool)
        inside[1:-1] = _INSIDE[b]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        return starts, ends, self.rolling(b.astype(np.uint64) + np.uint64(1), starts, ends)


def code_points(data: bytes) -> np.ndarray | None:
    """How many code points stand before each byte and the end; None if as many as bytes."""
    if data.isascii():
        return None
    first = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(first)))
