"""Content anchors: which windows of a byte string can only equal which others.

A window of ``WINDOW`` bytes is represented by the leftmost smallest hash of
the ``GRAM``-byte strings inside it.  Equal windows have equal anchors at equal
offsets, so repeated windows are found by comparing anchors instead of
positions; there is about one anchor for every 75 bytes.
"""

from __future__ import annotations

import numpy as np

WINDOW = 200
GRAM = 20

_RANDOM = np.random.default_rng(20260101)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    """The first n powers of the base (up) or of its inverse (down), modulo 2**64."""
    have = _powers[kind]
    if len(have) < n:
        step = np.full(max(n, 2 * len(have)), _BASE if kind == "up" else _INVERSE, np.uint64)
        step[0] = 1
        have = _powers[kind] = np.multiply.accumulate(step)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Rolling:
    """Hashes of any substrings of one byte string from its prefix sums."""

    def __init__(self, data: bytes):
        codes = _BYTE[np.frombuffer(data, np.uint8)]
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * _power("down", len(codes)), out=self.sums[1:])
        self.n = len(codes)

    def all(self, length: int) -> np.ndarray:
        """Hash of the substring of this length at every start."""
        starts = self.n - length + 1
        return mix((self.sums[length:] - self.sums[:starts]) * _power("up", starts))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each substring [start, end)."""
        up = _power("up", self.n + 1)
        return mix((self.sums[end] - self.sums[start]) * up[start] + (end - start).astype(np.uint64))


def _sliding(values: np.ndarray, width: int, reduce, fill) -> np.ndarray:
    """Minimum or maximum of every full window, from running ones forwards and backwards in blocks of its width."""
    n = len(values)
    padded = np.full(-(-n // width) * width, fill, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    forward = reduce.accumulate(blocks, axis=1).ravel()
    backward = reduce.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return reduce(backward[: n - width + 1], forward[width - 1 : n])


def anchors(data: bytes, rolling: Rolling | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position and gram hash of each anchor, and the first and last window it stands for; none below WINDOW bytes."""
    if len(data) < WINDOW:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    width = WINDOW - GRAM + 1
    grams = (rolling or Rolling(data)).all(GRAM)
    low = _sliding(grams, width, np.minimum, np.uint64(2**64 - 1))
    padding = np.zeros(width - 1, np.uint64)
    candidates = np.flatnonzero(_sliding(np.concatenate([padding, low, padding]), width, np.maximum, np.uint64(0)) == grams)
    at = np.searchsorted(candidates, np.arange(len(low)))
    off = np.flatnonzero(grams[candidates[at]] != low)
    while len(off):
        at[off] += 1
        off = off[grams[candidates[at[off]]] != low[off]]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], len(at)) - 1
    position = candidates[at[first]]
    return position, grams[position], first, last
