"""Elias-Fano lists: ascending integers in about two bits each more than their low bits.

Each value is cut in two.  The low bits stand side by side; the high parts are
counted in unary, one bit set for each value, zeros between values whose high
part moves on.  Every ``SAMPLE``-th set bit has its place stored in 32 bits,
so one value costs the reading of one short stretch of bits, and no table of
64-bit offsets exists.
"""

from __future__ import annotations

import struct

import numpy as np

#: One stored place for so many values.
SAMPLE = 256
_HEAD = struct.Struct("<QQQQ")


def _padded(bits: np.ndarray) -> bytes:
    """Bits in little-endian order, filled up to whole 64-bit words."""
    data = np.packbits(bits, bitorder="little").tobytes()
    return data + bytes(-len(data) % 8)


def encoded(values) -> bytes:
    """Ascending non-negative 64-bit values, equal ones allowed; fewer than 2**30 of them."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    if n >> 30 or (n and (np.diff(values.view(np.int64)) < 0).any()):
        raise ValueError("values must ascend and be fewer than 2**30")
    top = int(values[-1]) if n else 0
    width = max(0, (top // n).bit_length() - 1) if n else 0
    ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
    unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    unary[ones] = 1
    low = ((values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
    places = ones[::SAMPLE].astype("<u4").tobytes()
    high, low = _padded(unary), _padded(low)
    return _HEAD.pack(n, width, len(low), len(high)) + low + high + places


class EliasFano:
    """Reads a list from its bytes without unpacking it."""

    def __init__(self, data: bytes):
        self.n, self.width, low, high = _HEAD.unpack_from(data)
        at = _HEAD.size
        self.low = np.frombuffer(data, np.uint8, low, at)
        self.high = np.frombuffer(data, np.uint8, high, at + low)
        self.places = np.frombuffer(data, "<u4", -(-self.n // SAMPLE), at + low + high)

    def __len__(self) -> int:
        return self.n

    def _low(self, first: int, last: int) -> np.ndarray:
        """Low bits of the values first .. last - 1."""
        if not self.width:
            return np.zeros(last - first, np.uint64)
        begin, end = first * self.width, last * self.width
        bits = np.unpackbits(self.low[begin // 8 : -(-end // 8)], bitorder="little")[begin % 8 :][: end - begin]
        return bits.reshape(-1, self.width).astype(np.uint64) @ (np.uint64(1) << np.arange(self.width, dtype=np.uint64))

    def block(self, k: int) -> np.ndarray:
        """The values k * SAMPLE and after it, up to the next stored place."""
        first, last = k * SAMPLE, min(self.n, (k + 1) * SAMPLE)
        begin = int(self.places[k])
        end = int(self.places[k + 1]) if k + 1 < len(self.places) else 8 * len(self.high)
        bits = np.unpackbits(self.high[begin // 8 : -(-end // 8)], bitorder="little")
        ones = np.flatnonzero(bits)
        ones = ones[ones >= begin % 8][: last - first] + 8 * (begin // 8)
        return ((ones - np.arange(first, last)).astype(np.uint64) << np.uint64(self.width)) | self._low(first, last)

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.block(i // SAMPLE)[i % SAMPLE])

    def values(self, first: int, last: int) -> np.ndarray:
        """The values first .. last - 1."""
        if first >= last:
            return np.zeros(0, np.uint64)
        blocks = range(first // SAMPLE, (last - 1) // SAMPLE + 1)
        return np.concatenate([self.block(k) for k in blocks])[first - blocks[0] * SAMPLE :][: last - first]

    def below(self, x: int) -> int:
        """How many values are smaller than x."""
        left, right = 0, len(self.places)  # blocks whose first value is smaller than x
        while left < right:
            middle = (left + right) // 2
            if self.select(middle * SAMPLE) < x:
                left = middle + 1
            else:
                right = middle
        return (left - 1) * SAMPLE + int((self.block(left - 1) < np.uint64(max(x, 0))).sum()) if left else 0
