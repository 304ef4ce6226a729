"""Shingle sets as sorted arrays of 64-bit hashes, and what sets of a given overlap must have in common."""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import xxhash

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M2
    h = (h ^ (h >> np.uint64(29))) * _M3
    return h ^ (h >> np.uint64(32))


class WordHashes(dict):
    """64-bit hash of each word, computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 150_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingle_set(text: str, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct shingles of ``size`` words, A-Z in lower case; a shorter text is one shingle."""
    words = text.encode().lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(codes))
    n = len(codes) - size + 1
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total = _mixed(total + codes[k : k + n] * _M1)
    return np.unique(total)


@dataclass(frozen=True)
class Overlap:
    """The condition intersection / union >= share of two sets, and its consequences."""

    share: Fraction

    def least_size(self, n):
        """Smallest partner of a set of n, also its smallest overlap with one."""
        return -(-n * self.share.numerator // self.share.denominator)

    def least_common(self, n, m):
        """Smallest intersection of linked sets of n and m."""
        return -(-(n + m) * self.share.numerator // (self.share.numerator + self.share.denominator))

    def extra(self, n):
        """How many common hashes more than one the prefixes are made to hold."""
        return np.maximum(1, n * 3 // 20)

    def prefix(self, n):
        """Smallest hashes of a set of n; the prefixes of two linked sets share ``extra`` of the smaller one at least."""
        return np.minimum(n, n - self.least_size(n) + self.extra(n))

    def needed(self, n):
        """Hashes of its prefix that a set of n with any partner shares with other prefixes."""
        return self.extra(self.least_size(n))

    def band(self, n: int) -> int:
        """Sizes of linked sets are in the same or in neighbouring bands."""
        return math.floor(math.log(n) / -math.log(self.share) + 1e-9)

    def parts(self, band: int) -> tuple[int, int]:
        """Number of parts, and differences at most, of linked sets whose smaller one is in this band."""
        top = float(1 / self.share) ** (band + 1) + 1
        differ = math.floor((1 / float(self.share) - 1) * top + 1e-9)
        parts = differ + 1
        empty = parts * math.exp(-top * float(self.share) / parts)
        return (parts + math.ceil(empty + 3 * math.sqrt(empty)) if differ > 3 else parts), differ


def part_keys(hashes: np.ndarray, overlap: Overlap) -> np.ndarray:
    """Routing keys: linked sets share at least one.

    Hashes fall into parts.  Two sets that differ in d hashes agree in all but
    d parts, so with more than d parts they agree in one, whose hashes together
    are a key.  Parts without hashes count only for sets that have so many of
    them that no other part need be left.
    """
    n = len(hashes)
    band = overlap.band(n)
    out = []
    for level in (band, band - 1):
        parts, differ = overlap.parts(level)
        if differ < 1:
            continue
        place = ((hashes >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
        again = _mixed(hashes + np.uint64(level & 0xFFFF))
        low = np.bincount(place, weights=(again & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=parts).astype(np.uint64)
        high = np.bincount(place, weights=(again >> np.uint64(32)).astype(np.float64), minlength=parts).astype(np.uint64)
        count = np.bincount(place, minlength=parts)
        name = np.arange(parts, dtype=np.uint64) + np.uint64((level & 0xFFFF) << 40)
        keys = _mixed(low + _mixed(high * _M1 + count.astype(np.uint64)) + _mixed(name * _M3))
        out.append(keys if (count == 0).sum() >= parts - differ else keys[count > 0])
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)
