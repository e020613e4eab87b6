"""Word hashes of whole texts as arrays, for the operators on word sequences."""

from __future__ import annotations

import numpy as np
import xxhash

from quirefold.llm.common import Memo

#: bytes.split() without arguments parts at exactly \x20 and \x09-\x0D.
ODD = np.uint64(0x9E3779B97F4A7C15)  # fixed value: an odd 64-bit multiplier


class WordHashes:
    """64-bit hashes of a text's words, memoised per worker."""

    def __init__(self):
        self.memo: Memo = Memo(xxhash.xxh3_64_intdigest)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.array(list(map(self.memo.__getitem__, words)), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64, grown as needed."""
    have = _POWERS.get(0)
    if have is None or len(have) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        inverse = np.uint64(pow(int(ODD), -1, 1 << 64))
        for key, base in ((0, ODD), (1, inverse)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of each k consecutive words, by differences of a running sum modulo 2^64."""
    n = len(hashes)
    if n < k:
        return np.empty(0, dtype=np.uint64)
    up, down = _powers(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * up, out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, by doubling."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x
