"""Words and their hashes, vectorised with numpy."""

from __future__ import annotations

import hashlib

import numpy as np

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_VALUES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = max(1 << 16, 2 * n)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base & _MASK, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spans:
    """Hashes of stretches of a byte string; equal stretches have equal hashes wherever they are."""

    def __init__(self, data: bytes):
        self.buf = np.frombuffer(data, np.uint8)
        n = len(self.buf)
        power, self.inverse = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[self.buf] * power[:n], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


def words(text: str | None) -> list[bytes]:
    """Words of a text in lower case (A-Z alone), between spaces and the controls 0x09 to 0x0D."""
    return (text or "").encode().lower().split()


class _WordHashes(dict):
    """The 64-bit cryptographic hash of each word, kept for the words that come again while there is room."""

    ROOM = 1 << 18

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.ROOM:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


_HASHES = _WordHashes()


def word_hashes(found: list[bytes]) -> np.ndarray:
    """Different words share a hash only by a chance of 1 in 2**64, whatever they are."""
    return np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
