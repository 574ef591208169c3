"""Words and word hashes of whole texts, inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multiplier of the polynomial word-window hash, and the constants of
#: the 64-bit finaliser.
BASE = 0x9E3779B97F4A7C15
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Maps a byte to itself (A-Z lower-cased) where it belongs to a word of
#: digits, letters and non-ASCII characters, else to a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256))


def plain_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    return text.translate(WORD_BYTES).split() if text else []


class Hashes(dict):
    """word -> 64-bit hash; forgets all when it grows beyond ``limit`` words,
    so that a task's memory stays bounded."""

    def __init__(self, seed: int = 0, limit: int = 200_000):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the window hash's base and of its inverse modulo 2**64."""

    def __init__(self, base: int = BASE):
        self.base, self.n = base, 0
        self.up = self.down = np.zeros(0, np.uint64)

    def upto(self, n: int) -> None:
        if n > self.n:
            n = max(n, 2 * self.n, 1024)
            inverse = pow(self.base, -1, 1 << 64)
            for name, b in (("up", self.base), ("down", inverse)):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
            self.n = n

    def windows(self, h: np.ndarray, k: int) -> np.ndarray:
        """Hash of every run of ``k`` word hashes."""
        n = len(h) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        self.upto(len(h) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * self.up[:len(h)], dtype=np.uint64)))
        return mix((sums[k:] - sums[:n]) * self.down[:n])
