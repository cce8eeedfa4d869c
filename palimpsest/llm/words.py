"""Words and rolling window fingerprints inside Arrow batches.

A word is a maximal run of Unicode letters and digits of the lower-cased text.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np

WORD = re.compile(r"[^\W_]+")
_ODD = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def word_list(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of uint64 (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


class WordCodes(dict):
    """Word to a 64-bit code; codes depend on the word alone, so all tasks agree on them."""

    limit = 2_000_000

    def __missing__(self, word: str) -> int:
        if len(self) > self.limit:
            self.clear()
        code = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        self[word] = code
        return code

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def windows(codes: np.ndarray, k: int) -> np.ndarray:
    """Fingerprint of every window of k codes; empty for fewer than k."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, dtype=np.uint64)
        mul = np.uint64(1)
        for j in range(k):
            out += codes[j : j + n] * mul
            mul *= np.uint64(_ODD)
        return mix(out)
