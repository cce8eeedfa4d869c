"""Token hashes and minhash signatures.

A hash is the first 32 bits of the md5 of a token, a BIGINT in [0, 2^32); the i-th integer of a minhash family is that
of ``seed:i``. All engines that have md5 agree on them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let


def hash32(token: Column) -> Column:
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint")


def hash_tokens(tokens: Column) -> Column:
    """Hash of each token; order and repetitions are kept."""
    return F.transform(tokens, hash32)


def random_ints(n: int, seed: int) -> list[int]:
    return [int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:8], 16) for i in range(1, n + 1)]


def minhash_of_hashes(hashes: Column, n: int = 200, seed: int = 42) -> Column:
    """``n`` minima of ``hash XOR r_i``; null for null or empty hashes."""
    if n < 1:
        raise ValueError("a signature needs at least one hash")
    r = F.array(*[F.lit(x).cast("bigint") for x in random_ints(n, seed)])
    return let(hashes, lambda v: F.when(F.size(v) > 0, F.transform(r, lambda x: F.array_min(F.transform(v, lambda h: h.bitwiseXOR(x))))))


def minhash_generator(n: int = 200, seed: int = 42) -> Callable[[Column], Column]:
    """A function from tokens to their signature."""
    return lambda tokens: minhash_of_hashes(hash_tokens(tokens), n, seed)
