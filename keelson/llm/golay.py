"""Fuzzy hashing with the binary Golay code of length 23.

Every 23-bit word lies within distance 3 of exactly one of the 4,096 codewords. A word at distance 3 has five more codewords
at distance 4. Words that differ in one bit share a key: the index of the first one's nearest codeword is among the nearest
and, if that is at distance 3, the five next codewords of the other.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH, MESSAGE_BITS, CHECK_BITS = 23, 12, 11
GENERATOR = 0b110001110101      # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


@cache
def tables() -> tuple:
    """(syndromes of the low 12 bits, of the high 11 bits, nearest error pattern, the five patterns of weight 4 or -1)."""
    def remainder(x: int) -> int:
        for shift in range(MESSAGE_BITS - 1, -1, -1):
            if x >> (shift + CHECK_BITS) & 1:
                x ^= GENERATOR << shift
        return x

    low = np.array([remainder(x) for x in range(1 << 12)], np.int64)
    high = np.array([remainder(x << 12) for x in range(1 << 11)], np.int64)
    nearest = np.zeros(1 << CHECK_BITS, np.int64)
    next_ones = np.full((1 << CHECK_BITS, 5), -1, np.int64)
    filled = np.zeros(1 << CHECK_BITS, np.int64)
    for weight in range(1, 5):
        for places in combinations(range(LENGTH), weight):
            e = sum(1 << p for p in places)
            s = low[e & 4095] ^ high[e >> 12]
            if weight < 4:
                nearest[s] = e
            else:
                next_ones[s, filled[s]] = e
                filled[s] += 1
    return low, high, nearest, next_ones


def codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest codeword of every 23-bit word, and of the five next ones (-1 where the distance is below 3)."""
    low, high, nearest, next_ones = tables()
    s = low[words & 4095] ^ high[words >> 12]
    more = next_ones[s]
    return (words ^ nearest[s]) >> CHECK_BITS, np.where(more < 0, -1, (words[:, None] ^ more) >> CHECK_BITS)
