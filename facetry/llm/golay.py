"""The binary Golay code of 23 bits: every word lies within 3 bits of exactly one of its 4096 codewords."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: The code's generator polynomial, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1: a fixed value.
GENERATOR = 0b110001110101
WORD_BITS, CHECK_BITS = 23, 11


def remainder(word: int) -> int:
    for bit in range(WORD_BITS - 1, CHECK_BITS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK_BITS)
    return word


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the bytes of a word; for each syndrome, its error patterns of up to 4 bits, the least first; and how many (1 or 6)."""
    unit = [remainder(1 << i) for i in range(WORD_BITS)]
    syndrome = np.zeros((3, 256), np.int64)
    for k in range(3):
        for x in range(256):
            for i in range(8):
                if x >> i & 1 and 8 * k + i < WORD_BITS:
                    syndrome[k, x] ^= unit[8 * k + i]
    patterns, n = np.zeros((1 << CHECK_BITS, 6), np.int64), np.zeros(1 << CHECK_BITS, np.int64)
    for size in range(5):
        for bits in combinations(range(WORD_BITS), size):
            s = 0
            for i in bits:
                s ^= unit[i]
            patterns[s, n[s]] = sum(1 << i for i in bits)
            n[s] += 1
    return syndrome, patterns, n


def nearby(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words of 23 bits the indices of the codewords within 4 bits, the nearest first, in six columns, and how many there are.

    Words that differ by 1 bit: the nearest codeword of one is nearby the other. Words that differ by 2: some codeword is
    nearby both, as it is nearest to a word between them.
    """
    syndrome, patterns, n = tables()
    s = syndrome[0, words & 255] ^ syndrome[1, words >> 8 & 255] ^ syndrome[2, words >> 16]
    return (words[:, None] ^ patterns[s]) >> CHECK_BITS, n[s]
