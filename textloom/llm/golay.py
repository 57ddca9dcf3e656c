"""The binary Golay code (23, 12): nearest codewords of 23-bit words, from its generator polynomial."""

from __future__ import annotations

from itertools import combinations

import numpy as np

N, K = 23, 12
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
CHECKS = N - K


def _rest(word: int) -> int:
    for bit in range(N - 1, CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECKS)
    return word


_made: list = []


def tables():
    """The tables, made once by each process."""
    if not _made:
        _made.append(_tables())
    return _made[0]


def _tables():
    """By 11-bit syndrome: the error patterns to the nearest codeword and, where that is three bits away, to the five
    codewords at distance four. ``count`` says how many there are (1 or 6)."""
    bit_rest = [_rest(1 << i) for i in range(N)]
    errors = np.zeros((1 << CHECKS, 6), np.int64)
    count = np.zeros(1 << CHECKS, np.int64)
    for weight in range(5):
        for bits in combinations(range(N), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= bit_rest[b]
            nearest = int(errors[syndrome, 0]).bit_count()
            if weight <= 3 or nearest == 3:
                errors[syndrome, count[syndrome]] = sum(1 << b for b in bits)
                count[syndrome] += 1
    # Syndromes of 23-bit words by their low 12 and high 11 bits.
    low = np.array([_rest(i) for i in range(1 << 12)])
    high = np.array([_rest(i << 12) for i in range(1 << 11)])
    return errors, count, low, high


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices (12 bits) of each word, nearest first, six columns, and how many of them count.

    Of two words that differ in at most one bit, the nearest codeword of either is among the keys of the other: a
    word at most two bits from its codeword takes its neighbours' codeword along, and a word three bits away lists
    every codeword up to distance four, where its neighbours' codewords must lie.
    """
    errors, count, low, high = tables()
    syndrome = low[words & 0xFFF] ^ high[words >> 12]
    return (words[:, None] ^ errors[syndrome]) >> CHECKS, count[syndrome]
