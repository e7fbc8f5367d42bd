"""Keys from the binary Golay code for approximate matching of bit segments.

The (23, 12) Golay code is perfect: each 23-bit word lies within 3 bits of exactly one codeword. A
word at distance 3 from its codeword has five further codewords at distance 4. The index of the
nearest codeword and, for a word at distance 3, those of the five others are the word's keys (the
known fuzzy-hashing scheme): two words that differ in at most two bits always have a key in common.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

WIDTH, DATA = 23, 12
#: Fixed value: the code's generator polynomial, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
CHECKS = WIDTH - DATA


def syndromes(words: np.ndarray) -> np.ndarray:
    """The remainders of the words as polynomials by the generator."""
    rest = words.astype(np.int64)
    for bit in range(WIDTH - 1, CHECKS - 1, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - CHECKS)), rest)
    return rest


def error_patterns() -> np.ndarray:
    """For each syndrome up to six patterns that lead to a codeword when taken off: the lightest, then those of weight 4; -1 where there are none."""
    table = np.full((1 << CHECKS, 6), -1, np.int64)
    for weight in range(4):
        masks = np.array([sum(1 << b for b in c) for c in combinations(range(WIDTH), weight)])
        table[syndromes(masks), 0] = masks
    masks = np.array([sum(1 << b for b in c) for c in combinations(range(WIDTH), 4)])
    of = syndromes(masks)
    masks, of = masks[order := np.argsort(of, kind="stable")], of[order]
    first = np.searchsorted(of, of)
    table[of, 1 + np.arange(len(of)) - first] = masks
    return table


PATTERNS = error_patterns()


def keys(words: np.ndarray) -> np.ndarray:
    """The codeword indices of each word, in six columns; -1 where a word has fewer."""
    masks = PATTERNS[syndromes(words)]
    return np.where(masks < 0, -1, (words.astype(np.int64)[:, None] ^ masks) >> CHECKS)
