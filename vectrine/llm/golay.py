"""The perfect binary Golay code [23, 12, 7]: every 23-bit word is within 3 bits of one codeword.

``keys`` gives the codeword indices of all words within one bit of a given word:
one key where the word is at most 2 bits from its codeword, six where it is 3 away.
Two words that differ in at most 2 bits always have a key in common.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

GENERATOR = 0b101011100011
N, K, R = 23, 12, 11


def remainder(x: int) -> int:
    """Syndrome: the remainder of division by the generator polynomial."""
    for i in range(N - 1, R - 1, -1):
        if x >> i & 1:
            x ^= GENERATOR << (i - R)
    return x


@lru_cache(None)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(syndrome of the upper 12 bits, masks by syndrome padded to 6, number of masks).

    A mask is what to xor to a word to reach a codeword within reach of its one-bit ball.
    """
    errors = np.zeros(1 << R, np.int64)
    for n in range(4):
        for bits in combinations(range(N), n):
            e = sum(1 << b for b in bits)
            errors[remainder(e)] = e
    single = [remainder(1 << i) for i in range(N)]
    masks, counts = np.zeros((1 << R, 6), np.int64), np.zeros(1 << R, np.int64)
    for s in range(1 << R):
        found = [int(errors[s])]
        for i in range(N):
            if (m := int(errors[s ^ single[i]]) ^ 1 << i) not in found:
                found.append(m)
        counts[s] = len(found)
        masks[s] = (found + [found[0]] * 6)[:6]
    upper = np.array([remainder(i << R) for i in range(1 << K)], np.int64)
    return upper, masks, counts


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(six codeword indices for each word, of which the first so many are distinct)."""
    upper, masks, counts = tables()
    s = upper[words >> R] ^ (words & (1 << R) - 1)
    return (words[:, None] ^ masks[s]) >> R, counts[s]
