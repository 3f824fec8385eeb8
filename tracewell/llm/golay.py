"""The binary Golay code of 23 bits: decoding to the nearest codeword.

Every vector of 23 bits lies within three bits of exactly one of 4,096
codewords.  Its index is the message of that codeword, 12 bits.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH, CHECKS = 23, 11
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, a generator of the code.
GENERATOR = 0b101011100011


def _remainder(vector: int) -> int:
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        if vector >> bit & 1:
            vector ^= GENERATOR << (bit - CHECKS)
    return vector


@cache
def _tables() -> tuple[list[np.ndarray], np.ndarray]:
    """Syndromes of each byte of a vector, and the error of each syndrome."""
    single = [_remainder(1 << i) for i in range(24)][:LENGTH]
    parts = []
    for low in (0, 8, 16):
        table = np.zeros(256, np.uint16)
        for i in range(8):
            if low + i < LENGTH:
                table[np.arange(256) >> i & 1 == 1] ^= single[low + i]
        parts.append(table)
    errors = np.zeros(1 << CHECKS, np.uint32)
    for weight in (1, 2, 3):
        for bits in combinations(range(LENGTH), weight):
            syndrome = 0
            for i in bits:
                syndrome ^= single[i]
            errors[syndrome] = sum(1 << i for i in bits)
    return parts, errors


def index(vectors: np.ndarray) -> np.ndarray:
    """The index of the codeword nearest to each 23-bit vector."""
    parts, errors = _tables()
    syndrome = parts[0][vectors & 255] ^ parts[1][vectors >> 8 & 255] ^ parts[2][vectors >> 16 & 255]
    return (vectors ^ errors[syndrome]) >> CHECKS


def nearby(vectors: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The indices of each vector and of those one bit (of the low ``bits``) away.

    Returns a matrix and a mask of its first occurrences by row; the first
    column is the vector's own index.  There are one to six of them in a row
    when ``bits`` is 23.
    """
    flips = np.concatenate([[0], 1 << np.arange(bits)]).astype(np.uint32)
    found = index(vectors[:, None].astype(np.uint32) ^ flips[None, :])
    order = np.argsort(found, axis=1, kind="stable")
    ranked = np.take_along_axis(found, order, 1)
    fresh = np.ones(found.shape, bool)
    fresh[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
    mask = np.zeros(found.shape, bool)
    np.put_along_axis(mask, order, fresh, 1)
    return found, mask
