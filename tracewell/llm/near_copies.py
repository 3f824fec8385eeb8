"""Sets of word shingles, compared exactly.

Two sets are linked once their Jaccard similarity is at least the threshold; of
a bucket of sets the links are a spanning forest, so n near copies give n - 1.

Which sets meet in a bucket is the caller's matter.  Bands of MinHash values
complete the buckets of fuzzy fingerprint keys: two sets at the threshold share
a band with probability 0.998.
"""

from __future__ import annotations

import numpy as np
import xxhash

SIMILARITY = 0.8
BANDS, ROWS = 16, 5
_RNG = np.random.default_rng(23)
_ODD = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def bands_of(shingles: np.ndarray) -> np.ndarray:
    """A key for each band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 4096):
        mixed = shingles[at : at + 4096, None] * _ODD + _ADD
        mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        least = np.minimum(least, (mixed ^ mixed >> np.uint64(32)).min(0))
    return np.array([xxhash.xxh64_intdigest(bytes([k]) + band.tobytes()) for k, band in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two sorted sets are similar."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def forest(nodes: np.ndarray, sets: list[np.ndarray], similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Links of similar sets that join what such links join at all."""
    sizes = np.array([len(s) for s in sets])
    rest, left, right = np.arange(len(sets)), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while len(rest):
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            at = reached.pop()
            near = np.zeros(len(rest), bool)
            fit = np.flatnonzero(np.minimum(sizes[rest], sizes[at]) >= similarity * np.maximum(sizes[rest], sizes[at]) - 1e-9)
            for lot in (fit[k : k + 512] for k in range(0, len(fit), 512)):
                joined = np.concatenate([sets[k] for k in rest[lot]])
                place = np.minimum(np.searchsorted(sets[at], joined), sizes[at] - 1)
                starts = np.concatenate([[0], np.cumsum(sizes[rest[lot]])[:-1]])
                both = np.add.reduceat((sets[at][place] == joined).astype(np.int64), starts)
                near[lot] = both >= similarity * (sizes[rest[lot]] + sizes[at] - both) - 1e-9
            left.append(np.full(near.sum(), nodes[at]))
            right.append(nodes[rest[near]])
            reached.extend(rest[near])
            rest = rest[~near]
    return np.concatenate(left), np.concatenate(right)
