"""Shingle sets of word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from galena.llm._common import mixed
from galena.llm._words import batch_words

_FACTORS = np.random.default_rng(78).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` words from each place on."""
    count = len(hashes) - n + 1
    if count < 1:
        return np.zeros(0, np.uint64)
    total = hashes[:count] * _FACTORS[0]
    for k in range(1, n):
        total += hashes[k : k + count] * _FACTORS[k]
    return mixed(total + np.uint64(n))


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``n``-word shingles.

    A text of fewer words, but some, has its whole sequence as its one shingle.
    """
    for hashes in batch_words(column):
        yield np.unique(grams(hashes, min(n, len(hashes)))) if len(hashes) else np.zeros(0, np.uint64)
