"""Sets of five-word shingles of whole texts as sorted 64-bit numbers, inside tasks."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from sparkrinse.llm.words import portions, spaced_table, split_words

PORTION_BYTES = 16 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)
FOLD = np.uint64(29)


def _chained(parts: list[np.ndarray]) -> np.ndarray:
    out = np.full(len(parts[0]), len(parts), np.uint64)
    for part in parts:
        out = (out ^ (out >> FOLD)) * MIX + part
    out = (out ^ (out >> FOLD)) * MIX
    return out ^ (out >> np.uint64(32))


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """One sorted array of distinct shingle numbers per text; fewer words than ``size`` are one shingle."""
    for lo, hi in portions(texts, PORTION_BYTES):
        words, bounds = split_words(texts.slice(lo, hi - lo), spaced_table(lower=True))
        coded = words.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).astype(object)
        known = pd.util.hash_array(names, categorize=False) if len(names) else np.zeros(0, np.uint64)
        numbers = known[coded.indices.to_numpy(zero_copy_only=False)]
        whole = len(numbers) - size + 1
        chained = _chained([numbers[k:k + whole] for k in range(size)]) if whole > 0 else numbers[:0]
        for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if end - start >= size:
                yield np.unique(chained[start:end - size + 1])
            elif end > start:
                yield _chained([numbers[k:k + 1] for k in range(start, end)])
            else:
                yield chained[:0]


def permutations(number: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and shifts; with wrap-around each is a permutation of the 64-bit numbers."""
    drawn = np.random.default_rng(20_240_229).integers(0, 2**64, (2, number), dtype=np.uint64, endpoint=False)
    return drawn[0] | np.uint64(1), drawn[1]


def min_max(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Smallest and largest number under each permutation, one row per permutation."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(factors), np.uint64)
    for at in range(0, len(shingles), 2048):
        dealt = shingles[at:at + 2048, None] * factors + shifts
        np.minimum(low, dealt.min(axis=0), out=low)
        np.maximum(high, dealt.max(axis=0), out=high)
    return np.stack([low, high], axis=1)
