"""Whole texts as word lists, for Arrow batches inside tasks and as column expressions."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed word patterns of the operators' contracts.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
LETTER_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def spaced_table(lower: bool) -> bytes:
    """Byte table for words between ASCII white space."""
    return bytes(b + 32 if lower and 65 <= b <= 90 else b for b in range(256))


def letter_table() -> bytes:
    """Byte table for words of ASCII letters and digits and of everything beyond ASCII, A-Z lowered."""
    kept = {*range(48, 58), *range(97, 123), *range(128, 256)}
    return bytes(c if (c := b + 32 if 65 <= b <= 90 else b) in kept else 32 for b in range(256))


def split_words(texts: pa.Array, table: bytes) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts one after the other, and n + 1 bounds: text i has words bounds[i]:bounds[i + 1].

    Nulls have no words. ``table`` maps bytes; those of characters beyond ASCII must stay as they are.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    own = data.slice(at[0], at[-1] - at[0]).to_pybytes() if data is not None else b""
    mapped = pa.LargeStringArray.from_buffers(
        len(texts), pa.py_buffer((at - at[0]).tobytes()), pa.py_buffer(own.translate(table))
    )
    split = pc.ascii_split_whitespace(mapped)
    words = split.flatten()
    bounds = split.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    before = np.concatenate([[0], np.cumsum(full)])
    return words.filter(pa.array(full)), before[bounds]


def portions(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about ``most`` bytes together, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi
