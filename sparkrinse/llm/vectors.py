"""Vectors of whole numbers, packed into blocks of bounded size that meet in a grid of tasks.

A block is one row with its vectors as bytes. Queries are packed the same way, and every block of
queries meets every block of vectors under the key of the two, so no task holds more than one of each.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Integers up to here are exact as doubles.
EXACT = 2**53
LEAST, MOST = -(2**63), 2**63 - 1


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component x as a double; null if the vector or a component is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return F.when(vector.isNotNull() & fine, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of 64-bit integers as rows; shorter lists are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = flat
    return out


def packed(rows: np.ndarray) -> tuple[bytes, str, int]:
    """Bytes, type and width of a matrix, in the narrowest integers that hold it."""
    low, high = int(rows.min(initial=0)), int(rows.max(initial=0))
    kind = next(k for k in ("i1", "i2", "i4", "i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return rows.astype(kind).tobytes(), kind, rows.shape[1]


def unpacked(data: bytes, kind: str, width: int, count: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(count, width).astype(np.int64)


def same_width(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Missing components count as zero."""
    width = max(left.shape[1], right.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (left, right))


class Rows:
    """Vectors whose inner products are exact 64-bit integers; those beyond 64 bits become the nearest limit."""

    def __init__(self, exact: np.ndarray) -> None:
        self.exact = exact
        self.doubles = exact.astype(np.float64)
        self.peak = np.abs(self.doubles).max(initial=0.0)

    def products(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        reach = self.peak * np.abs(query.astype(np.float64)).sum()
        if reach < EXACT:
            most = 2 * len(at) >= len(self.exact)
            found = (self.doubles @ query)[at] if most else self.doubles[at] @ query
            return found.astype(np.int64)
        if reach < 2.0**62:
            return self.exact[at] @ query
        whole_numbers = [sum(int(a) * int(b) for a, b in zip(row, query)) for row in self.exact[at]]
        return np.array([min(max(x, LEAST), MOST) for x in whole_numbers], np.int64)


def best(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` highest scores, ties to the smaller id."""
    if len(scores) > 4 * most:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - most)[len(scores) - most])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at].astype(object) if scores.min(initial=0) == LEAST else -scores[at]))][:most]


def grid(queries: DataFrame, chunks: int, blocks: DataFrame, count: int, meet: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``meet`` of every packed row of ``queries`` (column ``chunk`` below ``chunks``) and of ``blocks`` (``block`` below ``count``)."""
    left = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(count, 1) - 1))))
    right = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(max(chunks, 1) - 1))))
    return left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInArrow(meet, schema)


def table(columns: dict[str, tuple[list, pa.DataType]]) -> pa.Table:
    return pa.table({name: pa.array(values, kind) for name, (values, kind) in columns.items()})
