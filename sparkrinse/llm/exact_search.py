"""Exact top-k search by inner product over a vector-approximation file.

Every component is stored twice: as the number of its cell, one byte, and exactly. The marks between
cells are quantiles of a bounded sample, their outer limits are the smallest and largest component
that a block really has in the cell, so the bounds of a vector hold whatever the sample was. A first
scan reads only cells and finds, per query, a score that enough vectors are sure to reach. The second
scan reads exact vectors in the order of their upper bounds, until no bound left reaches the last
result.

Equal vectors are one entry with its smallest ids, so a vector that fills a third of the rows costs
no more than any other. ``spark.checkpoint.dir`` holds the index.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrinse.llm import vectors
from sparkrinse.staging import stage

CELLS = 32
# Vectors that the marks between cells are taken from: those with the smallest hashes of their ids.
SAMPLE = 4_096
BLOCK_VECTORS = 8_192
CHUNK_QUERIES = 1_024
# Queries whose bounds are in memory at a time, and exact vectors read at a time.
TILE, STEP = 128, 64

BLOCK = "block int, members array<array<bigint>>, marks binary, cells binary, width int, exact binary, kind string"
CHUNK = "chunk int, ids array<bigint>, least array<bigint>, exact binary, kind string, width int"


def rows_of(df: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """id, v: one row per id that is not null; of several vectors of an id the first in array order counts."""
    found = df.select(F.col(id_column).cast("bigint").alias("id"), vectors.whole(F.col(vector_column), scale).alias("v"))
    return found.where("id is not null and v is not null").groupBy("id").agg(F.min("v").alias("v"))


def sample_marks(rows: DataFrame) -> np.ndarray:
    """For each component the CELLS - 1 marks at which the next cell begins; one row per component."""
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
    sample = vectors.matrix(chosen.column(0))
    if not sample.size:
        return np.zeros((0, CELLS - 1), np.int64)
    return np.quantile(sample, np.arange(1, CELLS) / CELLS, axis=0, method="higher").T.astype(np.int64)


def approximation_file(rows: DataFrame, count: int, keep: int) -> DataFrame:
    """Packed blocks of distinct vectors, each with its ``keep`` smallest ids."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    distinct = rows.withColumn("place", place).where(F.col("place") <= keep).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("members"))
    dealt = distinct.withColumn("block", F.pmod(F.xxhash64(F.col("members")[0]), F.lit(count)).cast("int"))
    marks = sample_marks(rows)

    def pack(group: pa.Table) -> pa.Table:
        exact = vectors.matrix(group.column("v"))
        n, width = exact.shape
        ends = np.zeros((2, width, CELLS), np.int64)
        cells = np.zeros((n, width), np.uint8)
        for d in range(width):
            at = np.searchsorted(marks[d], exact[:, d], "right") if d < len(marks) else np.minimum(exact[:, d].clip(0), CELLS - 1)
            cells[:, d] = at
            low, high = np.full(CELLS, vectors.MOST), np.full(CELLS, vectors.LEAST)
            np.minimum.at(low, at, exact[:, d])
            np.maximum.at(high, at, exact[:, d])
            ends[:, d, :] = np.where(low <= high, [low, high], 0)
        data, kind, _ = vectors.packed(exact)
        return vectors.table({
            "block": ([group.column("block")[0].as_py()], pa.int32()),
            "members": ([group.column("members").to_pylist()], pa.list_(pa.list_(pa.int64()))),
            "marks": ([ends.tobytes()], pa.binary()), "cells": ([cells.tobytes()], pa.binary()), "width": ([width], pa.int32()),
            "exact": ([data], pa.binary()), "kind": ([kind], pa.string()),
        })

    return stage(dealt.groupBy("block").applyInArrow(pack, BLOCK), "search-blocks")


def query_chunks(queries: DataFrame, count: int) -> DataFrame:
    """Packed queries from rows ``id, v, least``: a score that is sure to be reached, or null."""
    def pack(group: pa.Table) -> pa.Table:
        data, kind, width = vectors.packed(vectors.matrix(group.column("v")))
        return vectors.table({
            "chunk": ([group.column("chunk")[0].as_py()], pa.int32()), "ids": ([group.column("id").to_pylist()], pa.list_(pa.int64())),
            "least": ([group.column("least").to_pylist()], pa.list_(pa.int64())),
            "exact": ([data], pa.binary()), "kind": ([kind], pa.string()), "width": ([width], pa.int32()),
        })

    dealt = queries.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int"))
    return dealt.groupBy("chunk").applyInArrow(pack, CHUNK)


class Bounds:
    """Bounds of inner products from the cells of one block."""

    def __init__(self, row: dict, queries: np.ndarray) -> None:
        width = row["width"]
        cells = np.frombuffer(row["cells"], np.uint8).reshape(-1, width) if width else np.zeros((len(row["members"]), 0), np.uint8)
        low, high = np.frombuffer(row["marks"], np.int64).reshape(2, width, CELLS).astype(np.float64)
        of = np.arange(width)
        self.middle = ((low / 2 + high / 2)[of, cells]).T
        self.half = ((high / 2 - low / 2)[of, cells]).T
        self.queries = queries.astype(np.float64)[:, :width]
        self.queries = np.pad(self.queries, ((0, 0), (0, width - self.queries.shape[1])))
        # Halves of integers are exact as long as the sums are; else the bounds are moved apart.
        reach = (np.abs(self.middle) + self.half).max(initial=0.0) * np.abs(self.queries).sum(axis=1)
        self.slack = np.where(reach < vectors.EXACT / 4, 0.0, reach * 1e-9)

    def of(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of queries lo to hi, one row per query."""
        some = self.queries[lo:hi]
        centre, reach = some @ self.middle, np.abs(some) @ self.half + self.slack[lo:hi, None]
        return centre - reach, centre + reach


def _queries(chunk: pa.Table) -> tuple[dict, np.ndarray]:
    row = chunk.to_pylist()[0]
    return row, vectors.unpacked(row["exact"], row["kind"], row["width"], len(row["ids"]))


def _sure(keep: int):
    """Per query the ``keep`` highest lower bounds of a block."""
    def meet(chunk: pa.Table, block: pa.Table) -> pa.Table:
        ids, found = [], []
        if chunk.num_rows and block.num_rows:
            row, queries = _queries(chunk)
            bounds = Bounds(block.to_pylist()[0], queries)
            for lo in range(0, len(queries), TILE):
                low, _ = bounds.of(lo, lo + TILE)
                if low.shape[1] > keep:
                    low = np.partition(low, low.shape[1] - keep, axis=1)[:, -keep:]
                low = np.floor(low).clip(-9.2e18, 9.2e18).astype(np.int64)
                ids += np.repeat(row["ids"][lo:lo + TILE], low.shape[1]).tolist()
                found += low.ravel().tolist()
        return vectors.table({"id": (ids, pa.int64()), "low": (found, pa.int64())})

    return meet


def _nearest(k: int):
    """Per query the ``k`` best rows of a block that reach the query's least score."""
    def meet(chunk: pa.Table, block: pa.Table) -> pa.Table:
        out: list[list[int]] = [[], [], []]
        if chunk.num_rows and block.num_rows:
            row, queries = _queries(chunk)
            held = block.to_pylist()[0]
            members = held["members"]
            first = np.array([m[0] for m in members], np.int64)
            bounds = Bounds(held, queries)
            exact = vectors.unpacked(held["exact"], held["kind"], held["width"], len(members))
            exact, queries = vectors.same_width(exact, queries)
            exact = vectors.Rows(exact)
            for lo in range(0, len(queries), TILE):
                _, high = bounds.of(lo, lo + TILE)
                for i, upper in enumerate(high, lo):
                    least = row["least"][i]
                    scores, at = _visited(exact, queries[i], upper, k + 1, least)
                    near = [
                        (-int(scores[place]), m) for place in vectors.best(scores, first[at], k + 1).tolist()
                        for m in members[at[place]] if m != row["ids"][i]
                    ]
                    near = sorted(near)[:k]
                    out[0] += [row["ids"][i]] * len(near)
                    out[1] += [m for _, m in near]
                    out[2] += [-score for score, _ in near]
        return vectors.table({"query_id": (out[0], pa.int64()), "vec_id": (out[1], pa.int64()), "score": (out[2], pa.int64())})

    return meet


def _visited(exact: vectors.Rows, query: np.ndarray, upper: np.ndarray, keep: int, least: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Exact scores and places of the vectors read, in the order of upper bounds, until the ``keep``-th is certain."""
    at = np.flatnonzero(upper >= least) if least is not None else np.arange(len(upper))
    at = at[np.argsort(-upper[at], kind="stable")]
    scores = np.zeros(0, np.int64)
    for lo in range(0, len(at), STEP):
        if len(scores) >= keep and np.partition(scores, len(scores) - keep)[len(scores) - keep] > upper[at[lo]]:
            break
        scores = np.concatenate([scores, exact.products(at[lo:lo + STEP], query)])
    return scores, at[:len(scores)]


def top_k(
    df: DataFrame, is_query: Column, k: int = 20, *, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 64
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` highest inner products of each query row with all other rows.

    Components become floor(scale * x). Ties go to the smaller id; fewer than ``k`` other rows are all
    returned. Rows with a null id, a null vector, or a null or non-finite component take no part. An id
    counts once, with its first vector in array order. Shorter vectors are filled up with zeros; an empty
    vector scores 0 with all. Scores beyond 64 bits become the nearest limit. Other columns are not read.
    An empty table gives no rows. ``is_query`` is a condition on the column ``id``.
    """
    rows = stage(rows_of(df, id_column, vector_column, scale), "search-rows")
    queries = rows.where(is_query).withColumn("least", F.lit(None).cast("bigint"))
    n, asked = rows.count(), queries.count()
    count, chunks = -(-n // BLOCK_VECTORS) or 1, -(-asked // CHUNK_QUERIES) or 1
    keep = k + 1
    blocks = approximation_file(rows, count, keep)
    sure = vectors.grid(
        query_chunks(queries, chunks), chunks, blocks.select("block", "members", "marks", "cells", "width"), count, _sure(keep), "id bigint, low bigint"
    )
    order = F.row_number().over(Window.partitionBy("id").orderBy(F.col("low").desc()))
    least = sure.withColumn("place", order).where(F.col("place") <= keep).where(F.col("place") == keep).select("id", F.col("low").alias("least"))
    bounded = stage(query_chunks(queries.drop("least").join(least, "id", "left"), chunks), "search-queries")
    found = vectors.grid(bounded, chunks, blocks, count, _nearest(k), "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
