"""Hard negatives by inner product, with coordinate pruning in buckets of similar length.

Vectors are dealt by length into buckets of bounded size, longest first; a bucket holds, for every
coordinate, its vectors sorted by that coordinate of the unit vector. A target (an anchor and the
range of scores it wants) skips a bucket whose longest vector cannot reach the range. Else the least
cosine it needs there bounds each coordinate of a unit vector; the rows of the feasible ranges of the
target's largest coordinates are intersected, and what is left is verified exactly. The longest bucket
is searched first and gives each target the score that the others have to reach.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrinse.llm import vectors
from sparkrinse.staging import stage

BUCKET_VECTORS = 8_192
CHUNK_TARGETS = 512
# Coordinates whose feasible ranges are intersected.
FOCUS = 4
# Room for rounding in lengths and cosines.
ROOM = 1e-9

BUCKET = "block int, ids array<bigint>, labels array<bigint>, exact binary, kind string, width int, lengths binary, lists binary"
TARGET = "anchor bigint, positive bigint, label bigint, v array<bigint>, low bigint, high bigint"
CHUNK = "chunk int, anchors array<bigint>, positives array<bigint>, labels array<bigint>, low array<bigint>, high array<bigint>, exact binary, kind string, width int"
FOUND = "anchor bigint, positive bigint, id bigint, score bigint"


def rows_of(df: DataFrame, id_column: str, vector_column: str, label_column: str, scale: int) -> DataFrame:
    """id, label, v: one row per id, without missing values; of several rows of an id the smallest label and vector counts."""
    found = df.select(
        F.col(id_column).cast("bigint").alias("id"), F.col(label_column).cast("bigint").alias("label"),
        vectors.whole(F.col(vector_column), scale).alias("v"),
    ).where("id is not null and label is not null and v is not null")
    return found.groupBy("id").agg(F.min(F.struct("label", "v")).alias("row")).select("id", "row.label", "row.v")


def length_buckets(rows: DataFrame, count: int) -> DataFrame:
    """Packed buckets, cut by length and, where many vectors have the same, by a hash of the id."""
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    dealt = rows.withColumn("square", square).repartitionByRange(count, F.col("square").desc(), F.xxhash64("id"))

    def pack(batches):
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        group = pa.Table.from_batches(held)
        exact = vectors.matrix(group.column("v"))
        lengths = np.sqrt((exact.astype(np.float64) ** 2).sum(axis=1))
        order = np.argsort(-lengths, kind="stable")
        exact, lengths = exact[order], lengths[order]
        unit = exact / np.maximum(lengths, 1e-300)[:, None]
        data, kind, width = vectors.packed(exact)
        lists = np.argsort(unit, axis=0, kind="stable").T.astype(np.int32)
        yield pa.RecordBatch.from_arrays([
            pa.array([group.column("block")[0].as_py()], pa.int32()),
            pa.array([group.column("id").take(pa.array(order)).to_pylist()], pa.list_(pa.int64())),
            pa.array([group.column("label").take(pa.array(order)).to_pylist()], pa.list_(pa.int64())),
            pa.array([data], pa.binary()), pa.array([kind], pa.string()), pa.array([width], pa.int32()),
            pa.array([lengths.tobytes()], pa.binary()), pa.array([lists.tobytes()], pa.binary()),
        ], ["block", "ids", "labels", "exact", "kind", "width", "lengths", "lists"])

    numbered = dealt.withColumn("block", F.spark_partition_id()).select("block", "id", "label", "v")
    return stage(numbered.mapInArrow(pack, BUCKET), "length-buckets")


def _chunks(targets: DataFrame, count: int) -> DataFrame:
    def pack(group: pa.Table) -> pa.Table:
        data, kind, width = vectors.packed(vectors.matrix(group.column("v")))
        lists = pa.list_(pa.int64())
        return vectors.table({
            "chunk": ([group.column("chunk")[0].as_py()], pa.int32()),
            **{out: ([group.column(name).to_pylist()], lists) for out, name in
               (("anchors", "anchor"), ("positives", "positive"), ("labels", "label"), ("low", "low"), ("high", "high"))},
            "exact": ([data], pa.binary()), "kind": ([kind], pa.string()), "width": ([width], pa.int32()),
        })

    dealt = targets.withColumn("chunk", F.pmod(F.xxhash64("anchor", "positive"), F.lit(count)).cast("int"))
    return stage(dealt.groupBy("chunk").applyInArrow(pack, CHUNK), "negative-targets")


class Bucket:
    """Vectors of similar length, longest first, with a sorted list per coordinate."""

    def __init__(self, row: dict, width: int) -> None:
        self.ids = np.array(row["ids"], np.int64)
        self.labels = np.array(row["labels"], np.int64)
        self.lengths = np.frombuffer(row["lengths"], np.float64)
        self.lists = np.frombuffer(row["lists"], np.int32).reshape(row["width"], len(self.ids))
        exact = vectors.unpacked(row["exact"], row["kind"], row["width"], len(self.ids))
        self.unit = exact / np.maximum(self.lengths, 1e-300)[:, None]
        self.exact = vectors.Rows(np.pad(exact, ((0, 0), (0, max(0, width - exact.shape[1])))))

    def candidates(self, query: np.ndarray, low: int) -> np.ndarray:
        """Places of vectors whose inner product with the query may reach ``low``."""
        everything = np.arange(len(self.ids))
        length = float(np.sqrt((query.astype(np.float64) ** 2).sum()))
        if low <= 0:
            return everything
        reach = length * self.lengths * (1 + ROOM)
        if not len(reach) or reach[0] < low:
            return everything[:0]
        long_enough = int(np.searchsorted(-reach, -low, "right"))
        cosine = min(low / reach[0], 1.0)
        unit = query[:len(self.lists)] / length
        hits = np.zeros(len(self.ids), np.int8)
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        for f in focus:
            spread = np.sqrt(max(0.0, (1 - cosine**2) * (1 - unit[f] ** 2))) + ROOM
            # The nearer the axis itself is to the query, the further a feasible vector may turn to it.
            least = -1.0 - ROOM if -unit[f] >= cosine else cosine * unit[f] - spread
            most = 1.0 + ROOM if unit[f] >= cosine else cosine * unit[f] + spread
            values = self.unit[self.lists[f], f]
            hits[self.lists[f][np.searchsorted(values, least, "left"):np.searchsorted(values, most, "right")]] += 1
        return np.flatnonzero(hits[:long_enough] == len(focus))


def _search(most: int, same_label: bool):
    """Per target the ``most`` best rows of a bucket with a score between its limits."""
    def meet(chunk: pa.Table, bucket: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if chunk.num_rows and bucket.num_rows:
            row = chunk.to_pylist()[0]
            queries = vectors.unpacked(row["exact"], row["kind"], row["width"], len(row["anchors"]))
            held = Bucket(bucket.to_pylist()[0], queries.shape[1])
            queries = np.pad(queries, ((0, 0), (0, max(0, held.exact.exact.shape[1] - queries.shape[1]))))
            for query, anchor, positive, label, low, high in zip(queries, *[row[c] for c in ("anchors", "positives", "labels", "low", "high")]):
                at = held.candidates(query, low)
                at = at[((held.labels[at] == label) == same_label) & (held.ids[at] != anchor)]
                scores = held.exact.products(at, query)
                fits = (scores >= low) & (scores <= high)
                at, scores = at[fits], scores[fits]
                chosen = vectors.best(scores, held.ids[at], most)
                for values, found in zip(out, ([anchor] * len(chosen), [positive] * len(chosen), held.ids[at[chosen]].tolist(), scores[chosen].tolist())):
                    values += found
        return vectors.table({n: (v, pa.int64()) for n, v in zip(("anchor", "positive", "id", "score"), out)})

    return meet


def _best(targets: DataFrame, buckets: DataFrame, count: int, most: int, same_label: bool) -> DataFrame:
    """anchor, positive, id, score, rank: the ``most`` best rows of every target."""
    targets = stage(targets, "targets")
    chunks = -(-targets.count() // CHUNK_TARGETS) or 1
    order = F.row_number().over(Window.partitionBy("anchor", "positive").orderBy(F.col("score").desc(), "id"))

    def ranked(asked: DataFrame, of: DataFrame, n: int) -> DataFrame:
        found = vectors.grid(_chunks(asked, chunks), chunks, of, n, _search(most, same_label), FOUND)
        return found.withColumn("rank", order).where(F.col("rank") <= most)

    probe = ranked(targets, buckets.where("block = 0"), 1).where(F.col("rank") == most)
    reached = probe.select("anchor", F.col("positive").alias("other"), F.col("score").alias("reached"))
    raised = targets.join(reached, (targets["anchor"] == reached["anchor"]) & targets["positive"].eqNullSafe(reached["other"]), "left")
    raised = raised.select(targets["anchor"], "positive", "label", "v", F.greatest("low", F.coalesce("reached", "low")).alias("low"), "high")
    return ranked(raised, buckets, count)


def mine(
    df: DataFrame,
    is_anchor: Column,
    *,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are the best rows of its label; for each, the best rows of other labels with
    ``low * positive_score <= 100 * negative_score <= high * positive_score`` are ranked from 1. Scores
    are inner products of floor(scale * x), ties go to the smaller id. A negative positive score leaves
    no such rows. Rows with a null id, label, vector or component, or a component that is not finite, take
    no part. An id counts once, with its smallest label and then its first vector. Shorter vectors are
    filled up with zeros. Scores beyond 64 bits become the nearest limit. Other columns are not read. An
    empty table gives no rows. ``is_anchor`` is a condition on the column ``id``.
    """
    rows = stage(rows_of(df, id_column, vector_column, label_column, scale), "negative-rows")
    buckets = length_buckets(rows, -(-rows.count() // BUCKET_VECTORS) or 1)
    count = (buckets.agg(F.max("block")).first()[0] or 0) + 1
    anchors = rows.where(is_anchor).select(
        F.col("id").alias("anchor"), F.lit(None).cast("bigint").alias("positive"), "label", "v",
        F.lit(vectors.LEAST).alias("low"), F.lit(vectors.MOST).alias("high"),
    )
    near = stage(_best(anchors, buckets, count, positives, True).select("anchor", F.col("id").alias("positive"), F.col("score").alias("positive_score")), "positives")
    # Whole numbers of 64 bits times a percentage need more than 64 bits.
    wide = F.col("positive_score").cast("decimal(20,0)")
    limits = near.withColumn("low", F.ceil(wide * F.lit(low).cast("decimal(9,0)") / F.lit(100).cast("decimal(3,0)")).cast("bigint")).withColumn(
        "high", F.floor(wide * F.lit(high).cast("decimal(9,0)") / F.lit(100).cast("decimal(3,0)")).cast("bigint")
    )
    wanted = limits.where("low <= high").join(anchors.select("anchor", "label", "v"), "anchor")
    found = _best(wanted.select("anchor", "positive", "label", "v", "low", "high"), buckets, count, negatives, False)
    return found.join(near, ["anchor", "positive"]).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
