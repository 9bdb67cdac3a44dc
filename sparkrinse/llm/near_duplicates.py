"""Near-duplicate documents by min-max hashing, with links confirmed on whole shingle sets.

Under every permutation both the smallest and the largest number are kept, so 64 permutations give 128
signature values. Bands of five values propose families: documents that share a band value are tied to
the smallest one with it, never paired with each other. Within a family the whole sets are compared in
blocks of bounded size, and only a spanning forest of the confirmed links leaves a task. Texts with the
same set are one node throughout.
"""
from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrinse.llm import shingles
from sparkrinse.llm.components import components
from sparkrinse.staging import stage

WORDS = 5
PERMUTATIONS = 64
BAND_VALUES = 5
# Shingles that one block of a family holds together, and documents.
BLOCK_SHINGLES = 1_000_000
BLOCK_DOCUMENTS = 1_500
COMMON = 24


def set_key(numbers: np.ndarray) -> bytes:
    return hashlib.blake2b(numbers.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, id_column: str, text_column: str, words: int = WORDS) -> DataFrame:
    """doc_id, text_hash, n_shingles, key (null without words), bands: one number per band of signature values."""
    bands = 2 * PERMUTATIONS // BAND_VALUES

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, shifts = shingles.permutations(PERMUTATIONS)
        weights, _ = shingles.permutations(BAND_VALUES)
        for batch in batches:
            sizes, keys, values = [], [], []
            for numbers in shingles.shingle_sets(batch.column(1), words):
                sizes.append(len(numbers))
                keys.append(set_key(numbers) if len(numbers) else None)
                if len(numbers):
                    rows = shingles.min_max(numbers, factors, shifts).ravel()[:bands * BAND_VALUES].reshape(bands, BAND_VALUES)
                    mixed = (rows ^ (rows >> shingles.FOLD)) * weights
                    values.append(mixed.sum(axis=1, dtype=np.uint64).view(np.int64))
                else:
                    values.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(values, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "n_shingles", "key", "bands"],
            )

    text = F.col(text_column).cast("string")
    chosen = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return chosen.mapInArrow(sign, "doc_id bigint, text_hash bigint, n_shingles bigint, key binary, bands array<bigint>")


def confirmed(sets: list[np.ndarray], numerator: int, denominator: int, apart: int | None = None) -> np.ndarray:
    """For each set the first one it is connected to by links of at least numerator / denominator.

    With ``apart``, only links between the first ``apart`` sets and the others are looked for.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    _, column, frequency = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.zeros((n, n), np.float32)
    wide = frequency >= COMMON
    for lo in range(0, int(wide.sum()), 4096):
        place = np.cumsum(wide) - 1
        mine = wide[column] & (place[column] >= lo) & (place[column] < lo + 4096)
        matrix = np.zeros((n, min(4096, int(wide.sum()) - lo)), np.float32)
        matrix[owner[mine], place[column[mine]] - lo] = 1
        shared += matrix @ matrix.T
    few = ~wide[column] & (frequency[column] > 1)
    order = np.argsort(column[few], kind="stable")
    who, at = owner[few][order], column[few][order]
    for gap in range(1, COMMON):
        same = at[gap:] == at[:-gap]
        if not same.any():
            break
        np.add.at(shared, (who[:-gap][same], who[gap:][same]), 1)
        np.add.at(shared, (who[gap:][same], who[:-gap][same]), 1)
    linked = denominator * shared >= numerator * (sizes[:, None] + sizes[None, :] - shared)
    if apart is not None:
        linked[:apart, :apart] = False
        linked[apart:, apart:] = False
    label = np.arange(n)
    for i in range(n):
        near = np.flatnonzero(linked[i])
        if len(near):
            joined = np.unique(label[np.append(near, i)])
            if len(joined) > 1:
                label[np.isin(label, joined)] = joined[0]
    return label


def near_duplicates(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    numerator: int = 85,
    denominator: int = 100,
    words: int = WORDS,
) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, group (a key, null without words), component_id.

    Documents are linked if denominator * intersection >= numerator * union of their shingle sets;
    ``component_id`` is the smallest doc_id reachable. Null or wordless texts have no set and are their
    own component. A null doc_id never names a component that has any other id; repeated rows share one.
    Columns beyond the two named are not read.
    """
    signed = stage(signatures(docs, id_column, text_column, words), "signatures")
    nodes = signed.filter("key is not null").groupBy("key").agg(
        F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n_shingles"), F.any_value("bands").alias("bands")
    )
    banded = stage(nodes.select("key", "first_id", "n_shingles", F.posexplode("bands").alias("band", "value")), "bands")
    centres = banded.groupBy("band", "value").agg(F.min("key").alias("centre"), F.count("*").alias("n")).filter("n > 1")
    ties = banded.join(centres, ["band", "value"]).select("key", "centre").filter("key != centre")
    families = components(ties, "key", "centre").withColumnRenamed("component", "family")
    members = banded.filter("band = 0").select("key", "first_id", "n_shingles").join(
        families.withColumnRenamed("node", "key"), "key"
    )
    sizes = members.groupBy("family").agg(
        F.greatest(F.ceil(F.sum("n_shingles") / F.lit(BLOCK_SHINGLES)), F.ceil(F.count("*") / F.lit(BLOCK_DOCUMENTS))).alias("blocks")
    )
    members = stage(
        members.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks"))), "members"
    )
    links = _links(docs, members, id_column, text_column, numerator, denominator, words)
    groups = components(links)
    placed = signed.select("doc_id", "text_hash", "n_shingles", "key").join(
        groups.select(F.col("node").alias("key"), F.col("component").alias("__group")), "key", "left"
    ).withColumn("__group", F.coalesce("__group", "key"))
    first = placed.filter("key is not null").groupBy("__group").agg(F.min("doc_id").alias("__first"))
    return placed.join(first, "__group", "left").select(
        "doc_id", "text_hash", "n_shingles", F.col("__group").alias("group"),
        F.coalesce(F.col("__first"), F.col("doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """``docs`` with one row of every group, the one with the smallest id; options as in ``near_duplicates``.

    Rows without words are in no group and all stay.
    """
    found = stage(near_duplicates(docs, id_column=id_column, text_column=text_column, **options), "near-duplicates")
    kept = found.filter("group is not null").groupBy("group").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("best")
    ).select(F.col("best.doc_id").alias("__k_id"), F.col("best.text_hash").alias("__k_hash"))
    wordless = found.filter("group is null").select(F.col("doc_id").alias("__k_id"), F.col("text_hash").alias("__k_hash")).distinct()
    chosen = kept.withColumn("__once", F.lit(True)).unionByName(wordless.withColumn("__once", F.lit(False)))
    hashed = docs.withColumn("__t_hash", F.xxhash64(F.col(text_column).cast("string"))).withColumn("__t_id", F.col(id_column).cast("bigint"))
    on = F.col("__t_id").eqNullSafe(F.col("__k_id")) & (F.col("__t_hash") == F.col("__k_hash"))
    # Of rows with the same id and text one stays, unless they have no words.
    row = F.when(F.col("__once"), F.lit(0)).otherwise(F.monotonically_increasing_id())
    return (
        hashed.join(chosen, on).withColumn("__copy", row)
        .dropDuplicates(["__t_id", "__t_hash", "__copy"]).select(*[F.col(f"`{c}`") for c in docs.columns])
    )


def _links(docs, members, id_column, text_column, numerator, denominator, words) -> DataFrame:
    """Spanning links a, b between keys, confirmed on the whole sets of the members."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shingles.shingle_sets(batch.column(0), words))
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_key(s) if len(s) else None for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())],
                ["key", "numbers"],
            )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            row for batch in batches
            for row in zip(*(batch.column(k).to_pylist() for k in ("family", "low", "high", "block", "key", "numbers")))
        )
        kept_a: list[bytes] = []
        kept_b: list[bytes] = []
        for (_, low, high), group in itertools.groupby(rows, key=lambda r: r[:3]):
            held = {}
            for *_, block, key, numbers in group:  # rows come by block, then key
                held.setdefault((block, key), numbers)
            if len(held) < 2:
                continue
            keys = [key for _, key in held]
            apart = None if low == high else sum(block == low for block, _ in held)
            label = confirmed([np.frombuffer(v, np.uint64) for v in held.values()], numerator, denominator, apart)
            for key, to in zip(keys, label.tolist()):
                if keys[to] != key:
                    kept_a.append(key)
                    kept_b.append(keys[to])
            if len(kept_a) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(kept_a, pa.binary()), pa.array(kept_b, pa.binary())], ["a", "b"])
                kept_a, kept_b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(kept_a, pa.binary()), pa.array(kept_b, pa.binary())], ["a", "b"])

    # The texts of members only; a repeated id may bring another text, whose key then finds no member.
    chosen = docs.select(F.col(id_column).cast("bigint").alias("__id"), F.col(text_column).cast("string").alias("__text"))
    texts = chosen.join(members.select(F.col("first_id").alias("__other")).distinct(), F.col("__id").eqNullSafe(F.col("__other")), "left_semi")
    own = texts.select("__text").mapInArrow(sets, "key binary, numbers binary").filter("key is not null").dropDuplicates(["key"])
    blocks = F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
    dealt = (
        members.join(own, "key")
        .withColumn("other", F.explode(blocks))
        .select("family", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "key", "numbers")
    )
    return (
        dealt.repartition("family", "low", "high").sortWithinPartitions("family", "low", "high", "block", "key")
        .mapInArrow(link, "a binary, b binary")
    )


def with_verdict(found: DataFrame) -> DataFrame:
    """Digest columns: the document that names its component stays."""
    return found.select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
