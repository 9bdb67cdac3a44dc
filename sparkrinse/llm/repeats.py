"""Byte strings of a given length that occur more than once, across and within documents.

Every window of ``length`` bytes names an anchor: the smallest hash of a 32-byte string inside it. The
windows of one anchor are consecutive, and equal windows have equal anchors at the same place, so
comparing the surroundings of equal anchors compares everything. Equal surroundings are counted without
moving any text. Where an anchor has different surroundings, these are brought together: the array of
their left sides (read backwards) is scanned with a stack into its tree of common-prefix intervals, and
within an interval the sorted array of right sides gives each member's longest match. An interval is
left-diverse: its members differ in the byte before their common part, so a match found there cannot be
extended for all of them.

Anchors with very many surroundings are compared in pairs of blocks of bounded size; a window is
repeated if any pair of blocks shows it.
"""
from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrinse.staging import stage

LENGTH = 400
GRAM = 32
# Window starts looked at together; longer texts are taken in pieces that overlap.
PIECE = 1 << 20
BLOCK = 3_000
PLACE = np.uint64((1 << 24) - 1)


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """Mixed 64-bit numbers of all 32-byte strings."""
    out = text.astype(np.uint64) + np.uint64(1)
    factor = 0x9E3779B97F4A7C15
    for span in (1, 2, 4, 8, 16):
        out = out[:-span] * np.uint64(factor) + out[span:]
        factor = (factor * factor) % (1 << 64)
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def runs(text: bytes, length: int) -> list[tuple[int, int, int, int, int]]:
    """Runs of windows with one anchor: anchor key, key of the surroundings, first window, last window, anchor."""
    out = []
    for base in range(0, len(text) - length + 1, PIECE):
        part = np.frombuffer(text, np.uint8)[base:base + PIECE + length - 1]
        hashes = gram_hashes(part)
        width = length - GRAM + 1
        placed = (hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64)
        # Smallest of every `width` neighbours, from the running minima of blocks of that width.
        full = np.full(-(-len(placed) // width) * width, np.iinfo(np.uint64).max, np.uint64)
        full[:len(placed)] = placed
        rows = full.reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        number = len(part) - length + 1
        least = np.minimum(back[:number], ahead[width - 1:width - 1 + number])
        first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        last = np.append(first[1:], number) - 1
        anchor = (least[first] & PLACE).astype(np.int64)
        keys = hashes[anchor].view(np.int64)
        for key, lo, hi, at in zip(keys.tolist(), (first + base).tolist(), (last + base).tolist(), (anchor + base).tolist()):
            around = hashlib.blake2b(text[lo:hi + length], digest_size=8, salt=(at - lo).to_bytes(8, "little")).digest()
            out.append((key, int.from_bytes(around, "little", signed=True), lo, hi, at))
    return out


def common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())


def intervals(shared: list[int]) -> Iterator[tuple[int, int, int]]:
    """Common-prefix intervals (first, last, length) of a sorted array, from its neighbours' shared lengths."""
    stack = [(0, 0)]
    for i, value in enumerate([*shared, -1]):
        start = i
        while stack and stack[-1][1] > value:
            start, length = stack.pop()
            yield start, i, length
        if not stack or stack[-1][1] < value:
            stack.append((start, value))


def spans_of(sides: list[tuple[bytes, bytes]], length: int) -> list[list[tuple[int, int]]]:
    """For each (left side backwards, right side) the spans around its anchor that some other one repeats."""
    by_left = sorted(range(len(sides)), key=lambda i: sides[i][0])
    by_right = sorted(range(len(sides)), key=lambda i: sides[i][1])
    left = [common(sides[a][0], sides[b][0]) for a, b in zip(by_left, by_left[1:])]
    right = np.array([common(sides[a][1], sides[b][1]) for a, b in zip(by_right, by_right[1:])], np.int64)
    rank = np.empty(len(sides), np.int64)
    rank[by_right] = np.arange(len(sides))
    found: list[list[tuple[int, int]]] = [[] for _ in sides]
    longest = right.max(initial=0)
    for first, last, reach in intervals(left):
        if last == first or reach + longest < length:
            continue
        order = np.sort(rank[by_left[first:last + 1]])
        next_to = np.minimum.reduceat(right[:order[-1]], order[:-1])
        best = np.zeros(len(order), np.int64)
        best[:-1] = next_to
        best[1:] = np.maximum(best[1:], next_to)
        for k in np.flatnonzero(best + reach >= length):
            found[by_right[order[k]]].append((-reach, int(best[k])))
    return [merged(f) for f in found]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _anchors(length: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "anchor", "around", "first", "last", "at"]
        for batch in batches:
            out: list[list[int]] = [[] for _ in names]
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for run in runs((text.as_py() or "").encode(), length):
                    for column, value in zip(out, (row, *run)):
                        column.append(value)
                if len(out[0]) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)
                    out = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)

    return find


def _sides(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "around", "block", "blocks", "left", "right"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        for batch in batches:
            for text, wanted in zip(batch.column(0), batch.column(1)):
                data, rows = text.as_py().encode(), []
                for w in wanted.as_py():
                    at, end = w["at"], w["last"] + length
                    rows.append((w["anchor"], w["around"], w["block"], w["blocks"], data[w["first"]:at][::-1], data[at:end]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return cut


def _compare(length: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        out: list[list] = [[], [], []]

        def packed() -> pa.RecordBatch:
            spans = [[{"start": a, "end": b} for a, b in s] for s in out[2]]
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(spans, SPANS)], ["anchor", "around", "spans"])

        for (anchor, _, _), group in itertools.groupby(rows, key=lambda r: r[:3]):
            members = {around: (left, right) for *_, around, left, right in group}
            if len(members) < 2:
                continue
            for around, spans in zip(members, spans_of(list(members.values()), length)):
                if spans:
                    for column, value in zip(out, (anchor, around, spans)):
                        column.append(value)
            if len(out[0]) > 20_000:
                yield packed()
                out[:] = [[], [], []]
        yield packed()

    return compare


def repeated_spans(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(occurrences, spans).

    Occurrences: ``anchor``, ``around`` (a group of equal surroundings), ``row`` (hash of id and text) and
    the bytes ``start`` to ``end`` of the row's text that the group repeats: all occurrences of each group
    with a repeat of ``length`` or more. Spans: ``row`` and the merged spans of each text that has any.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    chosen = docs.select(F.xxhash64(F.col(id_column), text).alias("row"), text.alias("text"))
    long = chosen.filter(F.octet_length("text") >= length)
    found = stage(long.mapInArrow(_anchors(length), "row bigint, anchor bigint, around bigint, first bigint, last bigint, at bigint"), "anchors")
    around = stage(
        found.groupBy("anchor", "around").agg(F.count("*").alias("n"), F.min(F.struct("row", "first", "last", "at")).alias("one")), "surroundings"
    )
    kinds = around.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1").withColumn("blocks", F.ceil(F.col("kinds") / BLOCK))
    wanted = around.join(kinds, "anchor").select(
        F.col("one.row").alias("w_row"),
        F.struct("anchor", "around", "one.first", "one.last", "one.at", F.pmod(F.xxhash64("around"), F.col("blocks")).alias("block"), "blocks").alias("w"),
    ).groupBy("w_row").agg(F.collect_list("w").alias("wanted"))
    # Rows that repeat have the same hash; one of them will do.
    texts = long.join(wanted, F.col("row") == F.col("w_row")).dropDuplicates(["row"]).select("text", "wanted")
    sides = texts.mapInArrow(_sides(length), "anchor bigint, around bigint, block bigint, blocks bigint, left binary, right binary")
    dealt = sides.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).select(
        "anchor", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "around", "left", "right"
    )
    keys = ("anchor", "low", "high")
    compared = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
        _compare(length), "anchor bigint, around bigint, spans array<struct<start: bigint, end: bigint>>"
    )
    partly = stage(compared, "repeats")
    everywhere = around.filter("n > 1").select(
        "anchor", "around", F.array(F.struct((F.col("one.first") - F.col("one.at")).alias("start"), (F.col("one.last") + length - F.col("one.at")).alias("end"))).alias("spans")
    )
    groups = partly.unionByName(everywhere)
    occurrences = found.select("row", "anchor", "around", "at").join(
        groups.select("anchor", "around", F.explode("spans").alias("span")), ["anchor", "around"]
    ).select("anchor", "around", "row", (F.col("at") + F.col("span.start")).alias("start"), (F.col("at") + F.col("span.end")).alias("end"))
    pieces = occurrences.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    empty = F.array().cast("array<struct<start: bigint, end: bigint>>")

    def add(done, s):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when(F.size(done) == 0, F.array(s)).when(s["start"] <= last["end"], joined).otherwise(F.concat(done, F.array(s)))

    return occurrences, pieces.select("row", F.aggregate("spans", empty, add).alias("spans"))


def remove_repeats(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (removed bytes, sorted, apart), kept (binary).

    Every byte inside a string of ``length`` bytes that starts at any other place of any document goes;
    matches never cross documents. A null text is empty; repeated rows repeat each other.
    """
    _, spans = repeated_spans(docs, id_column=id_column, text_column=text_column, length=length)
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    chosen = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.xxhash64(F.col(id_column), text).alias("t_row"), text.alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, kept = [], []
            for value, removed in zip(batch.column(1), batch.column(2)):
                data, at, parts = value.as_py().encode(), 0, []
                sizes.append(len(data))
                for span in removed.as_py() or []:
                    parts.append(data[at:span["start"]])
                    at = span["end"]
                kept.append(b"".join([*parts, data[at:]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), batch.column(2), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"]
            )

    joined = chosen.join(spans, F.col("t_row") == F.col("row"), "left")
    spans_or_none = F.coalesce(F.col("spans"), F.array().cast("array<struct<start: bigint, end: bigint>>"))
    return joined.select("doc_id", "text", spans_or_none.alias("spans")).mapInArrow(
        cut, "doc_id bigint, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary"
    )


def with_digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
