"""Records of delimited text whose quoted values span lines, cut out of byte ranges side by side.

Whether a line starts a record depends on how many quotes stand before it in its file. One scan tells
whether a byte range has an odd number of them; the running sum over the ranges of a file, a few numbers
each, says in which state a range begins. Then every range cuts its lines into records on its own. Only
what a range starts with inside a value, and what it leaves open, is joined to its neighbours' pieces.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkrinse.staging import stage

PIECES = "file string, block bigint, number bigint, whole boolean, opens boolean, record binary"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    place = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(place["file_path"].alias("file"), place["file_block_start"].alias("block"), F.col("value").cast("binary").alias("line"))


def _starting_states(lines: DataFrame) -> DataFrame:
    """``file, block, inside``: whether a byte range begins inside a quoted value. One row per range."""
    text = F.col("line").cast("string")
    quotes = F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))
    ranges = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.select("file", "block", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in order, with the state their range begins in, to records and pieces of records."""
    here, number, open_lines, begun, inside = None, 0, [], False, False

    def piece(lines: list[bytes], whole: bool, opens: bool) -> tuple:
        return (*here, number, whole, opens, b"\n".join(lines))

    def rows(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary())
        names = ["file", "block", "number", "whole", "opens", "record"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names)

    for batch in batches:
        found: list[tuple] = []
        odd = (pc.count_substring(batch.column(2), pattern='"').to_numpy(zero_copy_only=False) % 2).astype(bool)
        for file, block, line, starts_inside, flips in zip(*[c.to_pylist() for c in batch.columns], odd.tolist()):
            if here != (file, block):
                if here and open_lines:
                    found.append(piece(open_lines, False, begun))
                here, number, open_lines, begun, inside = (file, block), 0, [], not starts_inside, starts_inside
            open_lines.append(line)
            inside ^= flips
            if not inside:
                found.append(piece(open_lines, begun, False))
                number, open_lines, begun = number + 1, [], True
        if found:
            yield rows(found)
    if here and open_lines:
        yield rows([piece(open_lines, False, begun)])


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, number, record`` (bytes): a record per row, in the order of block and number within its file."""
    lines = _lines(spark, path)
    states = stage(_starting_states(lines), "range-states")
    # One row per byte range of the input, a few dozen bytes each.
    told = lines.join(F.broadcast(states), ["file", "block"], "left").select(
        "file", "block", "line", F.coalesce("inside", F.raise_error(F.lit("the byte ranges of a file have changed")).cast("boolean")).alias("inside")
    )
    pieces = stage(told.mapInArrow(_cut, PIECES), "quoted-records")
    # A piece that opens a record starts a group; those without a beginning in their range belong to the last one.
    order = Window.partitionBy("file").orderBy("block", "number")
    parts = pieces.where("not whole").withColumn("group", F.sum(F.col("opens").cast("int")).over(order))
    joined = parts.groupBy("file", "group").agg(
        F.min(F.struct("block", "number")).alias("at"),
        F.array_sort(F.collect_list(F.struct("block", "number", "record"))).alias("pieces"),
    )
    record = F.aggregate(
        "pieces", F.lit(None).cast("binary"),
        lambda s, p: F.when(s.isNull(), p["record"]).otherwise(F.concat(s, F.lit(b"\n"), p["record"])),
    )
    whole = pieces.where("whole").select("file", "block", "number", "record")
    return whole.unionByName(joined.select("file", "at.block", "at.number", record.alias("record")))


def well_quoted(record: Column, sep: str) -> Column:
    """Whether quotes stand only around whole values, so that counting them tells where a value ends."""
    s = "".join(f"\\x{b:02x}" for b in sep.encode("latin-1"))
    value = f'(?:\\s*+"[^"]*+(?:""[^"]*+)*+"\\s*+|[^"{s}]*+)'
    return record.rlike(f"(?s)^{value}(?:{s}{value})*+$")
