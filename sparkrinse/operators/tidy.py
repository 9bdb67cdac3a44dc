"""One fused aggregation over many columns, reshaped to one row per column."""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# An aggregation over hundreds of expressions outgrows code generation. Small batches of columns
# compile well, run side by side in one job, and each reads only its own columns of a columnar
# source, which is thus still read once in total.
COLUMNS_PER_PASS = 12
# Batches beyond this many go to a further job.
PASSES_PER_JOB = 16

Measures = Callable[[str], Mapping[str, Column]]


def batches(items: Sequence, size: int) -> list[Sequence]:
    return [items[i : i + size] for i in range(0, len(items), size)]


def rows_per_column(df: DataFrame, columns: Sequence[str], measures: Measures) -> DataFrame:
    """``column_name`` plus the measures of each column, the same ones for every column."""
    frames = []
    for batch in batches(columns, COLUMNS_PER_PASS):
        measured = [(name, measures(name)) for name in batch]
        totals = df.agg(
            *[m.alias(f"{i}_{label}") for i, (_, ms) in enumerate(measured) for label, m in ms.items()]
        )
        entries = [
            F.struct(F.lit(name).alias("column_name"), *[F.col(f"{i}_{label}").alias(label) for label in ms])
            for i, (name, ms) in enumerate(measured)
        ]
        frames.append(totals.select(F.inline(F.array(*entries))))
    return reduce(DataFrame.unionByName, frames)


def _slots(totals: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """A one-row frame as rows ``column_name, label, whole, number, text``, each value in its slot."""
    entries = []
    for field, (name, label) in zip(totals.schema.fields, keys):
        value = F.col(field.name)
        number = isinstance(field.dataType, (T.DoubleType, T.FloatType))
        text = isinstance(field.dataType, T.StringType)
        entries.append(
            F.struct(
                F.lit(name).alias("column_name"),
                F.lit(label).alias("label"),
                (F.lit(None) if number or text else value).cast("bigint").alias("whole"),
                (value if number else F.lit(None)).cast("double").alias("number"),
                (value if text else F.lit(None)).cast("string").alias("text"),
            )
        )
    return totals.select(F.inline(F.array(*entries)))


def measure_columns(df: DataFrame, columns: Sequence[str], measures: Measures) -> dict[str, dict]:
    """Measurements, possibly different per column, brought to the driver: a few numbers each.

    Measures are whole numbers, DOUBLE or text; a boolean comes back as 0 or 1.
    """
    measured = {name: measures(name) for name in columns}
    found: dict[str, dict] = {name: {} for name in columns}
    busy = [name for name in columns if measured[name]]
    for group in batches(batches(busy, COLUMNS_PER_PASS), PASSES_PER_JOB):
        frames = []
        for batch in group:
            keys = [(name, label) for name in batch for label in measured[name]]
            totals = df.agg(*[measured[name][label].alias(f"m{i}") for i, (name, label) in enumerate(keys)])
            frames.append(_slots(totals, keys))
        for line in reduce(DataFrame.unionByName, frames).collect():
            value = next((line[s] for s in ("whole", "number", "text") if line[s] is not None), None)
            found[line["column_name"]][line["label"]] = value
    return found


def metric_rows(df: DataFrame, metrics: Mapping[str, Column], label: str = "metric", value: str = "value") -> DataFrame:
    """Turn a one-row frame into one row per metric, numbered in the order given."""
    entries = [
        F.struct(F.lit(i).alias("position"), F.lit(name).alias(label), column.alias(value))
        for i, (name, column) in enumerate(metrics.items(), start=1)
    ]
    return df.select(F.inline(F.array(*entries)))
