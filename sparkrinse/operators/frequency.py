"""How often does each value occur? The table of distinct values behind profiles and cleaning.

A per-value question (is it a date, an e-mail, a number, oddly spaced?) is answered once per
distinct value and weighted by its count instead of once per row. The map-side partial count
collapses repeated values before the shuffle, so a value that fills a third of the table costs one
record per task.
"""
from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkrinse import schema
from sparkrinse.functions.numbers import to_number
from sparkrinse.functions.text import fold
from sparkrinse.operators.tidy import batches
from sparkrinse.staging import stage

# Values that a summary of frequent values tracks per column and task, and the longest text it keeps.
TRACKED, KEPT_CHARACTERS = 10_000, 256
# Beyond its capacity such a summary misses at most this share of all rows per value.
MISSED = 3.5 / 16_384
# Groups into which the values of a column are dealt to find the outermost ones.
GROUPS = 64
_TOO_LONG = "\0"
SUMMARIES_PER_PASS = 3


def comparable(df: DataFrame, name: str) -> Column:
    """NaN is missing and -0.0 equals 0.0."""
    value = schema.null_if_nan(df, name)
    data_type = schema.type_of(df, name)
    if schema.is_float(data_type):
        value = value + F.lit(0).cast(data_type)
    return value


def _family(data_type: T.DataType) -> str:
    """Columns that can share one value column without changing what their values are."""
    if isinstance(data_type, T.IntegralType):
        return "bigint"
    if schema.is_float(data_type):
        return "double"
    if schema.is_text(data_type) or schema.is_boolean(data_type):
        return "string"
    return data_type.simpleString()


def value_frequencies(
    df: DataFrame, columns: Sequence[str], keep_missing: bool = False, weight: str | None = None
) -> DataFrame:
    """``column_name, whole, number, text, n``: each distinct value in the slot of its type.

    Columns of one type are unpivoted and grouped together, one shuffle per type. Decimals fill
    ``number`` as well as ``text``; dates and booleans are texts. ``weight`` names a column to sum
    as ``weighted``.
    """
    families: dict[str, list[str]] = defaultdict(list)
    for name in columns:
        families[_family(schema.type_of(df, name))].append(name)
    kept = [F.lit(1).alias("__weight") if weight is None else schema.col(weight).alias("__weight")]
    frames = []
    for family, members in families.items():
        typed = df.select(*[comparable(df, c).cast(family).alias(c) for c in members], *kept)
        long = typed.unpivot(["__weight"], [schema.col(c) for c in members], "column_name", "value")
        if not keep_missing:
            long = long.where(F.col("value").isNotNull())
        value, none = F.col("value"), F.lit(None)
        whole, decimal = family == "bigint", family.startswith("decimal")
        grouped = long.groupBy("column_name", "value").agg(
            F.count(F.lit(1)).alias("n"), *([F.sum("__weight").alias("weighted")] if weight else [])
        )
        frames.append(
            grouped.select(
                "column_name",
                (value if whole else none).cast("bigint").alias("whole"),
                (value if family == "double" or decimal else none).cast("double").alias("number"),
                (none if whole or family == "double" else value).cast("string").alias("text"),
                "n",
                *(["weighted"] if weight else []),
            )
        )
    return reduce(DataFrame.unionByName, frames)


def shown_value() -> Column:
    """A value of the table as text."""
    return F.coalesce("text", F.col("number").cast("string"), F.col("whole").cast("string"))


def numeric_value() -> Column:
    """A value of the table as DOUBLE, NULL when it spells no number."""
    return F.coalesce("number", F.col("whole").cast("double"), to_number(F.col("text"), T.StringType()))


def distinct_counts(freq: DataFrame) -> DataFrame:
    """Distinct values of each column, exactly and with case and surrounding blanks ignored.

    ``column_name, distinct_count, folded_count, non_null_count``; only texts fold.
    """
    spellings = freq.groupBy("column_name", fold(F.col("text")).alias("folded")).agg(
        F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("n")
    )
    return spellings.groupBy("column_name").agg(
        F.sum("spellings").alias("distinct_count"),
        F.count(F.lit(1)).alias("folded_count"),
        F.sum("n").alias("non_null_count"),
    )


def first_values(freq: DataFrame, k: int, by_count: bool = True) -> DataFrame:
    """``column_name, rank, value, n`` of the ``k`` most frequent values, or of the ``k`` smallest.

    Ties in frequency are broken by the value. Spark applies the limit inside every task before the
    shuffle (window group limit), so a column of very many values sends ``k`` rows per task.
    """
    order = [F.col(slot).asc_nulls_first() for slot in ("whole", "number", "text")]
    if by_count:
        order.insert(0, F.col("n").desc())
    place = F.row_number().over(Window.partitionBy("column_name").orderBy(*order))
    ranked = freq.withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.select("column_name", "rank", shown_value().alias("value"), "n")


def outermost(freq: DataFrame, k: int) -> DataFrame:
    """The rows of the table of values that ``first_values`` may choose for ``k``; of numbers not many more.

    The values of a column are dealt into groups. No value rarer than the k-th of the groups' largest counts
    is among the ``k`` most frequent, no number beyond the k-th of their least numbers among the ``k`` smallest.
    Where all values are that frequent, the smallest ones stand before the others. So only a rest is sorted.
    """
    group = F.pmod(F.xxhash64("whole", "number", "text"), F.lit(GROUPS))
    found = freq.groupBy("column_name", group.alias("group")).agg(
        F.min("n").alias("rarest"), F.max("n").alias("n"), F.min("whole").alias("whole"), F.min("number").alias("number")
    )
    limits = found.groupBy("column_name").agg(
        F.min("rarest").alias("rarest"),
        *[F.get(F.sort_array(F.collect_list(c), asc=c != "n"), k - 1).alias(f"k_{c}") for c in ("n", "whole", "number")],
    ).select("column_name", F.when(F.col("k_n") == F.col("rarest"), F.col("k_n") + 1).otherwise(F.col("k_n")).alias("k_n"), "k_whole", "k_number")
    few = freq.sparkSession.createDataFrame(limits.collect(), limits.schema)
    beyond = F.coalesce(F.col("whole") > F.col("k_whole"), F.col("number") > F.col("k_number"), F.lit(False))
    return freq.join(F.broadcast(few), "column_name").where(~beyond | (F.col("n") >= F.coalesce("k_n", F.lit(0)))).select(*freq.columns)


def top_values(df: DataFrame, columns: Sequence[str], k: int, keep_missing: bool = False) -> DataFrame:
    """The same as ``first_values`` of ``value_frequencies``, exactly, without a shuffle of all values.

    One scan makes a mergeable summary of frequent values per column. It is exact for a column of up to
    about ten thousand values. Of other columns it names candidates, which a second scan counts; they are
    the answer if the last of them occurs more often than any value that the summary may have missed.
    Only columns where that cannot be shown count all their values.
    """
    # Decimals are ordered by number and shown as text, so they are counted as they are.
    exact = [c for c in columns if _family(schema.type_of(df, c)).startswith("decimal")]
    slots = {c: _slot(_family(schema.type_of(df, c))) for c in columns if c not in exact}
    found_in, total = _summaries(df, slots), 0
    sure, open_, rest = [], {}, exact
    for c, slot in slots.items():
        total, found = found_in[c]
        cut = slot == "text" and any(x is not None and x.startswith(_TOO_LONG) for x, _ in found)
        if sum(n for _, n in found) == total and len(found) < TRACKED and not cut:
            wanted = sorted((x for x in found if keep_missing or x[0] is not None), key=lambda x: (-x[1], x[0] is not None, x[0]))
            sure += [(c, slot, *x) for x in wanted[:k]]
        # A summary never counts too few, so what it has not seen often enough needs no second look.
        elif len(found) >= k and found[k - 1][1] > 2 * MISSED * total and not cut:
            open_[c] = [x for x, _ in found if keep_missing or x is not None]
        else:
            rest.append(c)

    def named(values: list[tuple]) -> DataFrame:
        """Rows of the table of values from column, slot, value and count."""
        rows = [(c, *[v if slot == s else None for s in _SLOTS], n) for c, slot, v, n in values]
        return df.sparkSession.createDataFrame(rows, "column_name STRING, " + ", ".join(f"{s} {t}" for s, t in _SLOTS.items()) + ", n BIGINT")

    parts = [named(sure)]
    if open_:
        names = named([(c, slots[c], x, 0) for c, values in open_.items() for x in values])
        counted = stage(_counted_only(df, slots, list(open_), names), "candidate-values")
        last = {
            line["column_name"]: (line["n"], line["values"])
            for line in first_values(counted, k).groupBy("column_name").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("values")).collect()
        }
        shown = [c for c in open_ if last.get(c, (0, 0))[1] == k and last[c][0] > 2 * MISSED * total]
        rest += [c for c in open_ if c not in shown]
        parts.append(counted.where(F.col("column_name").isin(*shown)))
    top = first_values(reduce(DataFrame.unionByName, parts), k)
    if rest:  # values beyond number are grouped in tasks of bounded size; a few rows are stored
        top = top.unionByName(stage(first_values(value_frequencies(df, rest, keep_missing), k), "top-values", small_tasks=True))
    return top


def _summaries(df: DataFrame, slots: dict[str, str]) -> dict[str, tuple[int, list]]:
    """Rows, and the tracked values with their counts, of each column: TRACKED of them at most, and short ones.

    Batches of columns run side by side in one job, each reads only its own columns.
    """
    frames = []
    for batch in batches(list(enumerate(slots)), SUMMARIES_PER_PASS):
        tracked = df.select(*[_summarised(df, c).alias(f"v{i}") for i, c in batch]).agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.call_function("approx_top_k", F.col(f"v{i}"), F.lit(TRACKED), F.lit(TRACKED)).alias(f"v{i}") for i, _ in batch],
        )
        entries = [F.struct(F.lit(i).alias("i"), F.col("rows"), F.transform(f"v{i}", _slotted(slots[c])).alias("found")) for i, c in batch]
        frames.append(tracked.select(F.inline(F.array(*entries))))
    names, out = list(slots), {}
    for line in reduce(DataFrame.unionByName, frames).collect() if frames else []:
        c = names[line["i"]]
        out[c] = (line["rows"], [(x[slots[c]], x["n"]) for x in line["found"] or []])
    return out


def _slotted(slot: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(*[(x["item"] if s == slot else F.lit(None)).cast(t).alias(s) for s, t in _SLOTS.items()], x["count"].alias("n"))


def _summarised(df: DataFrame, name: str) -> Column:
    """The value as its family; a text too long to be tracked as a short stand-in."""
    value = comparable(df, name).cast(_family(schema.type_of(df, name)))
    if not schema.is_text(schema.type_of(df, name)):
        return value
    return F.when(F.length(value) > KEPT_CHARACTERS, F.concat(F.lit(_TOO_LONG), F.md5(value))).otherwise(value)


# The slots of the table of values.
_SLOTS = {"whole": "bigint", "number": "double", "text": "string"}


def _slot(family: str) -> str:
    return "whole" if family == "bigint" else "number" if family == "double" else "text"


def _counted_only(df: DataFrame, slots: dict[str, str], columns: Sequence[str], names: DataFrame) -> DataFrame:
    """``value_frequencies`` of some columns, only for the values named: some thousand per column."""
    frames = []
    for name in columns:
        family, slot = _family(schema.type_of(df, name)), slots[name]
        wanted = names.where(F.col("column_name") == F.lit(name)).select(F.col(slot).alias("value"))
        rows = df.select(comparable(df, name).cast(family).cast(_SLOTS[slot]).alias("value"))
        counts = rows.join(F.broadcast(wanted), rows["value"].eqNullSafe(wanted["value"]), "left_semi").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
        frames.append(counts.select(F.lit(name).alias("column_name"), *[(F.col("value") if s == slot else F.lit(None)).cast(t).alias(s) for s, t in _SLOTS.items()], "n"))
    return reduce(DataFrame.unionByName, frames)


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_name, mode, n``: the most frequent value, the smallest among equals, as text."""
    best = top_values(df, columns, 1)
    return best.select("column_name", F.col("value").alias("mode"), "n")
