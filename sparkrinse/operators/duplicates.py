"""Duplicate rows. Missing values equal each other, as in Spark's own grouping."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkrinse import schema
from sparkrinse.staging import discard, stage

COPIES = "__copies"
_HASH = "__hash"
# Hashes held by several rows are broadcast up to this number, 64 MB of them.
BROADCAST = 8_000_000


def collapse_duplicates(df: DataFrame) -> DataFrame:
    """Each distinct row once, with the number of its copies.

    Copies merge in the map-side partial count, so a row repeated in a third of the table reaches
    the shuffle once per task.
    """
    return df.groupBy(*[schema.col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias(COPIES))


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Keep one of each set of identical rows; which one cannot be told apart."""
    return df.distinct()


def duplicate_count(df: DataFrame) -> DataFrame:
    """``total_rows, distinct_rows, duplicate_rows``, exact.

    Rows are first grouped by a 64-bit hash, which shuffles a few bytes per row instead of whole
    rows. A row whose hash occurs once has no copy; only rows that share a hash are compared in full.
    The shared hashes are stored, so their true number decides how they are joined; without any the rows are
    read once.
    """
    # maps cannot be hashed; leaving them out only makes the first test coarser
    hashed = F.xxhash64(*[schema.col(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()])
    grouped = stage(
        df.select(hashed.alias(_HASH)).groupBy(_HASH).agg(F.count(F.lit(1)).alias(COPIES)).groupBy(
            F.when(F.col(COPIES) > 1, F.col(_HASH)).alias(_HASH)
        ).agg(F.sum(COPIES).alias(COPIES)),
        "shared-hashes",
    )
    facts = grouped.agg(F.coalesce(F.sum(COPIES), F.lit(0)).alias("rows"), F.count(_HASH).alias("shared")).first()
    total, extra = facts["rows"], 0
    if facts["shared"]:
        shared = grouped.where(F.col(_HASH).isNotNull()).select(_HASH)
        if facts["shared"] <= BROADCAST:  # else all rows are shuffled whole to find a few
            shared = F.broadcast(shared)
        rows = df.withColumn(_HASH, hashed).join(shared, _HASH, "left_semi").drop(_HASH)
        extra = collapse_duplicates(rows).agg(F.sum(F.col(COPIES) - 1).alias("n")).first()["n"]
    discard(grouped)
    return df.sparkSession.createDataFrame(
        [(total, total - extra, extra)], "total_rows BIGINT, distinct_rows BIGINT, duplicate_rows BIGINT"
    )



def dedupe_by_key(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[Column | str], keep: str = "first"
) -> DataFrame:
    """The first or last row of each key in the given order, which should leave no ties.

    The ``= 1`` filter becomes a window group limit: every task forwards one row per key, so a hot
    key does not gather its rows anywhere.
    """
    if keep not in ("first", "last"):
        raise ValueError("keep must be 'first' or 'last'")
    order = [schema.col(o) if isinstance(o, str) else o for o in order_by]
    if keep == "last":
        order = [o.desc_nulls_last() for o in order]
    ranked = Window.partitionBy(*[schema.col(k) for k in keys]).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(ranked)).where(F.col("__rank") == 1).drop("__rank")
