"""Connected components by contraction, for links that stay distributed."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrinse.staging import stage


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) for every node that has a link.

    Each round every node joins its smallest neighbour if that is smaller, the links are drawn between
    what the nodes joined, and links within one node go. A star of any size is done in one round.
    Nulls link nothing; repeated links count once.
    """
    pair = links.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a is not null and b is not null")
    both = stage(pair.filter("a != b").unionByName(pair.filter("a != b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    found = None
    while True:
        joined = stage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), "joined")
        if joined.isEmpty():
            break
        found = joined.withColumnRenamed("a", "node") if found is None else stage(
            found.join(joined.withColumnRenamed("to", "further"), F.col("to") == F.col("a"), "left")
            .select("node", F.coalesce("further", "to").alias("to")), "found")
        moved = (
            both.join(joined, "a").select(F.col("to").alias("__a"), "b")
            .join(joined.select(F.col("a").alias("b"), F.col("to").alias("__b")), "b")
            .select(F.col("__a").alias("a"), F.col("__b").alias("b")).filter("a != b")
        )
        both = stage(moved.distinct(), "links")
    if found is None:
        found = joined.withColumnRenamed("a", "node")
    return found.withColumnRenamed("to", "component")
