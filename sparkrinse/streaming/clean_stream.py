"""Run a fitted cleaning plan over rows as they arrive.

A plan is a projection of constants, so it needs no state and no watermark; whole-table steps such
as removing duplicates belong to the batch run that fitted it.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sparkrinse.plans.cleaning import CleaningPlan


def clean_stream(
    rows: DataFrame, plan: CleaningPlan, path: str, checkpoint: str, fmt: str = "parquet", once: bool = True
) -> StreamingQuery:
    """Append cleaned rows to a file sink; ``once`` drains what is there and stops."""
    writer = plan.apply(rows).writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)
