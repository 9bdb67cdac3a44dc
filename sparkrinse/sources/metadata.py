"""What is known about a loaded table as a whole."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrinse.functions.display import show_bytes
from sparkrinse.operators.analytics import general_kpis
from sparkrinse.sources.readers import stored_bytes


def dataset_metadata(
    df: DataFrame,
    path: str | None = None,
    encoding: str | None = None,
    delimiter: str | None = None,
) -> DataFrame:
    """One row: file, size, rows, columns, missing cells, duplicates and what the reader detected."""
    counts = general_kpis(df).select(
        F.col("total_records").alias("row_count"),
        F.col("total_columns").alias("column_count"),
        (F.col("missing_values") > 0).alias("has_empty_cells"),
        F.col("missing_values").alias("missing_cells_total"),
        F.col("duplicate_records").alias("duplicate_rows_total"),
        F.lit(",".join(df.columns)).alias("columns"),
        F.lit(encoding).cast("string").alias("encoding"),
        F.lit(delimiter).cast("string").alias("delimiter"),
    )
    stored = stored_bytes(df.sparkSession, path).first() if path else None
    size = F.lit(stored["file_size_bytes"] if stored else None).cast("bigint")
    return counts.select(
        F.lit(stored["file_name"] if stored else None).cast("string").alias("file_name"),
        size.alias("file_size_bytes"),
        show_bytes(size).alias("file_size"),
        "*",
    )
