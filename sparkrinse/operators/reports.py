"""Report tables: small frames built from profiles, audit rows and figures."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrinse import schema
from sparkrinse.functions.display import show_count, show_currency, show_number
from sparkrinse.operators.profile import DatasetProfile
from sparkrinse.operators.tidy import metric_rows

EXTRACT_ROWS = 10_000
PREVIEW_ROWS = 15
AUDIT_ROWS = 15
# Lengths to which the printed report cuts its texts.
DESCRIPTION_LENGTH, ISSUES_LENGTH = 100, 120
# Labels and meanings of the business figures.
BUSINESS_METRICS = (
    ("Total Gross Revenue", "total_revenue", "Total monetized throughput across valid orders"),
    ("Average Order Value (AOV)", "avg_order_value", "Mean commercial spend per customer order"),
    ("Total Quantity Sold", "total_quantity", "Aggregated units distributed across all transactions"),
    ("Total Orders Processed", "total_orders", "Net verified purchasing records post-cleaning"),
    ("Unique Customers", "unique_customers", "Distinct individual clients identified in pipeline"),
)


def before_after(raw: DatasetProfile, clean: DatasetProfile) -> DataFrame:
    """Six metrics before and after cleaning with the net change, as shown to a reader."""
    gain = round(clean.quality.overall_score - raw.quality.overall_score, 1)

    def missing(p: DatasetProfile) -> str:
        return f"{p.total_missing_cells:,} ({p.missing_cells_pct}%)"

    rows = [
        ("Data Quality Score", f"{raw.quality.overall_score}%", f"{clean.quality.overall_score}%", f"{gain:+}%"),
        (
            "Total Rows", f"{raw.total_rows:,}", f"{clean.total_rows:,}",
            f"-{raw.total_rows - clean.total_rows:,} duplicates removed",
        ),
        ("Total Columns", str(raw.total_columns), str(clean.total_columns), "Maintained"),
        (
            "Missing Cells", missing(raw), missing(clean),
            f"{raw.total_missing_cells - clean.total_missing_cells:,} imputed",
        ),
        (
            "Duplicate Records", f"{raw.total_duplicate_rows:,}", f"{clean.total_duplicate_rows:,}",
            f"{raw.total_duplicate_rows - clean.total_duplicate_rows:,} dropped",
        ),
        ("Quality Assessment Grade", raw.quality.grade, clean.quality.grade, "Optimized"),
    ]
    numbered = [(i, *row) for i, row in enumerate(rows, start=1)]
    return raw.spark.createDataFrame(
        numbered, "position INT, metric STRING, raw_input STRING, cleaned_output STRING, net_change STRING"
    )


def column_diagnostics(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Raw column profiles with what is still missing after cleaning.

    Both sides are column profiles, one row per column of the table.
    """
    after = clean.select("column_name", F.col("null_count").alias("cleaned_missing"))
    issues = F.when(F.size("quality_issues") > 0, F.array_join("quality_issues", "; ")).otherwise("Clean")
    return raw.join(after, "column_name", "left").select(
        "position",
        "column_name",
        "inferred_type",
        F.col("null_count").alias("raw_missing"),
        F.col("null_percentage").alias("raw_missing_pct"),
        F.coalesce("cleaned_missing", F.lit(0)).alias("cleaned_missing"),
        "unique_count",
        issues.alias("issues"),
    )


def printed_diagnostics(raw: DataFrame) -> DataFrame:
    """The shorter column table of the printed report."""
    issues = F.when(F.size("quality_issues") > 0, F.array_join("quality_issues", "; ")).otherwise("Fully valid")
    return raw.select(
        "position",
        "column_name",
        "inferred_type",
        F.concat(F.col("null_count").cast("string"), F.lit(" ("), F.col("null_percentage"), F.lit("%)")).alias("missing"),
        "unique_count",
        F.left(issues, F.lit(ISSUES_LENGTH)).alias("issues"),
    )


def data_extract(cleaned: DataFrame, order_by: Sequence[str | Column], rows: int = EXTRACT_ROWS) -> DataFrame:
    """The first rows of the cleaned table in the given order; the whole table goes to its own sink."""
    order = [schema.col(o) if isinstance(o, str) else o for o in order_by]
    return cleaned.orderBy(*order).limit(rows)


def preview(df: DataFrame, rows: int = PREVIEW_ROWS, order_by: Sequence[str | Column] | None = None) -> DataFrame:
    """The first rows in the given order, or else as they are stored: by file, then by place in the file.

    Stored order is known for Parquet tables only. Every task keeps ``rows`` rows, nothing is sorted whole.
    """
    if order_by is not None:
        return data_extract(df, order_by, rows)
    place = ["__file", "__row"]
    try:
        placed = df.select("*", F.col("_metadata.file_path").alias(place[0]), F.col("_metadata.row_index").alias(place[1]))
    except AnalysisException as error:
        raise ValueError("rows of this table have no stored order; name the columns to order by") from error
    return placed.orderBy(*place).limit(rows).drop(*place)


def printed_audit(audit: DataFrame, rows: int = AUDIT_ROWS) -> DataFrame:
    """The first audit rows with shortened descriptions."""
    return audit.orderBy("step").limit(rows).withColumn(
        "description", F.left("description", F.lit(DESCRIPTION_LENGTH))
    )


def business_kpis(totals: DataFrame) -> DataFrame:
    """Sales totals as labelled, formatted figures with their meaning."""
    shown = {
        "total_revenue": show_currency(F.col("total_revenue")),
        "avg_order_value": show_currency(F.col("avg_order_value")),
        "total_quantity": show_number(F.col("total_quantity")),
        "total_orders": show_count(F.col("total_orders")),
        "unique_customers": show_count(F.col("unique_customers")),
    }
    rows = metric_rows(totals, {label: shown[name] for label, name, _ in BUSINESS_METRICS})
    meaning = F.create_map(*[F.lit(t) for label, _, text in BUSINESS_METRICS for t in (label, text)])
    return rows.withColumn("significance", F.element_at(meaning, F.col("metric")))
