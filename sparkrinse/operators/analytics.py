"""Business figures and descriptive statistics of a table, each a lazy DataFrame.

Every grouped figure is a sum or a count, so Spark combines it inside the map tasks and a category
that holds a third of all rows is no more work than any other.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrinse import schema
from sparkrinse.functions.dates import DATE_FORMATS, month_of, parse_date
from sparkrinse.functions.numbers import to_number
from sparkrinse.operators.duplicates import duplicate_count
from sparkrinse.operators.frequency import top_values
from sparkrinse.operators.quantiles import numeric_summaries
from sparkrinse.operators.semantics import SemanticMapping, detect_semantics

TOP_GROUPS = 10
REPORT_CATEGORICALS = 8


def _number_or_zero(df: DataFrame, name: str) -> Column:
    return F.coalesce(to_number(schema.col(name), schema.type_of(df, name)), F.lit(0.0))


def revenue(df: DataFrame, roles: SemanticMapping) -> Column:
    """Sales column, else price times quantity, else the first numeric column, else 0."""
    if roles.sales:
        return _number_or_zero(df, roles.sales)
    if roles.price and roles.quantity:
        return _number_or_zero(df, roles.price) * _number_or_zero(df, roles.quantity)
    numbers = schema.numeric_columns(df)
    return _number_or_zero(df, numbers[0]) if numbers else F.lit(0.0)


def sales_totals(df: DataFrame, roles: SemanticMapping) -> DataFrame:
    """One row: revenue, average order value, units, orders and customers."""
    money = revenue(df, roles)
    orders = F.count(F.lit(1))
    units = F.sum(_number_or_zero(df, roles.quantity)).cast("bigint") if roles.quantity else orders
    buyers = F.count_distinct(schema.col(roles.customer)) if roles.customer else orders
    return df.agg(
        F.round(F.coalesce(F.sum(money), F.lit(0.0)), 2).alias("total_revenue"),
        F.round(F.coalesce(F.avg(money), F.lit(0.0)), 2).alias("avg_order_value"),
        F.coalesce(units, F.lit(0)).alias("total_quantity"),
        orders.alias("total_orders"),
        buyers.alias("unique_customers"),
    )


def revenue_by(df: DataFrame, roles: SemanticMapping, key: str, top: int | None = None) -> DataFrame:
    """Revenue per value of ``key``, largest first; missing keys form no group."""
    label = schema.col(key).cast("string")
    grouped = (
        df.where(schema.col(key).isNotNull())
        .groupBy(label.alias("label"))
        .agg(F.sum(revenue(df, roles)).alias("total"))
    )
    ordered = grouped.orderBy(F.col("total").desc(), "label")
    if top is not None:
        ordered = ordered.limit(top)
    return ordered.select("label", F.round("total", 2).alias("revenue"))


def value_distribution(df: DataFrame, key: str, top: int = TOP_GROUPS) -> DataFrame:
    """The most frequent values of a column with their counts."""
    label = schema.col(key).cast("string")
    counted = df.where(schema.col(key).isNotNull()).groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.col("n").desc(), "label").limit(top)


def monthly_revenue(df: DataFrame, roles: SemanticMapping, formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """Revenue and orders per calendar month; rows without a readable date are left out."""
    month = month_of(parse_date(schema.col(roles.date), schema.type_of(df, roles.date), formats))
    # The undated group goes after the sums: a filter on the date would be pushed to the rows and read it twice.
    return (
        df.select(month.alias("month"), revenue(df, roles).alias("money"))
        .groupBy("month")
        .agg(F.round(F.sum("money"), 2).alias("revenue"), F.count("month").alias("orders"))
        .where(F.col("orders") > 0)
        .orderBy("month")
    )


def general_kpis(df: DataFrame) -> DataFrame:
    """One row: size, column classes, missing cells, duplicates and density."""
    width = len(df.columns)
    clean = schema.nan_to_null(df)
    empty = F.lit(0)
    for name in df.columns:
        empty = empty + schema.col(name).isNull().cast("int")
    missing = clean.agg(F.coalesce(F.sum(empty), F.lit(0)).alias("n")).first()["n"]
    totals = duplicate_count(clean).select(
        F.col("total_rows").alias("total_records"),
        F.lit(missing).cast("bigint").alias("missing_values"),
        F.col("duplicate_rows").alias("duplicate_records"),
    )
    density = (1 - F.coalesce(F.try_divide(F.col("missing_values"), F.col("total_records") * width), F.lit(0.0))) * 100
    return totals.select(
        "total_records",
        F.lit(width).cast("bigint").alias("total_columns"),
        F.lit(len(schema.numeric_columns(df))).cast("bigint").alias("numeric_columns"),
        F.lit(len(schema.categorical_columns(df))).cast("bigint").alias("categorical_columns"),
        "missing_values",
        "duplicate_records",
        F.round(density, 2).alias("data_density"),
    )


def _corrected_skew(f: Mapping) -> float | None:
    """Bias-corrected skewness: none below three values, 0 for a constant column."""
    n = f["numbers"]
    if n < 3:
        return None
    if f["least"] == f["most"]:
        return 0.0
    return math.sqrt(n * (n - 1)) / (n - 2) * (f["cubes"] / n) / (f["squares"] / n) ** 1.5


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per numeric column: count, mean, std, min, quartiles, max and skew, two decimals."""
    columns = list(columns or schema.numeric_columns(df))
    found = numeric_summaries(df, columns)
    rows = []
    for name in columns:
        f = found.get(name)
        if f is None:
            rows.append((name, 0, *[None] * 8))
            continue
        n = f["numbers"]
        std = math.sqrt(f["squares"] / (n - 1)) if n > 1 else None
        rows.append((name, n, f["mean"], std, f["least"], *f["quartiles"], f["most"], _corrected_skew(f)))
    figures = ("mean", "std", "min", "q25", "q50", "q75", "max", "skew")
    shape = "column_name STRING, count BIGINT, " + ", ".join(f"{c} DOUBLE" for c in figures)
    return df.sparkSession.createDataFrame(rows, shape).withColumns({c: F.round(c, 2) for c in figures})


def categorical_distributions(
    df: DataFrame, columns: Sequence[str] | None = None, top: int = TOP_GROUPS
) -> DataFrame:
    """Top values, missing included, of the categorical columns, with their share of rows."""
    if columns is None:
        columns = schema.categorical_columns(df)
    rows = df.count()
    return top_values(df, columns, top, keep_missing=True).withColumn(
        "percentage", F.round(F.col("n") * 100.0 / F.lit(rows), 1)
    )


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson r of every ordered pair over complete pairs; NULL when a side is constant.

    One scan. A task sums the products of all columns about the first values it meets and hands on counts,
    means and co-moments, a few numbers per pair; those of all tasks are merged about the common means,
    so values far from zero lose nothing.
    """
    columns = list(columns or schema.numeric_columns(df))
    width = len(columns)
    raw = df.select(*[to_number(schema.col(c), schema.type_of(df, c)).alias(f"x{i}") for i, c in enumerate(columns)])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, origin = np.zeros((5, width, width)), np.full(width, np.nan)
        lows, highs = np.full((width, width), np.inf), np.full((width, width), -np.inf)
        for batch in batches:
            values = np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns])
            given = ~np.isnan(values)
            for j in np.flatnonzero(np.isnan(origin) & given.any(axis=0)):
                finite = values[np.isfinite(values[:, j]), j]
                origin[j] = finite.mean() if len(finite) else 0.0
            x, m = np.where(given, values - np.where(np.isnan(origin), 0.0, origin), 0.0), given.astype(np.float64)
            sums += (m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, x.T @ x)
            for j in range(width):  # what the others span where column j has a value
                rows = given[:, j]
                if rows.any():
                    lows[:, j] = np.minimum(lows[:, j], np.where(given[rows], values[rows], np.inf).min(axis=0))
                    highs[:, j] = np.maximum(highs[:, j], np.where(given[rows], values[rows], -np.inf).max(axis=0))
        if not sums[0].any():
            return
        n, sx, sy, sxx, sxy = sums
        with np.errstate(invalid="ignore", divide="ignore"):
            start = np.where(np.isnan(origin), 0.0, origin)
            moments = (sx / n + start[:, None], sy / n + start[None, :], sxx - sx * sx / n, sxy - sx * sy / n)
        kept = n.ravel() > 0
        at = np.indices((width, width)).reshape(2, -1)
        columns_out = [*at.astype(np.int32), n.ravel(), *[x.ravel() for x in (*moments, lows, highs)]]
        yield pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in columns_out], ["i", "j", "n", "x", "y", "xx", "xy", "low", "high"])

    parts = raw.mapInArrow(products, "i INT, j INT, " + ", ".join(f"{c} DOUBLE" for c in ("n", "x", "y", "xx", "xy", "low", "high")))
    # One row per task and pair; the common means come first.
    pair = Window.partitionBy("i", "j")
    means = {f"mean_{c}": F.sum(F.col("n") * F.col(c)).over(pair) / F.sum("n").over(pair) for c in ("x", "y")}
    gap_x, gap_y = F.col("x") - F.col("mean_x"), F.col("y") - F.col("mean_y")
    total = parts.withColumns(means).groupBy("i", "j").agg(
        F.sum(F.col("xx") + F.col("n") * gap_x * gap_x).alias("xx"), F.sum(F.col("xy") + F.col("n") * gap_x * gap_y).alias("xy"),
        F.min("low").alias("low"), F.max("high").alias("high"),
    )
    every = df.sparkSession.createDataFrame([(i, j) for i in range(width) for j in range(width)], "i INT, j INT")
    other = total.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("xx").alias("yy"), (F.col("low") < F.col("high")).alias("other_varies"))
    both = every.join(total.join(other, ["i", "j"]), ["i", "j"], "left")
    spread = F.sqrt("xx") * F.sqrt("yy")
    varies = (F.col("low") < F.col("high")) & F.col("other_varies")
    names = F.array(*[F.lit(c) for c in columns])
    r = F.try_divide(F.col("xy"), F.when(varies, spread))
    return both.select(F.get(names, F.col("i")).alias("col_x"), F.get(names, F.col("j")).alias("col_y"), F.round(r, 2).alias("r"))


def grouped_insight(df: DataFrame, category: str, number: str, top: int = TOP_GROUPS) -> DataFrame:
    """Count, mean and sum of a number per category, largest sums first."""
    x = to_number(schema.col(number), schema.type_of(df, number))
    grouped = (
        df.where(schema.col(category).isNotNull())
        .groupBy(schema.col(category).cast("string").alias("label"))
        .agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.coalesce(F.sum(x), F.lit(0.0)).alias("sum"))
    )
    first = grouped.orderBy(F.round("sum", 2).desc(), "label").limit(top)
    return first.select("label", "count", F.round("mean", 2).alias("mean"), F.round("sum", 2).alias("sum"))


@dataclass
class AnalyticsReport:
    is_sales_domain: bool
    semantics: SemanticMapping
    general_kpis: DataFrame
    sales: dict[str, DataFrame] = field(default_factory=dict)
    generic: dict[str, DataFrame] = field(default_factory=dict)

    def tables(self) -> dict[str, DataFrame]:
        return {"general_kpis": self.general_kpis, **self.sales, **self.generic}


def analyze_dataset(
    df: DataFrame, overrides: Mapping[str, str | None] | None = None, formats: Sequence[str] = DATE_FORMATS
) -> AnalyticsReport:
    """The figures that suit the table: sales figures for a sales table, statistics for any.

    ``formats`` are the spellings of dates to look for; a cleaned table has one.
    """
    roles = detect_semantics(df.columns, overrides)
    numbers = schema.numeric_columns(df)
    categories = schema.categorical_columns(df)
    report = AnalyticsReport(roles.is_sales_dataset, roles, general_kpis(df))
    if report.is_sales_domain:
        report.sales["sales_totals"] = sales_totals(df, roles)
        for name, key, top in (
            ("revenue_by_category", roles.category, None),
            ("revenue_by_region", roles.region, None),
            ("top_products", roles.product, TOP_GROUPS),
        ):
            if key:
                report.sales[name] = revenue_by(df, roles, key, top)
        for name, key in (("payment_distribution", roles.payment), ("status_distribution", roles.status)):
            if key:
                report.sales[name] = value_distribution(df, key)
        if roles.date:
            report.sales["monthly_revenue"] = monthly_revenue(df, roles, formats)
    if numbers:
        report.generic["statistics"] = describe(df, numbers)
    if categories:
        report.generic["categorical_distributions"] = categorical_distributions(df, categories[:REPORT_CATEGORICALS])
    if len(numbers) >= 2:
        report.generic["correlations"] = correlations(df, numbers)
    if numbers and categories:
        report.generic["grouped_insight"] = grouped_insight(df, categories[0], numbers[0])
    return report
