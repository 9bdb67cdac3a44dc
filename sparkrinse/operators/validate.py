"""Whole-table checks of e-mail, date and numeric columns."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrinse import schema
from sparkrinse.functions.dates import DATE_FORMATS, parse_date
from sparkrinse.functions.numbers import outside, rounded_share, to_number
from sparkrinse.functions.text import is_email, trim_spaces
from sparkrinse.operators.quantiles import iqr_fences, numeric_summaries, quantile_values
from sparkrinse.operators.tidy import measure_columns, rows_per_column

SAMPLES = 10
# The reasons shown next to a rejected value.
BAD_EMAIL = "Malformed email format"
BAD_DATE = "Unparseable date expression"
TOO_LOW = "Below Q1 - 1.5*IQR"
TOO_HIGH = "Above Q3 + 1.5*IQR"


def _texts(df: DataFrame, name: str) -> Column:
    return schema.col(name).cast("string")


def _with_rate(counts: DataFrame) -> DataFrame:
    return counts.withColumn(
        "valid_rate", rounded_share(F.col("valid_count"), F.col("valid_count") + F.col("invalid_count"))
    )


def validate_emails(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: total, valid, invalid and missing counts and the share that is valid."""

    def measures(name: str) -> dict[str, Column]:
        text = _texts(df, name)
        return {
            "total_records": F.count(F.lit(1)),
            "valid_count": F.count_if(is_email(text)),
            "invalid_count": F.count_if(~is_email(text)),
            "missing_count": F.count_if(text.isNull()),
        }

    return _with_rate(rows_per_column(df, columns, measures))


def _samples(
    df: DataFrame, rejected: Column, key: Sequence[str], value: Column, reason: Column, limit: int
) -> DataFrame:
    """The first rejected rows in key order: a bounded heap per task, no global sort."""
    chosen = df.where(rejected).select(*[schema.col(k) for k in key], value.alias("value"), reason.alias("reason"))
    return chosen.orderBy(*[schema.col(k) for k in key], "value").limit(limit)


def invalid_emails(df: DataFrame, column: str, key: Sequence[str], limit: int = SAMPLES) -> DataFrame:
    text = _texts(df, column)
    return _samples(df, ~is_email(text), key, trim_spaces(text), F.lit(BAD_EMAIL), limit)


def validate_dates(df: DataFrame, columns: Sequence[str], formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """One row per column: counts, valid share, and the earliest and latest day."""

    def measures(name: str) -> dict[str, Column]:
        value = schema.col(name)
        day = parse_date(value, schema.type_of(df, name), formats)
        return {
            "total_records": F.count(F.lit(1)),
            "valid_count": F.count(day),
            "invalid_count": F.count(value) - F.count(day),
            "missing_count": F.count_if(value.isNull()),
            "min_date": F.date_format(F.min(day), "yyyy-MM-dd"),
            "max_date": F.date_format(F.max(day), "yyyy-MM-dd"),
        }

    return _with_rate(rows_per_column(df, columns, measures))


def invalid_dates(
    df: DataFrame,
    column: str,
    key: Sequence[str],
    formats: Sequence[str] = DATE_FORMATS,
    limit: int = SAMPLES,
) -> DataFrame:
    value = schema.col(column)
    day = parse_date(value, schema.type_of(df, column), formats)
    rejected = value.isNotNull() & day.isNull()
    return _samples(df, rejected, key, value.cast("string"), F.lit(BAD_DATE), limit)


def numeric_fences(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    return iqr_fences(quantile_values(df, columns, (0.25, 0.75)))


def validate_numeric(df: DataFrame, columns: Sequence[str], check_negatives: bool = True) -> DataFrame:
    """One row per column: sign counts, IQR fences and how many values lie outside them."""
    found = numeric_summaries(df, columns)
    total = df.count()
    missing = measure_columns(df, columns, lambda c: {"n": F.count_if(schema.null_if_nan(df, c).isNull())})
    rows = []
    for name in columns:
        f = found.get(name, {})
        low, high = f.get("fence", (0.0, 0.0))
        signs = [f.get(sign, 0) for sign in ("negative", "zero", "positive")]
        rows.append((name, total, *signs, missing[name]["n"], f.get("outliers", 0), low, high, check_negatives and signs[0] > 0))
    shape = (
        "column_name STRING, total_records BIGINT, negative_count BIGINT, zero_count BIGINT, positive_count BIGINT, "
        "missing_count BIGINT, outliers_count BIGINT, lower_bound DOUBLE, upper_bound DOUBLE, has_negative_issues BOOLEAN"
    )
    # rounded by Spark, half up like every other figure
    return df.sparkSession.createDataFrame(rows, shape).withColumns(
        {c: F.round(c, 2) for c in ("lower_bound", "upper_bound")}
    )


def flag_outliers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with a Boolean ``<column>_is_outlier`` per column: beyond the IQR fences, NULL without a number.

    A column without any number is flagged NULL throughout.
    """
    found = numeric_fences(df, columns)
    flags = {}
    for name in columns:
        number = to_number(schema.col(name), schema.type_of(df, name))
        low, high = found.get(name, (None, None))
        flags[f"{name}_is_outlier"] = outside(number, F.lit(low).cast("double"), F.lit(high).cast("double"))
    return df.withColumns(flags)


def outlier_samples(df: DataFrame, column: str, key: Sequence[str], limit: int = SAMPLES) -> DataFrame:
    number = to_number(schema.col(column), schema.type_of(df, column))
    fence = numeric_fences(df, [column]).get(column)
    if fence is None:
        return _samples(df, F.lit(False), key, number, F.lit(TOO_HIGH), limit)
    low, high = F.lit(fence[0]), F.lit(fence[1])
    reason = F.when(number < low, TOO_LOW).otherwise(TOO_HIGH)
    return _samples(df, outside(number, low, high), key, number, reason, limit)


def rejected_samples(
    df: DataFrame,
    key: Sequence[str],
    *,
    emails: Sequence[str] = (),
    dates: Sequence[str] = (),
    numbers: Sequence[str] = (),
    formats: Sequence[str] = DATE_FORMATS,
    limit: int = SAMPLES,
) -> DataFrame:
    """``column_name, key..., value, reason``: the first rejected rows of every column, in one job.

    The same rows as ``invalid_emails``, ``invalid_dates`` and ``outlier_samples`` of the single columns,
    values as text. Every task forwards ``limit`` rows per column, whatever share of them is rejected.
    """
    tests = []
    for name in emails:
        text = _texts(df, name)
        tests.append((name, ~is_email(text), trim_spaces(text), F.lit(None).cast("double"), F.lit(BAD_EMAIL)))
    for name in dates:
        value = schema.col(name)
        day = parse_date(value, schema.type_of(df, name), formats)
        tests.append((name, value.isNotNull() & day.isNull(), value.cast("string"), F.lit(None).cast("double"), F.lit(BAD_DATE)))
    for name, (low, high) in numeric_fences(df, numbers).items():
        number = to_number(schema.col(name), schema.type_of(df, name))
        reason = F.when(number < low, TOO_LOW).otherwise(TOO_HIGH)
        tests.append((name, outside(number, F.lit(low), F.lit(high)), number.cast("string"), number, reason))
    each = [
        F.struct(F.lit(name).alias("column_name"), F.coalesce(rejected, F.lit(False)).alias("rejected"), value.alias("value"), number.alias("number"), reason.alias("reason"))
        for name, rejected, value, number, reason in tests
    ]
    if not each:
        raise ValueError("name a column to check")
    places = F.struct(*[schema.col(k).alias(k) for k in key])
    rows = df.select(places.alias("key"), F.inline(F.filter(F.array(*each), lambda x: x["rejected"])))
    order = F.row_number().over(Window.partitionBy("column_name").orderBy("key", "number", "value"))
    return rows.withColumn("rank", order).where(F.col("rank") <= limit).select("column_name", "key.*", "value", "reason")
