"""Human-readable renderings of numbers, as Columns."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size units and the divisor between them.
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")
SIZE_STEP = 1024.0


def _pattern(number: Column, pattern: str) -> Column:
    return F.call_function("format_number", number, F.lit(pattern))


def _signed(number: Column, pattern: str) -> Column:
    """DecimalFormat drops the sign of a value that rounds to zero; restore it."""
    shown = _pattern(F.abs(number), pattern)
    return F.when(number < 0, F.concat(F.lit("-"), shown)).otherwise(shown)


def show_number(value: Column) -> Column:
    number = value.cast("double")
    whole = number % 1 == 0
    return (
        F.when(number.isNull() | F.isnan(number), "N/A")
        .when(F.abs(number) >= 1_000_000, F.concat(_signed(number / 1_000_000, "0.00"), F.lit("M")))
        .when(F.abs(number) >= 1_000, F.when(whole, _signed(number, "#,##0")).otherwise(_signed(number, "#,##0.00")))
        .otherwise(F.when(whole, _signed(number, "0")).otherwise(_signed(number, "0.00")))
    )


def show_currency(value: Column, symbol: str = "$") -> Column:
    number = value.cast("double")
    return (
        F.when(number.isNull() | F.isnan(number), "N/A")
        .when(
            F.abs(number) >= 1_000_000,
            F.concat(F.lit(symbol), _signed(number / 1_000_000, "0.00"), F.lit("M")),
        )
        .otherwise(F.concat(F.lit(symbol), _signed(number, "#,##0.00")))
    )


def show_percent(value: Column) -> Column:
    number = value.cast("double")
    return F.when(number.isNull() | F.isnan(number), "0.0%").otherwise(
        F.concat(_signed(number, "0.0"), F.lit("%"))
    )


def show_bytes(value: Column) -> Column:
    size = value.cast("double")
    shown = F.when(size.isNull() | F.isnan(size), "0 B")
    for step, unit in enumerate(SIZE_UNITS):
        scaled = size / SIZE_STEP**step
        shown = shown.when(F.abs(scaled) < SIZE_STEP, F.concat(_signed(scaled, "0.0"), F.lit(f" {unit}")))
    return shown.otherwise(F.concat(_signed(size / SIZE_STEP ** len(SIZE_UNITS), "0.0"), F.lit(" PB")))


def show_count(value: Column) -> Column:
    return F.format_number(value, 0)
