"""Numeric expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkrinse import schema

# A bare try_cast would also accept 5d, 5f and 0x1p3, so the spelling is checked first.
NUMBER_SHAPE = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"

# Doubles beyond this magnitude do not fit a 64-bit integer.
BIGINT_LIMIT = 9.2e18


def to_number(value: Column, data_type: T.DataType) -> Column:
    """The value as DOUBLE, or NULL when it does not spell a number."""
    if schema.is_text(data_type):
        return F.when(value.rlike(NUMBER_SHAPE), value.try_cast("double"))
    if schema.is_float(data_type):
        return F.when(~F.isnan(value), value.cast("double"))
    if schema.is_number(data_type) or schema.is_boolean(data_type):
        return value.cast("double")
    return F.lit(None).cast("double")


def is_whole(number: Column) -> Column:
    """True when a DOUBLE can become a BIGINT without loss of its fraction; infinities cannot."""
    return (number % 1 == 0) & (F.abs(number) < BIGINT_LIMIT)


def outside(number: Column, low: Column, high: Column) -> Column:
    return (number < low) | (number > high)


def rounded_share(part: Column, whole: Column, scale: int = 2) -> Column:
    """Percentage of ``part`` in ``whole``, 0 when there is nothing to divide by."""
    return F.round(F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0)), scale)
