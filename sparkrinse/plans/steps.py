"""The column steps a cleaning plan is made of, each a plain Column expression.

A step is a JSON-able dictionary; ``run_step`` turns it and the current (value, type) of a column
into the next. Constants such as fences and medians were fitted before and enter as literals, so a
whole plan collapses into one projection.
"""
from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkrinse import schema
from sparkrinse.functions import text as tx
from sparkrinse.functions.dates import format_date, parse_date
from sparkrinse.functions.numbers import to_number

Step = Mapping[str, Any]
Typed = tuple[Column, T.DataType]

# Known spellings of payment methods and order states and their canonical term.
SYNONYMS: dict[str, dict[str, str]] = {
    "payment": {
        "credit card": "Credit Card",
        "credit_card": "Credit Card",
        "cc": "Credit Card",
        "paypal": "PayPal",
        "pay-pal": "PayPal",
        "bank transfer": "Bank Transfer",
        "bank_transfer": "Bank Transfer",
        "wire": "Bank Transfer",
        "wire transfer": "Bank Transfer",
        "cash on delivery": "Cash on Delivery",
        "cod": "Cash on Delivery",
        "debit card": "Debit Card",
        "debit_card": "Debit Card",
        "debit": "Debit Card",
    },
    "status": {
        "completed": "Completed",
        "complete": "Completed",
        "shipped": "Shipped",
        "pending": "Pending",
        "cancelled": "Cancelled",
        "canceled": "Cancelled",
        "refunded": "Refunded",
    },
}


def _clip(value: Column, kind: T.DataType, step: Step) -> Typed:
    # least and greatest skip nulls, so a missing value has to be kept missing explicitly
    number = value.cast("double")
    held = F.greatest(F.least(number, F.lit(step["high"])), F.lit(step["low"]))
    return F.when(number.isNotNull(), held), T.DoubleType()


def _replace(value: Column, kind: T.DataType, step: Step) -> Typed:
    if not schema.is_float(kind) and float(step["value"]).is_integer():
        replacement = F.lit(int(step["value"])).cast(kind)
    else:
        value, kind = value.cast("double"), T.DoubleType()
        replacement = F.lit(float(step["value"]))
    beyond = (value < step["low"]) | (value > step["high"])
    return F.when(beyond, replacement).otherwise(value), kind


def _date(value: Column, kind: T.DataType, step: Step) -> Typed:
    day = parse_date(value, kind, step["formats"])
    if step["format"] is None:
        return day, T.DateType()
    return format_date(day, step["format"]), T.StringType()


def _fill(value: Column, kind: T.DataType, step: Step) -> Typed:
    constant = step["value"]
    if schema.is_number(kind):
        whole_type = isinstance(kind, T.IntegralType)
        if whole_type and not float(constant).is_integer():
            value, kind = value.cast("double"), T.DoubleType()
        return F.coalesce(value, F.lit(constant).cast(kind)), kind
    if schema.is_boolean(kind) and not isinstance(constant, bool):
        value, kind = F.initcap(value.cast("string")), T.StringType()
    return F.coalesce(value, F.lit(constant).cast(kind)), kind


def _cast(value: Column, kind: T.DataType, step: Step) -> Typed:
    number = to_number(value, kind) if schema.is_text(kind) else value
    target = T.LongType() if step["to"] == "bigint" else T.DoubleType()
    if schema.is_text(kind) and step["to"] == "bigint":
        # digits beyond 2^53 would be rounded on the way through DOUBLE
        return F.coalesce(F.trim(value).try_cast("bigint"), number.try_cast("bigint")), target
    return number.cast(target), target


def run_step(value: Column, kind: T.DataType, step: Step) -> Typed:
    name = step["step"]
    if name == "squeeze":
        return tx.squeeze_spaces(value), kind
    if name == "trim":
        return (tx.trim_spaces(value) if schema.is_text(kind) else value), kind
    if name == "email":
        return F.lower(tx.trim_spaces(value)), kind
    if name == "synonyms":
        return tx.translate_terms(value, SYNONYMS[step["domain"]]), kind
    if name == "case":
        return tx.recase(value, step["style"]), kind
    if name == "abs":
        return F.when(value < 0, F.abs(value)).otherwise(value), kind
    try:
        builder = {"clip": _clip, "replace": _replace, "date": _date, "fill": _fill, "cast": _cast}[name]
    except KeyError:
        raise ValueError(f"unknown cleaning step {name!r}") from None
    return builder(value, kind, step)


def run_steps(value: Column, kind: T.DataType, steps: Iterable[Step]) -> Typed:
    for step in steps:
        value, kind = run_step(value, kind, step)
    return value, kind
