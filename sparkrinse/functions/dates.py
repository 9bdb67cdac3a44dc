"""Flexible date parsing and strftime-style target formats."""
from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkrinse import schema
from sparkrinse.functions.text import trim_spaces

# Tried in order: year-first, then day-first, then month-first.
DATE_FORMATS = (
    "yyyy-M-d",
    "yyyy-M-d H:mm:ss",
    "yyyy-M-d'T'H:mm:ss",
    "d/M/yyyy",
    "d-M-yyyy",
    "yyyy.M.d",
    "yyyy/M/d",
    "d.M.yyyy",
    "MMM d, yyyy",
    "d MMM yyyy",
    "d/M/yy",
    "M/d/yyyy",
)

_PART = re.compile(r"yyyy|yy|MMM|MM|M|dd|d|HH|H|mm|ss|'[^']*'|.")
# Shape of each part, and the name under which it is captured.
_SHAPES = {
    "yyyy": (r"(\d{4})", "year"),
    "yy": (r"(\d{2})", "short_year"),
    "MM": (r"(\d{2})", "month"),
    "M": (r"(\d{1,2})", "month"),
    "dd": (r"(\d{2})", "day"),
    "d": (r"(\d{1,2})", "day"),
    "HH": (r"(?:[01]\d|2[0-3])", None),
    "H": (r"(?:[01]?\d|2[0-3])", None),
    "mm": (r"(?:[0-5]\d)", None),
    "ss": (r"(?:[0-5]\d)", None),
    "MMM": (r"(?:[A-Za-z]{3,9})", None),
}

# strftime directive to the pattern letters of date_format.
_STRFTIME = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss",
    "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD",
}


def _shape(pattern: str) -> tuple[str, list[str]]:
    """Regular expression of one pattern and the order in which it captures year, month and day."""
    pieces, captured = [], []
    for part in _PART.findall(pattern):
        if part in _SHAPES:
            expression, name = _SHAPES[part]
            pieces.append(expression)
            if name:
                captured.append(name)
        else:
            pieces.append(re.escape(part.strip("'") if len(part) > 1 else part))
    return "^" + "".join(pieces) + "$", captured


def _merged(formats: Sequence[str]) -> list[list[str]]:
    """Group the formats that name year, month and day in the same order, so one expression reads them.

    A format joins an earlier group unless a format in between, of another group, has the same
    punctuation: those two could read the same text and their order matters.
    """
    groups: list[list[str]] = []
    for pattern in formats:
        joined = None
        for group in groups:
            if "MMM" not in pattern and _order(group[0]) == _order(pattern):
                joined = group
            elif any(_punctuation(other) == _punctuation(pattern) for other in group):
                joined = None
        if joined is None:
            groups.append([pattern])
        else:
            joined.append(pattern)
    return groups


def _order(pattern: str) -> tuple[str, ...]:
    return ("named", pattern) if "MMM" in pattern else tuple(_shape(pattern)[1])


def _punctuation(pattern: str) -> str:
    return re.sub(r"[A-Za-z]", "", pattern)


def _parse_group(text: Column, patterns: list[str]) -> Column:
    """Date spelled by one of the patterns or NULL.

    Numeric patterns are recognised by their shape and rearranged to ISO, because casting an ISO
    text is far cheaper than a formatter that throws and catches an exception for every mismatch.
    """
    if "MMM" in patterns[0]:
        fits, long_month = text.rlike(_shape(patterns[0])[0]), patterns[0].replace("MMM", "MMMM")
        return F.when(fits, F.coalesce(F.try_to_date(text, patterns[0]), F.try_to_date(text, long_month)))
    shapes = [_shape(pattern) for pattern in patterns]
    expression = "|".join(shape for shape, _ in shapes)
    # groups of the alternatives that did not match are empty in the replacement
    places: dict[str, str] = {}
    for i, (_, names) in enumerate(shapes):
        for j, name in enumerate(names, start=1):
            places[name] = places.get(name, "") + f"${len(names) * i + j}"
    year = places.get("year", places.get("short_year"))
    iso = F.regexp_replace(text, expression, f"{year}-{places['month']}-{places['day']}")
    if "short_year" in places:
        century = F.when(F.left(iso, F.lit(2)) >= "69", F.lit("19")).otherwise(F.lit("20"))
        iso = F.concat(century, iso)
    return F.when(text.rlike(expression), iso).try_cast("date")


def parse_date(value: Column, data_type: T.DataType, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """The value as DATE; NULL when no format fits or the day does not exist."""
    if schema.is_temporal(data_type):
        return value.cast("date")
    if not schema.is_text(data_type):
        return F.lit(None).cast("date")
    text = trim_spaces(value)
    # no date is spelled without a digit, so other texts are spared the formats
    return F.when(text.rlike(r"\d"), F.coalesce(*[_parse_group(text, group) for group in _merged(formats)]))


def java_pattern(strftime: str) -> str:
    """Translate a strftime pattern; literal letters are quoted, unknown directives are refused."""
    def translate(token: str) -> str:
        if token.startswith("%"):
            if token not in _STRFTIME:
                raise ValueError(f"unsupported date directive {token!r}")
            return _STRFTIME[token]
        return f"'{token}'" if token.isalpha() else token

    return reduce(lambda done, token: done + translate(token), re.findall(r"%.|[A-Za-z]+|.", strftime), "")


def format_date(date: Column, strftime: str) -> Column:
    return F.date_format(date, java_pattern(strftime))


def month_of(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")
