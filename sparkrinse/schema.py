"""Schema helpers: quoted column references and type families. Metadata only, no Spark job."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    """Back-quote a column name so dots and blanks in headers are safe."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_number(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def is_text(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.StringType, T.VarcharType, T.CharType))


def is_temporal(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_boolean(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.BooleanType)


def is_float(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.FloatType, T.DoubleType))


def is_scalar(data_type: T.DataType) -> bool:
    """True for the types the quality operators look inside; nested columns pass through untouched."""
    return is_number(data_type) or is_text(data_type) or is_temporal(data_type) or is_boolean(data_type)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_number(f.dataType)]


def categorical_columns(df: DataFrame, include_temporal: bool = False) -> list[str]:
    """Text and boolean columns; the exploration page also offers dates, the analysis does not."""
    return [
        f.name
        for f in df.schema.fields
        if is_text(f.dataType)
        or is_boolean(f.dataType)
        or (include_temporal and is_temporal(f.dataType))
    ]


def null_if_nan(df: DataFrame, name: str) -> Column:
    """Missing is NULL everywhere: a NaN in a floating-point column counts as missing."""
    if is_float(type_of(df, name)):
        return F.when(~F.isnan(col(name)), col(name))
    return col(name)


def nan_to_null(df: DataFrame) -> DataFrame:
    if not any(is_float(f.dataType) for f in df.schema.fields):
        return df
    return df.select(*[null_if_nan(df, f.name).alias(f.name) for f in df.schema.fields])
