"""Read delimited text whose delimiter, encoding and types are unknown; other formats pass through."""
from __future__ import annotations

import csv
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkrinse import schema
from sparkrinse.functions.numbers import to_number
from sparkrinse.operators.tidy import measure_columns
from sparkrinse.plans.cleaning import trim_headers
from sparkrinse.sources.quoted_lines import quoted_records, well_quoted
from sparkrinse.staging import stage

# Spellings that stand for a missing value in a delimited file.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Spellings read as booleans.
TRUE_WORDS, FALSE_WORDS = ("True", "TRUE", "true"), ("False", "FALSE", "false")
# In order of preference when a file gives no reason to choose.
DELIMITERS = ("\t", ";", "|", ",")
DELIMITED = ("csv", "txt", "tsv", "")
COLUMNAR = ("parquet", "orc", "json")

_RAW = "__raw_line"


def _format_of(path: str) -> str:
    return PurePosixPath(path).suffix.lstrip(".").lower()


def stored_bytes(spark: SparkSession, path: str) -> DataFrame:
    """``file_name, file_size_bytes, files`` of everything under a path, from the file listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.agg(
        F.regexp_extract(F.min("path"), "([^/]+)$", 1).alias("file_name"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("file_size_bytes"),
        F.count(F.lit(1)).alias("files"),
    )


@dataclass(frozen=True)
class TextLayout:
    """What one scan of delimited text tells: its encoding, whether quoted values span lines, its first lines."""

    encoding: str
    quoted_breaks: bool
    first_lines: tuple[str, ...]


def text_layout(spark: SparkSession, path: str) -> TextLayout:
    """UTF-8 if every line is valid UTF-8, else Latin-1, which can decode any bytes.

    A line with an odd number of quotes begins or ends a value that spans lines. ``first_lines`` are the
    distinct first lines that are not blank, one file each, two at most, as they are stored.
    """
    line, place = F.col("value"), F.col("_metadata")
    lines = spark.read.text(path).select(
        line.alias("line"), place["file_path"].alias("file"), F.is_valid_utf8(line).alias("valid"),
        (_occurrences(line, '"') % 2 == 1).alias("odd"),
        F.struct(place["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("id")).alias("at"),
    )
    files = lines.groupBy("file").agg(
        F.bool_and("valid").alias("valid"), F.bool_or("odd").alias("odd"),
        F.min_by("line", F.when(F.length(F.trim("line")) > 0, F.col("at"))).alias("first"),
    )
    found = files.agg(
        F.bool_and("valid").alias("valid"), F.bool_or("odd").alias("odd"), F.min("first").alias("least"), F.max("first").alias("most")
    ).first()
    firsts = tuple(dict.fromkeys(x for x in (found["least"], found["most"]) if x is not None))
    return TextLayout("ISO-8859-1" if found["valid"] is False else "UTF-8", bool(found["odd"]), firsts)


def detect_encoding(spark: SparkSession, path: str) -> str:
    return text_layout(spark, path).encoding


def _outside_quotes(line: Column) -> Column:
    # Possessive, or a long quoted value would exhaust the stack.
    return F.regexp_replace(line, '"[^"]*+(?:""[^"]*+)*+"', "")


def _occurrences(line: Column, delimiter: str) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(delimiter), F.lit("")))


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """The candidate that most lines contain equally often; comma when none occurs."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(_outside_quotes(F.col("value")).alias("line"))
    places = F.array(
        *[F.struct(F.lit(d).alias("delimiter"), _occurrences(F.col("line"), d).alias("k")) for d in DELIMITERS]
    )
    tallies = lines.select(F.inline(places)).where("k > 0").groupBy("delimiter", "k").agg(F.count(F.lit(1)).alias("n"))
    best = tallies.groupBy("delimiter").agg(F.max("n").alias("agreeing"), F.sum(F.col("n") * F.col("k")).alias("seen"))
    found = {r["delimiter"]: (r["agreeing"], r["seen"]) for r in best.collect()}
    if not found:
        return ","
    return max(DELIMITERS, key=lambda d: (*found.get(d, (0, 0)), -DELIMITERS.index(d)))


def _header(spark: SparkSession, path: str, sep: str, encoding: str) -> list[str]:
    """Names from the first line that is not blank, made unique."""
    lines = spark.read.option("encoding", encoding).option("header", "false").option("sep", "\x00").option(
        "quote", ""
    ).schema("line STRING").csv(path)
    first = lines.where(F.length(F.trim("line")) > 0).first()
    if first is None:
        raise ValueError(f"{path} contains no data")
    raw = next(csv.reader([first["line"].lstrip("\ufeff")], delimiter=sep))
    return [name if name.strip() else f"Unnamed: {i}" for i, name in enumerate(raw)]


def _unique(names: Sequence[str]) -> list[str]:
    done: list[str] = []
    for raw in names:
        name, suffix = raw.strip(), 2
        while name in done:
            name, suffix = f"{raw.strip()}_{suffix}", suffix + 1
        done.append(name)
    return done


def read_delimited(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    encoding: str | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """All columns as text. Rows with too many fields are dropped, short rows padded with nulls.

    Line breaks inside quotes are found out unless ``multi_line`` tells. Byte ranges of such a file are read
    side by side, unless quotes stand inside values as well; then only one task per file can tell where a
    value ends. Files whose first lines differ have no common header and raise ``ValueError``.
    """
    layout = text_layout(spark, path)
    if len({line.lstrip("\ufeff").rstrip("\r") for line in layout.first_lines}) > 1:
        raise ValueError(f"the files of {path} have different headers: {' and '.join(layout.first_lines)}")
    multi_line = layout.quoted_breaks if multi_line is None else multi_line
    sep = sep or detect_delimiter(spark, path)
    encoding = encoding or layout.encoding
    names = _unique(_header(spark, path, sep, encoding))
    columns = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    if multi_line:
        found = _quoted_rows(spark, path, sep, encoding, columns)
        if found is not None:
            return found.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(names)])
    rows = (
        spark.read.schema(columns.add(_RAW, T.StringType()))
        .options(
            header=True, sep=sep, encoding=encoding, quote='"', escape='"', mode="PERMISSIVE",
            columnNameOfCorruptRecord=_RAW, multiLine=multi_line,
        )
        .csv(path)
    )
    fields = _occurrences(_outside_quotes(F.col(_RAW)), sep) + 1
    # Spark refuses to read nothing but the raw line, so the filter looks at a data column as well.
    any_value = F.length(F.coalesce("c0", F.lit(""))) >= 0
    kept = rows.where((F.col(_RAW).isNull() | (fields <= len(names))) & any_value)
    return kept.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(names)])


def _quoted_rows(spark: SparkSession, path: str, sep: str, encoding: str, columns: T.StructType) -> DataFrame | None:
    """Rows of files with line breaks inside quotes, or nothing where quotes do not tell where values end."""
    if len(sep) > 1 or encoding.upper() not in ("UTF-8", "ISO-8859-1"):
        return None
    text = F.col("record").cast("string") if encoding.upper() == "UTF-8" else F.decode("record", encoding)
    records = quoted_records(spark, path).select("file", "block", "number", F.regexp_replace(text, "^\ufeff|\r$", "").alias("record"))
    records = records.where(F.length(F.trim("record")) > 0)
    header = records.groupBy("file").agg(
        F.min(F.struct("block", "number")).alias("header"), F.bool_and(well_quoted(F.col("record"), sep)).alias("fine")
    )
    header = stage(header, "quoted-headers")
    if not header.agg(F.bool_and("fine").alias("fine")).first()["fine"]:
        return None
    rows = records.join(header, "file").where(F.struct("block", "number") != F.col("header"))
    fields = _occurrences(_outside_quotes(F.col("record")), sep) + 1
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    parsed = rows.where(fields <= len(columns.fields)).select(F.from_csv("record", columns.simpleString()[len("struct<"):-1].replace(":", " "), options).alias("row"))
    return parsed.select("row.*")


def normalize_na(df: DataFrame, tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """Spellings of "missing" become NULL in every text column."""
    def value(f: T.StructField) -> Column:
        c = schema.col(f.name)
        return (F.when(~c.isin(*tokens), c) if schema.is_text(f.dataType) else c).alias(f.name)

    return df.select(*[value(f) for f in df.schema.fields])


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns become BIGINT, DOUBLE or BOOLEAN where every value allows it.

    One aggregation decides for all columns; a column without any value becomes DOUBLE.
    """
    texts = [f.name for f in df.schema.fields if schema.is_text(f.dataType)]

    def measures(name: str) -> dict[str, Column]:
        c = schema.col(name)
        return {
            "present": F.count(c),
            "whole": F.count(F.when(c.rlike(r"^\s*[+-]?\d+\s*$"), c.try_cast("bigint"))),
            "numbers": F.count(to_number(c, T.StringType())),
            "booleans": F.count_if(c.isin(*TRUE_WORDS, *FALSE_WORDS)),
        }

    found = measure_columns(df, texts, measures) if texts else {}

    def typed(f: T.StructField) -> Column:
        c = schema.col(f.name)
        if f.name not in found:
            return c
        counts = found[f.name]
        if counts["present"] and counts["whole"] == counts["present"]:
            c = F.trim(c).try_cast("bigint")
        elif counts["numbers"] == counts["present"]:
            c = to_number(c, T.StringType())
        elif counts["booleans"] == counts["present"]:
            c = c.isin(*TRUE_WORDS)
        return c.alias(f.name)

    return df.select(*[typed(f) for f in df.schema.fields])


def read_dataset(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    sep: str | None = None,
    encoding: str | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """Load a file, folder or glob: delimited text with everything detected, or parquet, ORC, JSON."""
    fmt = _format_of(path) if fmt is None else fmt.lower()
    if fmt in DELIMITED:
        if stored_bytes(spark, path).first()["file_size_bytes"] == 0:
            raise ValueError(f"{path} is empty (0 bytes)")
        df = infer_types(normalize_na(read_delimited(spark, path, sep, encoding, multi_line)))
    elif fmt in COLUMNAR:
        df = schema.nan_to_null(trim_headers(spark.read.format(fmt).load(path)))
    else:
        raise ValueError(f"unsupported format {fmt!r}; expected one of {', '.join(DELIMITED[:-1] + COLUMNAR)}")
    if df.isEmpty():
        raise ValueError(f"{path} contains 0 rows")
    return df
