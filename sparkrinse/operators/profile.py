"""Profile every column of a table and score the whole.

The rows are read for the duplicate count and for the table of distinct values, and once more only
for quartiles of columns with very many values. All checks run on the distinct values, weighted by
their counts. What comes back is a few numbers per column; classes, issues and scores are rules
over those numbers.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkrinse import schema
from sparkrinse.functions.dates import DATE_FORMATS, parse_date
from sparkrinse.functions.numbers import to_number
from sparkrinse.functions.text import fold, has_space_defect, is_email
from sparkrinse.operators import frequency
from sparkrinse.operators.duplicates import duplicate_count
from sparkrinse.operators.quality import QualityScore, quality_score
from sparkrinse.operators.frequency import numeric_value
from sparkrinse.operators.quantiles import iqr_fences, measure_spread, value_quantiles
from sparkrinse.operators.semantics import SemanticMapping, detect_semantics, looks_like_date, looks_like_email
from sparkrinse.operators.tidy import measure_columns
from sparkrinse.staging import discard, stage

# What makes a column numeric, boolean, an e-mail column or categorical.
NUMERIC_SHARE = 0.85
BOOLEAN_WORDS = ("true", "false", "0", "1", "yes", "no")
AT_SIGN_SHARE = 0.5
CATEGORY_FLOOR, CATEGORY_SHARE = 30, 0.05
TOP_VALUES = SAMPLE_VALUES = 5
# The issue texts.
ISSUE_MISSING = "{} missing values ({:.1f}%)"
ISSUE_DATES = "{} invalid date formats"
ISSUE_NEGATIVE = "{} negative values detected"
ISSUE_OUTLIERS = "{} statistical outliers (IQR)"
ISSUE_EMAILS = "{} malformed email addresses"
ISSUE_SPACES = "Inconsistent whitespace / extra spaces"
ISSUE_CASE = "Inconsistent capitalization ({} distinct cases vs {} semantic values)"


@dataclass
class ColumnProfile:
    column_name: str
    position: int
    inferred_type: str
    dtype: str
    total_count: int
    non_null_count: int
    null_count: int
    null_percentage: float
    unique_count: int | None = None
    unique_percentage: float | None = None
    top_values: list[tuple[str, int]] = field(default_factory=list)
    sample_values: list[str] = field(default_factory=list)
    min_val: float | None = None
    max_val: float | None = None
    min_date: str | None = None
    max_date: str | None = None
    mean_val: float | None = None
    median_val: float | None = None
    std_val: float | None = None
    q25_val: float | None = None
    q75_val: float | None = None
    outliers_count: int = 0
    negatives_count: int = 0
    has_leading_trailing_spaces: bool = False
    has_mixed_case: bool = False
    invalid_dates_count: int = 0
    invalid_emails_count: int = 0
    quality_issues: list[str] = field(default_factory=list)


_PROFILE_SCHEMA = """
column_name STRING, position INT, inferred_type STRING, dtype STRING, total_count BIGINT,
non_null_count BIGINT, null_count BIGINT, null_percentage DOUBLE, unique_count BIGINT,
unique_percentage DOUBLE, top_values ARRAY<STRUCT<value: STRING, count: BIGINT>>,
sample_values ARRAY<STRING>, min_val DOUBLE, max_val DOUBLE, min_date STRING, max_date STRING,
mean_val DOUBLE, median_val DOUBLE, std_val DOUBLE, q25_val DOUBLE, q75_val DOUBLE,
outliers_count BIGINT, negatives_count BIGINT, has_leading_trailing_spaces BOOLEAN,
has_mixed_case BOOLEAN, invalid_dates_count BIGINT, invalid_emails_count BIGINT,
quality_issues ARRAY<STRING>
"""


@dataclass
class DatasetProfile:
    spark: SparkSession
    total_rows: int
    total_columns: int
    total_missing_cells: int
    total_duplicate_rows: int
    columns: dict[str, ColumnProfile]
    quality: QualityScore
    semantics: SemanticMapping

    @property
    def total_cells(self) -> int:
        return self.total_rows * self.total_columns

    @property
    def missing_cells_pct(self) -> float:
        return _percent(self.total_missing_cells, self.total_cells)

    @property
    def duplicate_rows_pct(self) -> float:
        return _percent(self.total_duplicate_rows, self.total_rows)

    def of_class(self, inferred_type: str) -> list[str]:
        return [p.column_name for p in self.columns.values() if p.inferred_type == inferred_type]

    def columns_frame(self) -> DataFrame:
        """One row per column with every measured field."""
        names = [f.name for f in fields(ColumnProfile)]
        rows = [tuple(getattr(p, n) for n in names) for p in self.columns.values()]
        return self.spark.createDataFrame(rows, _PROFILE_SCHEMA)

    def summary_frame(self) -> DataFrame:
        """One row for the whole table."""
        row = {
            "total_rows": self.total_rows,
            "total_columns": self.total_columns,
            "total_cells": self.total_cells,
            "total_missing_cells": self.total_missing_cells,
            "missing_cells_pct": self.missing_cells_pct,
            "total_duplicate_rows": self.total_duplicate_rows,
            "duplicate_rows_pct": self.duplicate_rows_pct,
        }
        for label, name in (
            ("numeric", "Numeric"), ("categorical", "Categorical"), ("datetime", "Datetime"),
            ("boolean", "Boolean"), ("text", "Text/ID"),
        ):
            row[f"{label}_columns"] = len(self.of_class(name))
        kinds = ", ".join(f"{k} {'DOUBLE' if k.endswith('_pct') else 'BIGINT'}" for k in row)
        return self.spark.createDataFrame([tuple(row.values())], kinds)


def _percent(part: int, whole: int) -> float:
    return round(part / whole * 100.0, 2) if whole else 0.0


def measure_values(values: DataFrame, dated: Sequence[str], timed: Sequence[str], formats: Sequence[str]) -> DataFrame:
    """One row per column: every per-value check, weighted by how often the value occurs.

    ``dated`` are text columns to be read as dates, ``timed`` columns whose texts are timestamps.
    """
    text, name, n = F.col("text"), F.col("column_name"), F.col("n")
    checked = values.select(
        name,
        n,
        text,
        numeric_value().alias("x"),
        F.when(name.isin(*dated), parse_date(text, T.StringType(), formats))
        .when(name.isin(*timed), text.try_cast("date"))
        .alias("day"),
    )

    def occurrences(condition: Column) -> Column:
        return F.sum(F.when(condition, n).otherwise(0))

    # copies of a spelling meet first, so the last step adds up a few partial rows per column
    spellings = checked.groupBy("column_name", fold(text).alias("folded")).agg(
        F.count(F.lit(1)).alias("spellings"),
        F.sum("n").alias("present"),
        occurrences(F.col("x").isNotNull()).alias("numbers"),
        F.sum(F.col("x") * n).alias("total"),
        F.min("x").alias("least"),
        F.max("x").alias("most"),
        occurrences(F.col("x") < 0).alias("negatives"),
        occurrences(F.contains(text, F.lit("@"))).alias("at_signs"),
        occurrences(~is_email(text)).alias("bad_emails"),
        occurrences(has_space_defect(text)).alias("space_defects"),
        occurrences(F.col("day").isNotNull()).alias("days"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
    )
    sums = ("present", "numbers", "total", "negatives", "at_signs", "bad_emails", "space_defects", "days")
    return spellings.groupBy("column_name").agg(
        F.sum("spellings").alias("distinct"),
        F.count(F.lit(1)).alias("folded"),
        *[F.sum(c).alias(c) for c in sums],
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        F.date_format(F.min("first_day"), "yyyy-MM-dd").alias("min_date"),
        F.date_format(F.max("last_day"), "yyyy-MM-dd").alias("max_date"),
    )


def _base_class(kind, scan: dict, dated: bool) -> str:
    """Datetime and Numeric are settled by what the values spell, the rest by how many there are."""
    if dated or schema.is_temporal(kind):
        return "Datetime"
    if schema.is_number(kind):
        return "Numeric"
    if schema.is_text(kind) and scan["present"] and scan["numbers"] / scan["present"] > NUMERIC_SHARE:
        return "Numeric"
    return "other"


# Counts of a column without any value.
_EMPTY = ("present", "distinct", "folded", "numbers", "days", "at_signs", "bad_emails", "space_defects", "negatives", "outliers")


def profile_dataset(
    df: DataFrame,
    overrides: Mapping[str, str | None] | None = None,
    formats: Sequence[str] = DATE_FORMATS,
    negatives: str = "all",
) -> DatasetProfile:
    """Scan the table and classify, measure and score it.

    ``negatives='all'`` lets negative values of any numeric column lower the validity score,
    ``'roles'`` only those of price, quantity and sales columns.
    """
    if negatives not in ("all", "roles"):
        raise ValueError("negatives must be 'all' or 'roles'")
    roles = detect_semantics(df.columns, overrides)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    scalars = [c for c in df.columns if schema.is_scalar(kinds[c])]
    nested = [c for c in df.columns if c not in scalars]
    dated = [c for c in scalars if schema.is_text(kinds[c]) and looks_like_date(c, roles)]
    timed = [c for c in scalars if schema.is_temporal(kinds[c])]

    repeated = duplicate_count(schema.nan_to_null(df)).first()
    total, duplicates = repeated["total_rows"], repeated["duplicate_rows"]
    scan = {c: dict.fromkeys(_EMPTY, 0) for c in df.columns}
    top: dict[str, list] = {c: [] for c in df.columns}
    samples: dict[str, list[str]] = {c: [] for c in df.columns}
    if nested:
        for name, found in measure_columns(df, nested, lambda c: {"present": F.count(schema.col(c))}).items():
            scan[name] |= found
    base = {c: "other" for c in df.columns}
    quartiles: dict[str, list[float]] = {}
    if scalars:
        values = stage(frequency.value_frequencies(df, scalars), "values")
        for line in measure_values(values, dated, timed, formats).collect():
            scan[line["column_name"]] |= line.asDict()
        outer = stage(frequency.outermost(values, max(TOP_VALUES, SAMPLE_VALUES)), "outermost")
        for line in frequency.first_values(outer, TOP_VALUES).collect():
            top[line["column_name"]].append((line["rank"], line["value"], line["n"]))
        for line in frequency.first_values(outer, SAMPLE_VALUES, by_count=False).orderBy("rank").collect():
            samples[line["column_name"]].append(line["value"])
        discard(outer)
        base = {c: _base_class(kinds[c], scan[c], c in dated) for c in df.columns}
        numeric = [c for c in scalars if base[c] == "Numeric" and scan[c]["numbers"]]
        quartiles = value_quantiles(values, numeric, (0.25, 0.5, 0.75))
        if quartiles:
            means = {c: scan[c]["total"] / scan[c]["numbers"] for c in quartiles}
            for line in measure_spread(values, means, iqr_fences(quartiles)).collect():
                scan[line["column_name"]] |= line.asDict()
        discard(values)

    profiles = {}
    for position, name in enumerate(df.columns, start=1):
        profiles[name] = _describe(
            name, position, kinds[name], total, scan[name], top[name], base[name], quartiles.get(name), roles
        )
        profiles[name].sample_values = samples[name]
    return _assemble(df.sparkSession, total, duplicates, profiles, roles, negatives)


# Relative error of an estimated number of distinct values, and how many errors settle a question.
ESTIMATE_ERROR, SETTLED = 0.01, 4


def classify_columns(df: DataFrame, overrides: Mapping[str, str | None] | None = None) -> DataFrame:
    """``column_name, position, inferred_type``: the classes of ``profile_dataset`` from one scan.

    How many values a column has is estimated by mergeable sketches. Values are counted exactly only for
    columns whose estimate is near what makes a column categorical, or so small that they may be Boolean.
    """
    roles = detect_semantics(df.columns, overrides)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    scalars = [c for c in df.columns if schema.is_scalar(kinds[c])]

    def measures(name: str) -> dict[str, Column]:
        value = frequency.comparable(df, name)
        found = {"present": F.count(value), "total": F.count(F.lit(1)), "estimate": F.approx_count_distinct(value, ESTIMATE_ERROR)}
        if schema.is_text(kinds[name]):
            found["numbers"] = F.count(to_number(value, kinds[name]))
        return found

    scan = measure_columns(df, scalars, measures)
    classes = dict.fromkeys(df.columns, "Text/ID")
    gates, asked = {}, []
    for c in scalars:
        dated = schema.is_text(kinds[c]) and looks_like_date(c, roles)
        base = _base_class(kinds[c], scan[c] | {"numbers": scan[c].get("numbers", 0)}, dated)
        if base == "Datetime" and (dated or scan[c]["present"] or looks_like_date(c, roles)):
            classes[c] = "Datetime"
        elif base == "Numeric":
            classes[c] = "Numeric"
        elif schema.is_boolean(kinds[c]):
            classes[c] = "Boolean"
        else:
            gates[c] = _category_gate(scan[c]["total"])
            room = SETTLED * ESTIMATE_ERROR
            few, near = scan[c]["estimate"] <= CATEGORY_FLOOR * 2, abs(scan[c]["estimate"] - gates[c]) <= room * gates[c]
            asked += [c] if few or near else []
    distinct = {c: scan[c]["estimate"] for c in gates}
    only_words = dict.fromkeys(gates, False)
    if asked:
        word = F.lower(frequency.shown_value()).isin(*BOOLEAN_WORDS)
        exact = frequency.value_frequencies(df, asked).groupBy("column_name").agg(F.count(F.lit(1)).alias("n"), F.every(word).alias("words"))
        distinct |= dict.fromkeys(asked, 0)
        only_words |= dict.fromkeys(asked, True)
        for line in exact.collect():
            distinct[line["column_name"]], only_words[line["column_name"]] = line["n"], line["words"]
    for c, gate in gates.items():
        if distinct[c] <= 2 and only_words[c]:
            classes[c] = "Boolean"
        elif distinct[c] <= gate:
            classes[c] = "Categorical"
    rows = [(c, i, classes[c]) for i, c in enumerate(df.columns, start=1)]
    return df.sparkSession.createDataFrame(rows, "column_name STRING, position INT, inferred_type STRING")


def _category_gate(rows: int) -> int:
    """The most values that a categorical column has."""
    return max(CATEGORY_FLOOR, int(rows * CATEGORY_SHARE))


def _describe(name, position, kind, total, scan, top, base, quartiles, roles) -> ColumnProfile:
    """Apply the classification and issue rules to the measured numbers of one column."""
    present = scan["present"]
    missing = total - present
    p = ColumnProfile(
        name, position, "Text/ID", kind.simpleString(), total, present, missing, _percent(missing, total)
    )
    if missing:
        p.quality_issues.append(ISSUE_MISSING.format(missing, missing / total * 100.0))
    if not schema.is_scalar(kind):
        return p

    p.unique_count = scan["distinct"]
    p.unique_percentage = _percent(p.unique_count, present)
    p.top_values = [(value, n) for _, value, n in sorted(top, key=lambda entry: entry[0])]

    if base == "Datetime" and (scan["days"] or looks_like_date(name, roles)):
        p.inferred_type = "Datetime"
        p.invalid_dates_count = present - scan["days"]
        p.min_date, p.max_date = scan["min_date"], scan["max_date"]
        if p.invalid_dates_count:
            p.quality_issues.append(ISSUE_DATES.format(p.invalid_dates_count))
        return p

    if base == "Numeric":
        p.inferred_type = "Numeric"
        if quartiles:
            p.min_val, p.max_val, p.mean_val = scan["least"], scan["most"], scan["total"] / scan["numbers"]
            p.std_val = (scan["squares"] / (scan["numbers"] - 1)) ** 0.5 if scan["numbers"] > 1 else 0.0
            p.q25_val, p.median_val, p.q75_val = quartiles
            p.outliers_count, p.negatives_count = scan["outliers"], scan["negatives"]
            if p.negatives_count and name in roles.money_columns:
                p.quality_issues.append(ISSUE_NEGATIVE.format(p.negatives_count))
            if p.outliers_count:
                p.quality_issues.append(ISSUE_OUTLIERS.format(p.outliers_count))
        return p

    # two values at most are all among the top values
    only_words = all(value.lower() in BOOLEAN_WORDS for value, _ in p.top_values)
    if schema.is_boolean(kind) or (p.unique_count <= 2 and only_words):
        p.inferred_type = "Boolean"
        return p

    if looks_like_email(name, roles) or (present and scan["at_signs"] / present > AT_SIGN_SHARE):
        p.invalid_emails_count = scan["bad_emails"]
        if p.invalid_emails_count:
            p.quality_issues.append(ISSUE_EMAILS.format(p.invalid_emails_count))
    p.has_leading_trailing_spaces = scan["space_defects"] > 0
    if p.has_leading_trailing_spaces:
        p.quality_issues.append(ISSUE_SPACES)
    folded = scan["folded"]
    p.has_mixed_case = folded < p.unique_count
    if p.has_mixed_case:
        p.quality_issues.append(ISSUE_CASE.format(p.unique_count, folded))
    if p.unique_count <= _category_gate(total):
        p.inferred_type = "Categorical"
    return p


def _assemble(spark, total, duplicates, profiles, roles, negatives) -> DatasetProfile:
    missing = sum(p.null_count for p in profiles.values())
    failures = []
    for p in profiles.values():
        counts_negatives = negatives == "all" or p.column_name in roles.money_columns
        failures += [p.invalid_dates_count, p.invalid_emails_count, p.negatives_count if counts_negatives else 0]
    inconsistent = sum(p.has_leading_trailing_spaces or p.has_mixed_case for p in profiles.values())
    score = quality_score(total, len(profiles), missing, duplicates, inconsistent, failures)
    return DatasetProfile(spark, total, len(profiles), missing, duplicates, profiles, score, roles)
