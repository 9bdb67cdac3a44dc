"""The 0-100 quality score: weights, thresholds, grades and advice."""
from __future__ import annotations

from collections.abc import Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Weights of the four sub-scores.
WEIGHTS = {"completeness": 0.35, "uniqueness": 0.25, "consistency": 0.20, "validity": 0.20}
# Lowest overall score of each grade, and what the grade means.
GRADES = (
    (90, "Excellent", "Dataset is in excellent condition with minimal defects."),
    (75, "Good", "Dataset is in good shape with moderate cleaning recommended."),
    (60, "Fair", "Notable data hygiene issues detected. Data cleaning required."),
    (40, "Poor", "Substantial missingness, duplicates, or formatting errors require remediation."),
    (None, "Critical", "Severe data-quality problems detected across multiple dimensions."),
)
# Advice given for each kind of defect.
ADVICE_DUPLICATES = "Remove {} duplicate records."
ADVICE_MISSING = "Impute or handle {} missing cells across columns."
ADVICE_TEXT = "Apply text standardization to fix whitespace and casing inconsistencies."
ADVICE_FORMATS = "Resolve format anomalies in date, email, or negative quantity fields."
ADVICE_NONE = "Dataset meets professional quality benchmarks."
EMPTY_SUMMARY = "Empty dataset."
EMPTY_ADVICE = "Upload a non-empty dataset."
# The gauge uses bands of its own.
GAUGE_BANDS = ((85, "green"), (70, "blue"), (50, "amber"), (None, "red"))


@dataclass(frozen=True)
class QualityScore:
    overall_score: float
    grade: str
    completeness_score: float
    uniqueness_score: float
    consistency_score: float
    validity_score: float
    summary_text: str
    recommendations: tuple[str, ...]

    def frame(self, spark: SparkSession) -> DataFrame:
        row = asdict(self) | {"recommendations": list(self.recommendations)}
        kinds = "overall_score DOUBLE, grade STRING, completeness_score DOUBLE, uniqueness_score DOUBLE, "
        kinds += "consistency_score DOUBLE, validity_score DOUBLE, summary_text STRING, recommendations ARRAY<STRING>"
        return spark.createDataFrame([tuple(row.values())], kinds).withColumn(
            "gauge_band", gauge_band(F.col("overall_score"))
        )


def _kept_share(defects: float, checked: float) -> float:
    """100 when nothing was checked, else the share without defect, held within 0 and 100."""
    return max(0.0, min(100.0, (1.0 - defects / checked) * 100.0)) if checked else 100.0


def grade_of(overall: float) -> tuple[str, str]:
    return next((name, text) for floor, name, text in GRADES if floor is None or overall >= floor)


def gauge_band(overall: Column) -> Column:
    band = F.lit(GAUGE_BANDS[-1][1])
    for floor, name in reversed(GAUGE_BANDS[:-1]):
        band = F.when(overall >= floor, name).otherwise(band)
    return band


def quality_score(
    rows: int,
    columns: int,
    missing_cells: int,
    duplicate_rows: int,
    inconsistent_columns: int,
    failure_counts: Iterable[int],
) -> QualityScore:
    """Score a table from its profile counts.

    ``failure_counts`` holds one number per column and kind of check (dates, e-mails, negatives);
    a check that found nothing does not enlarge the base.
    """
    if not rows or not columns:
        return QualityScore(0.0, "Critical", 0.0, 0.0, 0.0, 0.0, EMPTY_SUMMARY, (EMPTY_ADVICE,))
    failures = [count for count in failure_counts if count > 0]
    parts = {
        "completeness": _kept_share(missing_cells, rows * columns),
        "uniqueness": _kept_share(duplicate_rows, rows),
        "consistency": _kept_share(inconsistent_columns, columns),
        "validity": _kept_share(sum(failures), rows * len(failures)),
    }
    overall = round(sum(parts[name] * weight for name, weight in WEIGHTS.items()), 1)
    grade, summary = grade_of(overall)
    advice = [
        text
        for wanted, text in (
            (duplicate_rows, ADVICE_DUPLICATES.format(duplicate_rows)),
            (missing_cells, ADVICE_MISSING.format(missing_cells)),
            (inconsistent_columns, ADVICE_TEXT),
            (failures, ADVICE_FORMATS),
        )
        if wanted
    ]
    return QualityScore(
        overall,
        grade,
        *[round(parts[name], 1) for name in WEIGHTS],
        summary,
        tuple(advice or [ADVICE_NONE]),
    )
