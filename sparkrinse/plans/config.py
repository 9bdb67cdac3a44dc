"""Options of a cleaning run."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from sparkrinse.functions.dates import DATE_FORMATS, java_pattern

NUMERIC_FILLS = ("median", "mean", "mode", "zero", "leave_unchanged")
TEXT_FILLS = ("unknown", "mode", "leave_unchanged")
CASINGS = ("title", "lower", "upper", "preserve")
OUTLIER_TREATMENTS = ("flag_only", "cap_iqr", "replace_median")


@dataclass(frozen=True)
class CleaningConfig:
    remove_duplicates: bool = True
    duplicate_keep_strategy: str = "first"

    num_missing_strategy: str = "median"
    cat_missing_strategy: str = "unknown"
    custom_missing_rules: Mapping[str, str] = field(default_factory=dict)

    # Either of the two spacing flags does both: strip the ends and collapse inner runs.
    strip_whitespace: bool = True
    normalize_internal_spaces: bool = True
    casing_strategy: str = "title"
    standardize_known_categories: bool = True

    auto_convert_types: bool = True
    standardize_dates: bool = True
    target_date_format: str = "%Y-%m-%d"

    fix_negative_values: bool = True
    outlier_strategy: str = "flag_only"

    # Beyond the page's options: how dates are read, and whether they become DATE instead of text.
    date_formats: Sequence[str] = DATE_FORMATS
    as_date: bool = False
    role_overrides: Mapping[str, str | None] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for value, allowed, label in (
            (self.duplicate_keep_strategy, ("first", "last"), "duplicate_keep_strategy"),
            (self.num_missing_strategy, NUMERIC_FILLS, "num_missing_strategy"),
            (self.cat_missing_strategy, TEXT_FILLS, "cat_missing_strategy"),
            (self.casing_strategy, CASINGS, "casing_strategy"),
            (self.outlier_strategy, OUTLIER_TREATMENTS, "outlier_strategy"),
        ):
            if value not in allowed:
                raise ValueError(f"{label} must be one of {', '.join(allowed)}; got {value!r}")
        for column, rule in self.custom_missing_rules.items():
            if rule not in NUMERIC_FILLS + TEXT_FILLS:
                raise ValueError(f"unknown fill {rule!r} for column {column!r}")
        java_pattern(self.target_date_format)

    @property
    def normalizes_spaces(self) -> bool:
        return self.strip_whitespace or self.normalize_internal_spaces
