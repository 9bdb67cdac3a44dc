"""The whole way from a raw table to its report: profile, clean, profile again, analyse, tabulate."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from sparkrinse.functions.dates import java_pattern
from sparkrinse.operators import reports
from sparkrinse.operators.analytics import AnalyticsReport, analyze_dataset
from sparkrinse.operators.profile import DatasetProfile, profile_dataset
from sparkrinse.plans.cleaning import CleanResult, clean
from sparkrinse.plans.config import CleaningConfig
from sparkrinse.sources.writers import publish_report, write_report
from sparkrinse.staging import stage


@dataclass
class Report:
    raw_profile: DatasetProfile
    clean_profile: DatasetProfile
    result: CleanResult
    cleaned: DataFrame
    analytics: AnalyticsReport

    def tables(self) -> dict[str, DataFrame]:
        raw_columns, clean_columns = self.raw_profile.columns_frame(), self.clean_profile.columns_frame()
        found = {
            "before_after": reports.before_after(self.raw_profile, self.clean_profile),
            "raw_profile": raw_columns,
            "clean_profile": clean_columns,
            "raw_quality": self.raw_profile.quality.frame(self.cleaned.sparkSession),
            "clean_quality": self.clean_profile.quality.frame(self.cleaned.sparkSession),
            "column_diagnostics": reports.column_diagnostics(raw_columns, clean_columns),
            "audit_log": self.result.audit_frame(),
            "cleaning_summary": self.result.summary_frame(),
            **self.analytics.tables(),
        }
        if self.analytics.is_sales_domain:
            found["business_kpis"] = reports.business_kpis(self.analytics.sales["sales_totals"])
        return found

    def write(self, folder: str, fmt: str = "parquet") -> None:
        write_report(self.tables(), folder, fmt)

    def publish(self, folder: str, fmt: str = "parquet") -> str:
        """All tables at once or none, read back by ``sources.writers.read_report``; runs may be repeated."""
        return publish_report(self.tables(), folder, fmt)


def build_report(df: DataFrame, config: CleaningConfig | None = None) -> Report:
    """The cleaned table is written once to shared storage because half a dozen jobs read it."""
    config = config or CleaningConfig()
    raw_profile = profile_dataset(df, config.role_overrides, config.date_formats)
    result = clean(df, config)
    cleaned = stage(result.cleaned, "cleaned")
    result.cleaned = cleaned
    return Report(
        raw_profile,
        profile_dataset(cleaned, config.role_overrides, config.date_formats),
        result,
        cleaned,
        analyze_dataset(cleaned, config.role_overrides, (java_pattern(config.target_date_format),)),
    )
