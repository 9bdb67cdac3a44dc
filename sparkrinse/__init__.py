"""Spark-native data quality: profile, score, clean, analyse and report on tables of any size."""
from sparkrinse.operators.analytics import analyze_dataset
from sparkrinse.operators.profile import profile_dataset
from sparkrinse.operators.semantics import SemanticMapping, detect_semantics
from sparkrinse.plans.cleaning import CleaningPlan, clean, fit
from sparkrinse.plans.config import CleaningConfig
from sparkrinse.sources.readers import read_dataset

__all__ = [
    "CleaningConfig",
    "CleaningPlan",
    "SemanticMapping",
    "analyze_dataset",
    "clean",
    "detect_semantics",
    "fit",
    "profile_dataset",
    "read_dataset",
]
