"""Registered queries against their SQL counterparts on the smallest tables.

All of them run when FULL_CHECK is set; otherwise one or two of each kind.
"""
import os

import pytest
from oracle import connect, differences

import __spark_entry__ as entry_points

FOLDER = os.environ.get("CHECK_FOLDER", "/root/testdata/sf0.001")
CHOSEN = (
    "missing_by_column", "top5_by_column", "casing_defects", "date_validation", "numeric_validation", "column_classes",
    "quality_score", "dedupe_by_key_last", "clean_title", "replace_outlier_median", "impute_cat_mode", "clean_default",
    "audit_log", "cleaning_summary", "monthly_revenue", "describe_stats", "corr_matrix", "histogram30", "box_by_group",
    "ols_by_group", "kpi_display", "csv_round_trip", "before_after",
)
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    with connect(FOLDER) as opened:
        yield opened


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("FULL_CHECK") else CHOSEN)
def test_query(spark, connection, name):
    assert differences(QUERIES[name](spark, FOLDER), connection, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["month", "revenue", "orders"]
