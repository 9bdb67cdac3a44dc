import math

import numpy as np
import pandas as pd
import pytest

from sparkrinse import analyze_dataset, detect_semantics
from sparkrinse.operators import analytics, charts, quantiles, reports
from sparkrinse.plans.report import build_report
from sparkrinse.plans.cleaning import fit
from sparkrinse.staging import fresh_path, release
from sparkrinse.streaming.clean_stream import clean_stream
from workload.dirty_sales import stored_sales

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("few", [4_096, 20])
def test_statistics_match_pandas(spark, monkeypatch, few):
    # the second run narrows its ranges down
    monkeypatch.setattr(quantiles, "LISTED", few)
    rng = np.random.default_rng(1)
    data = pd.DataFrame({"a": rng.exponential(size=300), "b": rng.integers(0, 9, 300).astype(float)})
    data.loc[::7, "b"] = np.nan
    df = spark.createDataFrame([tuple(None if math.isnan(v) else float(v) for v in r) for r in data.values], "a DOUBLE, b DOUBLE")
    found = {r["column_name"]: r for r in analytics.describe(df).collect()}
    wanted = data.describe()
    for c in data:
        for ours, theirs in (("mean", "mean"), ("std", "std"), ("q25", "25%"), ("q50", "50%"), ("q75", "75%"), ("max", "max")):
            assert found[c][ours] == pytest.approx(wanted[c][theirs], abs=0.0051)
        assert found[c]["skew"] == pytest.approx(data[c].skew(), abs=0.0051)
    pairs = {(r["col_x"], r["col_y"]): r["r"] for r in analytics.correlations(df).collect()}
    assert pairs["a", "b"] == pairs["b", "a"] == pytest.approx(data.corr().loc["a", "b"], abs=0.0051)
    assert pairs["a", "a"] == 1.0


def test_constant_columns(spark):
    df = spark.createDataFrame([(float(i), 5.1) for i in range(10)], "a DOUBLE, k DOUBLE")
    pairs = {(r["col_x"], r["col_y"]): r["r"] for r in analytics.correlations(df).collect()}
    assert pairs["a", "k"] is None and pairs["k", "k"] is None
    assert {r["column_name"]: r["skew"] for r in analytics.describe(df).collect()}["k"] == 0.0


def test_revenue_falls_back(spark):
    df = spark.createDataFrame([(1, 2.0)], "size INT, weight DOUBLE")
    assert analytics.sales_totals(df, detect_semantics(df.columns, {"quantity": None})).first()["total_revenue"] == 1.0


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)], "x DOUBLE")
    found = charts.histogram(df, "x", 10).orderBy("bin").collect()
    assert [r["n"] for r in found] == np.histogram(range(11), 10)[0].tolist()
    constant = charts.histogram(df.where("x = 4"), "x", 30).where("n > 0").collect()
    assert [(r["bin"], r["n"]) for r in constant] == [(16, 1)]
    assert charts.histogram(df.where("x > 99"), "x").isEmpty()


def test_box_statistics(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 100)] + [("b", 5.0), (None, 7.0)], "g STRING, x DOUBLE")
    found = {r["label"]: r for r in charts.box_statistics(df, "x", "g").collect()}
    assert set(found) == {"a", "b"}
    assert (found["a"]["median"], found["a"]["high_whisker"], found["a"]["outliers_count"]) == (3.0, 4.0, 1)
    assert charts.box_statistics(df.where("x > 1000"), "x").isEmpty()


def test_trendline_needs_rows_and_spread(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(6)], "x DOUBLE, y DOUBLE")
    line = charts.trendlines(df, "x", "y").first()
    assert (line["slope"], line["intercept"], line["n"]) == (pytest.approx(2.0), pytest.approx(1.0), 6)
    assert charts.trendlines(df.limit(5), "x", "y").first()["slope"] is None


def test_scatter_has_all_points_or_an_even_share(spark):
    df = spark.range(20_000).selectExpr("id AS x", "id AS y")
    assert charts.scatter_points(df, "x", "y").count() == 20_000
    some = [r["x"] for r in charts.scatter_points(df, "x", "y", fraction=0.1).collect()]
    assert 1_700 < len(some) < 2_300 and max(some) > 19_900
    assert sorted(some) == sorted(r["x"] for r in charts.scatter_points(df.repartition(7), "x", "y", fraction=0.1).collect())


def test_whole_report(spark, tmp_path):
    report = build_report(stored_sales(spark, FOLDER))
    assert report.analytics.is_sales_domain
    assert report.clean_profile.total_missing_cells == 0
    assert report.clean_profile.quality.overall_score > report.raw_profile.quality.overall_score
    tables = report.tables()
    assert {"business_kpis", "monthly_revenue", "statistics", "correlations", "column_diagnostics"} <= set(tables)
    total = tables["sales_totals"].first()["total_revenue"]
    by_region = sum(r["revenue"] for r in tables["revenue_by_region"].collect())
    assert by_region == pytest.approx(total, rel=1e-9)
    report.write(str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report" / "before_after")).count() == 6
    assert release(spark) > 0


def test_table_without_sales(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "label STRING, k INT")
    report = analyze_dataset(df)
    assert not report.is_sales_domain and not report.sales
    assert report.tables()["general_kpis"].first()["data_density"] == 100.0


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, " a  b "), (2, "C")], "k INT, label STRING")
    source = str(tmp_path / "in")
    df.write.parquet(source)
    rows = spark.readStream.schema(df.schema).parquet(source)
    out = fresh_path(spark, "stream")
    clean_stream(rows, fit(df), out, str(tmp_path / "state")).awaitTermination()
    assert sorted(r["label"] for r in spark.read.parquet(out).collect()) == ["A B", "C"]


def test_outlier_points_per_group(spark):
    from sparkrinse.operators.charts import box_outliers

    rows = [(i, "hot", float(i % 10)) for i in range(300)] + [(i, "hot", 1000.0 + i % 3) for i in range(300, 330)]
    rows += [(i, "cold", float(i % 7)) for i in range(400, 420)] + [(450, "cold", -99.0), (451, None, 1e9), (452, "cold", None)]
    df = spark.createDataFrame(rows, "id LONG, g STRING, v DOUBLE").repartition(5)
    found = [tuple(r) for r in box_outliers(df, "v", ["id"], "g", limit=12).orderBy("label", "rank").collect()]
    hot = [(1002.0, i) for i in range(302, 330, 3)] + [(1001.0, i) for i in range(301, 330, 3)]
    assert found == [("cold", 1, -99.0, 450)] + [("hot", n, x, i) for n, (x, i) in enumerate(hot[:12], 1)]
    whole = box_outliers(df, "v", ["id"], limit=1)
    assert [tuple(r) for r in whole.collect()] == [(1, 1e9, 451)]


def test_rejected_rows_of_several_columns(spark):
    from sparkrinse.operators import validate

    rows = [(i, f"a{i}@b.c" if i % 3 else "bad", "2024-01-05" if i % 4 else "no day", 1e6 * (i - 20) if i % 10 == 0 else i / 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id LONG, mail STRING, day STRING, price DOUBLE").repartition(3)
    found = validate.rejected_samples(df, ["id"], emails=["mail"], dates=["day"], numbers=["price"], limit=4)
    single = [("mail", validate.invalid_emails(df, "mail", ["id"], 4)), ("day", validate.invalid_dates(df, "day", ["id"], limit=4)), ("price", validate.outlier_samples(df, "price", ["id"], 4))]
    expected = [(name, r["id"], str(r["value"]), r["reason"]) for name, rows_ in single for r in rows_.collect()]
    shown = [(r["column_name"], r["id"], str(float(r["value"])) if r["column_name"] == "price" else r["value"], r["reason"]) for r in found.collect()]
    assert sorted(shown) == sorted(expected) and len(shown) == 12


def test_preview_in_stored_order(spark, tmp_path):
    import pytest

    from sparkrinse.operators.reports import preview

    path = str(tmp_path / "rows")
    spark.range(0, 1_000, numPartitions=1).selectExpr("999 - id AS n", "'x' AS __name").write.parquet(path)
    stored = spark.read.parquet(path)
    assert [r["n"] for r in preview(stored).collect()] == list(range(999, 984, -1))
    assert [r["n"] for r in preview(stored.where("n < 500"), 3).collect()] == [499, 498, 497]
    assert [r["id"] for r in preview(spark.range(9), 2, order_by=["id"]).collect()] == [0, 1]
    with pytest.raises(ValueError):
        preview(spark.range(9))


def test_correlations_far_from_zero(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=3_000)
    data = {"a": 1e9 + x, "b": -1e9 + 0.4 * x + rng.normal(size=3_000), "c": np.full(3_000, 1e9 + 0.1), "d": rng.normal(size=3_000)}
    data["d"][:2_900] = np.nan
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*data.values())], "a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE").repartition(7)
    pairs = {(r["col_x"], r["col_y"]): r["r"] for r in analytics.correlations(df).collect()}
    assert len(pairs) == 16
    assert pairs["a", "b"] == pairs["b", "a"] == round(float(np.corrcoef(data["a"], data["b"])[0, 1]), 2)
    assert pairs["a", "d"] == round(float(np.corrcoef(data["a"][2_900:], data["d"][2_900:])[0, 1]), 2)
    assert pairs["a", "a"] == 1.0 and all(pairs[k] is None for k in pairs if "c" in k)
    assert all(r["r"] is None for r in analytics.correlations(df.where("a < 0")).collect())


def test_millions_of_orders_are_written_out(spark):
    totals = spark.createDataFrame(
        [(2.5e9, 678.4, 12_345_678, 3_690_012, 90_000)],
        "total_revenue DOUBLE, avg_order_value DOUBLE, total_quantity BIGINT, total_orders BIGINT, unique_customers BIGINT",
    )
    shown = [r["value"] for r in reports.business_kpis(totals).orderBy("position").collect()]
    assert shown == ["$2500.00M", "$678.40", "12.35M", "3,690,012", "90,000"]
