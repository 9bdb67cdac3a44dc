import pytest

from sparkrinse.operators import duplicates
from sparkrinse.operators.duplicates import dedupe_by_key, duplicate_count
from sparkrinse.operators.profile import profile_dataset
from sparkrinse.operators.quality import grade_of, quality_score


def frame(spark, rows, shape):
    return spark.createDataFrame(rows, shape)


def test_classes(spark):
    rows = [
        (i, True, "yes" if i % 2 else "NO", None, str(i), "2024-01-01", float(i), f"{i}@x.org", [1], i * 0.5)
        for i in range(100)
    ]
    shape = (
        "k INT, flag BOOLEAN, yn STRING, nothing STRING, digits STRING, sold_date STRING, delivery_time_days DOUBLE, "
        "contact STRING, nested ARRAY<INT>, `dotted.name` DOUBLE"
    )
    profile = profile_dataset(frame(spark, rows, shape))
    classes = {c: p.inferred_type for c, p in profile.columns.items()}
    assert classes == {
        "k": "Numeric", "flag": "Boolean", "yn": "Boolean", "nothing": "Boolean", "digits": "Numeric",
        "sold_date": "Datetime", "delivery_time_days": "Numeric", "contact": "Text/ID", "nested": "Text/ID",
        "dotted.name": "Numeric",
    }
    assert profile.columns["k"].median_val == 49.5
    assert profile.columns["sold_date"].min_date == "2024-01-01"
    assert profile.total_missing_cells == 100
    assert profile.columns["nothing"].quality_issues == ["100 missing values (100.0%)"]
    assert profile.columns["yn"].top_values == [("NO", 50), ("yes", 50)]


def test_name_alone_makes_a_text_column_a_date(spark):
    profile = profile_dataset(frame(spark, [("x",), ("y",)], "start_time STRING"))
    assert profile.columns["start_time"].inferred_type == "Datetime"
    assert profile.columns["start_time"].invalid_dates_count == 2


def test_nan_is_missing_and_zero_has_one_sign(spark):
    profile = profile_dataset(frame(spark, [(float("nan"),), (None,), (1.0,), (0.0,), (-0.0,)], "x DOUBLE"))
    column = profile.columns["x"]
    assert (column.null_count, column.unique_count, column.negatives_count) == (2, 2, 0)


def test_constant_and_single_values(spark):
    column = profile_dataset(frame(spark, [(4.0,)], "x DOUBLE")).columns["x"]
    assert (column.std_val, column.mean_val, column.outliers_count) == (0.0, 4.0, 0)


def test_empty_table(spark):
    profile = profile_dataset(frame(spark, [], "a INT, b STRING"))
    assert (profile.quality.grade, profile.quality.overall_score) == ("Critical", 0.0)
    assert profile.quality.recommendations == ("Upload a non-empty dataset.",)
    assert profile.columns_frame().count() == 2


def test_partitioning_does_not_matter(spark):
    rows = [(i % 7, f"v{i % 11} ", i * 1.5) for i in range(500)]
    df = frame(spark, rows, "k INT, label STRING, price DOUBLE")
    one, many = profile_dataset(df.coalesce(1)), profile_dataset(df.repartition(9))
    assert one.quality == many.quality
    for name in df.columns:
        assert one.columns[name].top_values == many.columns[name].top_values
        assert one.columns[name].quality_issues == many.columns[name].quality_issues


@pytest.mark.parametrize("score, grade", [(89.9, "Good"), (90.0, "Excellent"), (75, "Good"), (60, "Fair"), (40, "Poor"), (39.9, "Critical")])
def test_grades(score, grade):
    assert grade_of(score)[0] == grade


def test_only_failing_checks_enlarge_the_base():
    score = quality_score(100, 4, 0, 0, 0, [0, 50, 0])
    assert score.validity_score == 50.0
    assert quality_score(100, 4, 0, 0, 0, []).recommendations == ("Dataset meets professional quality benchmarks.",)


def test_duplicates_are_compared_in_full(spark):
    rows = [(1, None), (1, None), (None, "a"), (None, "a"), (None, "a"), (2, "b")] + [(9, "hot")] * 50
    df = frame(spark, rows, "a INT, b STRING").repartition(4)
    assert tuple(duplicate_count(df).first()) == (56, 4, 52)
    assert tuple(duplicate_count(df.limit(0)).first()) == (0, 0, 0)


def test_samples_come_from_the_whole_column(spark):
    df = spark.range(1000).selectExpr("id", "CASE WHEN id >= 300 THEN concat('v', id) END AS late")
    assert profile_dataset(df).columns["late"].sample_values == ["v300", "v301", "v302", "v303", "v304"]


def test_dedupe_by_key(spark):
    df = frame(spark, [("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "k STRING, t INT, v STRING")
    assert sorted(map(tuple, dedupe_by_key(df, ["k"], ["t"], "first").collect())) == [("a", 1, "x"), ("b", 3, "z")]
    assert sorted(map(tuple, dedupe_by_key(df, ["k"], ["t"], "last").collect())) == [("a", 2, "y"), ("b", 3, "z")]
    with pytest.raises(ValueError):
        dedupe_by_key(df, ["k"], ["t"], "all")


def test_rows_stay_in_place_when_copies_are_sought(spark, monkeypatch):
    plans = []
    whole = duplicates.collapse_duplicates
    monkeypatch.setattr(duplicates, "collapse_duplicates", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or whole(df))
    found = duplicate_count(spark.range(1000).selectExpr("id % 900 AS id", "repeat('x', 50) AS text")).first()
    assert tuple(found) == (1000, 900, 100) and "strategy=broadcast" in plans[0]
