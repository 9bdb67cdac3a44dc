import pytest
from pyspark.sql import functions as F

from sparkrinse.plans import cleaning
from sparkrinse.plans.cleaning import CleaningPlan, clean, fit, trim_headers
from sparkrinse.plans.config import CleaningConfig
from workload.dirty_sales import dirty_sales

FOLDER = "/root/testdata/sf0.001"


def only_column(result, name):
    return [r[0] for r in result.cleaned.select(f"`{name}`").collect()]


def frame(spark, values, kind, name="v"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, {name} {kind}")


def cleaned(spark, values, kind, name="v", **options):
    result = clean(frame(spark, values, kind, name), CleaningConfig(**options))
    return [r[name] for r in result.cleaned.orderBy("i").collect()], result


def test_invariants_of_a_default_run(spark):
    raw = dirty_sales(spark, FOLDER)
    result = clean(raw)
    rows = result.cleaned.cache()
    assert rows.count() == raw.distinct().count() == result.rows_after
    left = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in rows.columns]).first()
    assert sum(left) == 0 == result.missing_after
    assert rows.where("quantity < 0 OR unit_price < 0").isEmpty()
    again = clean(rows, CleaningConfig(remove_duplicates=False))
    second = {e.operation: e.records_affected for e in again.audit}
    assert not {"Whitespace Normalization", "Negative Value Correction"} & set(second)
    # e-mail columns are always lowered, so a second run changes the filled values and nothing else
    assert second["Email Standardization"] == rows.where("customer_email = 'Unknown'").count()
    # title case undid some canonical terms; they are mapped and recased once more, to the same result
    assert second["Categorical Synonym Standardization"] == second["Text Casing Normalization"]
    assert again.cleaned.drop("customer_email").exceptAll(rows.drop("customer_email")).isEmpty()
    rows.unpersist()


def test_plan_survives_json_and_new_data(spark):
    df = frame(spark, ["  a b ", "A  B", None], "STRING", "label")
    plan = CleaningPlan.from_json(fit(df).to_json())
    new = frame(spark, [" c   d "], "STRING", "label")
    assert [r["label"] for r in plan.apply(new).collect()] == ["C D"]


def test_partitioning_does_not_matter(spark):
    raw = dirty_sales(spark, FOLDER)
    one = clean(raw.coalesce(1), CleaningConfig(outlier_strategy="cap_iqr"))
    many = clean(raw.repartition(7), CleaningConfig(outlier_strategy="cap_iqr"))
    assert one.plan.to_json() == many.plan.to_json()
    assert [e.__dict__ for e in one.audit] == [e.__dict__ for e in many.audit]


@pytest.mark.parametrize("spellings, changed", [(49, True), (50, False), (51, False)])
def test_casing_gate_is_strict(spark, spellings, changed):
    got, _ = cleaned(spark, [f"item {chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(spellings)] * 2, "STRING")
    assert all(v.startswith("Item") for v in got) == changed


@pytest.mark.parametrize("bad, parsed", [(2, True), (3, False)])
def test_half_the_dates_must_be_readable(spark, bad, parsed):
    got, _ = cleaned(spark, ["03/02/2024", "04/02/2024"] + ["x"] * bad, "STRING", "sold_date")
    assert (got[0] == "2024-02-03") == parsed
    assert got[-1] == ("Unknown" if parsed else "x")


@pytest.mark.parametrize("count, capped", [(10, False), (11, True)])
def test_outliers_need_more_than_ten_values(spark, count, capped):
    got, _ = cleaned(spark, [float(i) for i in range(count - 1)] + [1000.0], "DOUBLE", outlier_strategy="cap_iqr")
    assert (max(got) < 1000) == capped


def test_fills(spark):
    assert cleaned(spark, [3.0, None, 1.0, 2.5], "DOUBLE")[0] == [3.0, 2.5, 1.0, 2.5]
    assert cleaned(spark, [10, None, 9, 9, 10], "INT", num_missing_strategy="mode")[0][1] == 9
    assert cleaned(spark, ["b", None, "a"], "STRING", cat_missing_strategy="mode", casing_strategy="preserve")[0][1] == "a"
    got, result = cleaned(spark, [None, None], "DOUBLE")
    assert got == [None, None] and not result.audit
    assert cleaned(spark, [True, None], "BOOLEAN")[0] == ["True", "Unknown"]
    assert cleaned(spark, [1, 2, None], "BIGINT")[0] == [1.0, 2.0, 1.5]


def test_types(spark):
    got, result = cleaned(spark, ["1", "2.0", " 3 "], "STRING")
    assert got == [1, 2, 3] and result.cleaned.schema["v"].dataType.simpleString() == "bigint"
    _, result = cleaned(spark, ["1", None], "STRING")
    assert result.cleaned.schema["v"].dataType.simpleString() == "string"
    _, result = cleaned(spark, ["1", "2"], "STRING", "paid_status")
    assert result.cleaned.schema["paid_status"].dataType.simpleString() == "string"
    _, result = cleaned(spark, [1.0, float("inf")], "DOUBLE")
    assert result.cleaned.schema["v"].dataType.simpleString() == "double"


def test_canonical_terms_are_recased(spark):
    got, _ = cleaned(spark, ["pay-pal", "COD"], "STRING", "payment")
    assert got == ["Paypal", "Cash On Delivery"]
    got, _ = cleaned(spark, ["pay-pal", "COD"], "STRING", "payment", casing_strategy="preserve")
    assert got == ["PayPal", "Cash on Delivery"]


def test_headers(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a", " a", "b "])
    assert trim_headers(df).columns == ["a", "a_2", "b"]
    assert clean(df).audit[0].operation == "Column Header Standardization"


def test_nothing_to_do(spark):
    result = clean(spark.createDataFrame([(1, "A")], "k INT, label STRING"))
    assert [r["operation"] for r in result.audit_frame().collect()] == ["Quality Inspection"]


def test_nested_columns_pass_through(spark):
    result = clean(spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "k INT, v ARRAY<DOUBLE>"))
    assert set(map(str, only_column(result, "v"))) == {"None", "[1.0, 2.0]"}
    assert result.missing_after == 1


def test_options_are_checked(spark):
    with pytest.raises(ValueError):
        CleaningConfig(casing_strategy="camel")
    with pytest.raises(ValueError):
        CleaningConfig(custom_missing_rules={"a": "guess"})
    with pytest.raises(ValueError):
        clean(frame(spark, [1], "INT"), CleaningConfig(custom_missing_rules={"v": "unknown"}))


def test_texts_of_few_values_are_looked_up(spark, monkeypatch):
    rows = [(i, [" a  b ", "C d", None, "é-x 3rd"][i % 4], ["2024-01-05", "05/02/2023", "never", None][i % 4], -1.5) for i in range(80)]
    df = spark.createDataFrame(rows, "row_id BIGINT, category STRING, order_date STRING, price DOUBLE")
    result = clean(df)
    shown = result.cleaned._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in shown and "Join" in shown
    found = sorted(map(tuple, result.cleaned.collect()))
    assert found == sorted(map(tuple, result.plan.apply(df).collect()))
    monkeypatch.setattr(cleaning, "LOOKED_UP", 0)
    assert found == sorted(map(tuple, clean(df).cleaned.collect()))
    assert found[3][1:] == ("É-X 3Rd", "Unknown", 1.5) and found[0][1:] == ("A B", "2024-01-05", 1.5)


def test_whole_numbers_without_gaps_are_not_listed(spark):
    df = spark.createDataFrame([(i, -i, None if i % 3 else i, "x") for i in range(30)], "id BIGINT, quantity BIGINT, sales BIGINT, text STRING")
    fitting = cleaning._Fitting(df, CleaningConfig())
    result = fitting.run()
    assert {r[0] for r in fitting.values.select("column_name").distinct().collect()} == {"sales", "text"}
    negatives = [e.records_affected for e in result.audit if e.operation == "Negative Value Correction" and e.column == "quantity"]
    assert negatives == [29] and result.rows_after == 30 and result.missing_after == 0
    assert sorted(r["quantity"] for r in result.cleaned.collect()) == list(range(30))
