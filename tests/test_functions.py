"""Expressions against hand-written answers."""
import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkrinse.functions import dates, display, numbers, text


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_title_case_restarts_after_every_non_letter(spark):
    values = ["wi-fi 3rd o'neil", "PayPal", "cash on delivery", "USA_east", "", None, "中a"]
    wanted = [v.title() if v is not None else None for v in values]
    assert column(spark, values, text.title_case) == wanted


def test_spaces_are_unicode(spark):
    values = ["  a b\t\nc ", "plain", "  ", "\x1cx", None]
    assert column(spark, values, text.squeeze_spaces) == ["a b c", "plain", "", "x", None]
    assert column(spark, values, text.trim_spaces) == ["a b\t\nc", "plain", "", "x", None]
    assert column(spark, ["a  b", "a b", " a", "a  b"], text.has_space_defect) == [True, False, True, True]


def test_emails(spark):
    values = [" user@example.com ", "name@com", "missing_domain@", "a.b+c@x-y.co.uk", "a b@x.org", None]
    assert column(spark, values, text.is_email) == [True, False, False, True, False, None]


def test_known_terms_keep_unknown_text(spark):
    got = column(spark, [" CC ", "gift", None], lambda c: text.translate_terms(c, {"cc": "Credit Card"}))
    assert got == ["Credit Card", "gift", None]


def test_numbers_in_text(spark):
    values = ["1,234", " 5 ", "1e3", "inf", "5d", "0x10", "0x1p3", "nan", "", "+3", ".5", "5.", "1_000", "-7", None]
    wanted = [None, 5.0, 1000.0, float("inf"), None, None, None, None, None, 3.0, 0.5, 5.0, None, -7.0, None]
    assert column(spark, values, lambda c: numbers.to_number(c, T.StringType())) == wanted


def test_nan_is_no_number(spark):
    got = column(spark, [float("nan"), 1.5, None], lambda c: numbers.to_number(c, T.DoubleType()), "double")
    assert got == [None, 1.5, None]


def test_whole_numbers(spark):
    values = [1.0, 1.5, float("inf"), 1e19, -0.0]
    assert column(spark, values, numbers.is_whole, "double") == [True, False, False, False, True]


@pytest.mark.parametrize(
    "raw, wanted",
    [
        ("2024-02-03", (2024, 2, 3)),
        ("03/02/2024", (2024, 2, 3)),
        ("2024.02.03", (2024, 2, 3)),
        ("2024/2/3", (2024, 2, 3)),
        (" 3.2.2024 ", (2024, 2, 3)),
        ("Feb 03, 2024", (2024, 2, 3)),
        ("3 February 2024", (2024, 2, 3)),
        ("12/31/2024", (2024, 12, 31)),
        ("3/2/24", (2024, 2, 3)),
        ("3/2/75", (1975, 2, 3)),
        ("2024-02-03 04:05:06", (2024, 2, 3)),
        ("2024-02-03T04:05:06", (2024, 2, 3)),
        ("2024-02-31", None),
        ("31/02/2024", None),
        ("20240203", None),
        ("2024-02", None),
        ("2024-02-03 later", None),
        ("x", None),
        ("", None),
    ],
)
def test_dates(spark, raw, wanted):
    got = column(spark, [raw], lambda c: dates.parse_date(c, T.StringType()))[0]
    assert got == (datetime.date(*wanted) if wanted else None)


def test_date_formats_can_be_restricted(spark):
    got = column(spark, ["03/02/2024", "2024-02-03"], lambda c: dates.parse_date(c, T.StringType(), ["M/d/yyyy"]))
    assert got == [datetime.date(2024, 3, 2), None]


def test_target_formats():
    assert dates.java_pattern("%Y-%m-%dT%H:%M") == "yyyy-MM-dd'T'HH:mm"
    with pytest.raises(ValueError):
        dates.java_pattern("%Q")


def test_display(spark):
    values = [1_234_567.0, 1234.5, 1234.0, 12.0, 12.345, -0.5, None]
    assert column(spark, values, display.show_number, "double") == ["1.23M", "1,234.50", "1,234", "12", "12.35", "-0.50", "N/A"]
    assert column(spark, [1234.5, 2e6, None], display.show_currency, "double") == ["$1,234.50", "$2.00M", "N/A"]
    assert column(spark, [12.34, None], display.show_percent, "double") == ["12.3%", "0.0%"]
    assert column(spark, [4096.0, 12.0, 5 * 1024.0**3, None], display.show_bytes, "double") == ["4.0 KB", "12.0 B", "5.0 GB", "0 B"]


def test_order_of_formats_decides_between_readings(spark):
    formats = ["d/M/yyyy", "M-d-yyyy", "M/d/yyyy", "d-M-yyyy"]
    got = column(spark, ["3/2/2024", "3-2-2024", "3/13/2024", "13-3-2024"], lambda c: dates.parse_date(c, T.StringType(), formats))
    assert got == [datetime.date(2024, *md) for md in ((2, 3), (3, 2), (3, 13), (3, 13))]
    assert [len(g) for g in dates._merged(dates.DATE_FORMATS)] == [4, 3, 1, 1, 1, 1, 1]
