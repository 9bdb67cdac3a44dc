import pytest

from sparkrinse.operators.semantics import detect_semantics, normalize_name


def roles(*columns, **overrides):
    return {k: v for k, v in detect_semantics(columns, overrides).items() if v}


def test_names_are_normalised():
    assert normalize_name(" Order Date! ") == "order_date"


def test_sales_table():
    found = detect_semantics(
        ["order_id", "order_date", "customer_name", "customer_email", "product", "category", "region",
         "payment_method", "order_status", "quantity", "unit_price"]
    )
    assert found.is_sales_dataset
    assert (found.price, found.quantity, found.sales) == ("unit_price", "quantity", None)
    assert (found.date, found.customer, found.email) == ("order_date", "customer_name", "customer_email")
    assert (found.payment, found.status) == ("payment_method", "order_status")


def test_given_tables():
    assert roles("l_quantity", "l_extendedprice", "l_linestatus", "l_shipdate") == {
        "price": "l_extendedprice", "quantity": "l_quantity", "date": "l_shipdate", "status": "l_linestatus",
    }
    assert roles("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority") == {
        "price": "o_totalprice", "date": "o_orderdate", "status": "o_orderstatus",
    }
    assert roles("event_id", "ts", "user_id", "event_type", "value", "props") == {"quantity": "ts", "category": "event_type"}
    assert roles("r_regionkey", "r_name") == {"region": "r_regionkey", "customer": "r_name"}
    assert roles("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment") == {}


def test_overrides():
    assert detect_semantics(["ts", "event_type"], {"quantity": None, "date": "ts"}).date == "ts"
    with pytest.raises(ValueError):
        detect_semantics(["a"], {"colour": "a"})
