"""A sales table with planted defects, derived from the given tables by plain joins."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrinse.staging import stage
from workload.registry import table

TEXT_COLUMNS = (
    "order_date", "customer_name", "customer_email", "product", "category", "region", "payment_method",
    "order_status",
)
NUMBER_COLUMNS = ("order_id", "quantity", "unit_price")
COLUMNS = ("order_id", *TEXT_COLUMNS, "quantity", "unit_price")


def _every(key: str, n: int) -> Column:
    return F.col(key) % n == 0


def dirty_sales(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order line, every fortieth kind of line twice.

    The dimension tables are joined without hints: the optimizer broadcasts them while their size
    allows it and sorts and merges beyond that.
    """
    lines, orders, customers, parts, nations, regions = (
        table(spark, folder, name) for name in ("lineitem", "orders", "customer", "part", "nation", "region")
    )
    joined = (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    key, customer = F.col("l_orderkey"), F.col("c_custkey").cast("string")
    sold = F.col("o_orderdate")
    selected = joined.select(
        (key * 10 + F.col("l_linenumber")).alias("order_id"),
        F.when(_every("l_orderkey", 17), None)
        .when(_every("l_orderkey", 19), "invalid_date")
        .when(_every("l_orderkey", 23), "2024-02-31")
        .when(key % 3 == 1, F.date_format(sold, "dd/MM/yyyy"))
        .when(key % 3 == 2, F.date_format(sold, "yyyy.MM.dd"))
        .otherwise(F.date_format(sold, "yyyy-MM-dd"))
        .alias("order_date"),
        F.when(~_every("c_custkey", 29), F.col("c_name")).alias("customer_name"),
        F.when(_every("c_custkey", 13), None)
        .when(F.col("c_custkey") % 13 == 1, F.concat(F.lit("name"), customer, F.lit("@com")))
        .when(F.col("c_custkey") % 13 == 2, "missing_domain@")
        .when(F.col("c_custkey") % 13 == 3, F.concat(F.lit(" USER"), customer, F.lit("@Example.COM ")))
        .otherwise(F.concat(F.lit("user"), customer, F.lit("@example.com")))
        .alias("customer_email"),
        F.when(F.col("l_partkey") % 7 == 0, F.upper("p_name"))
        .when(F.col("l_partkey") % 7 == 1, F.concat(F.lit("  "), "p_name"))
        .when(F.col("l_partkey") % 7 == 2, F.replace("p_name", F.lit(" "), F.lit("   ")))
        .otherwise(F.col("p_name"))
        .alias("product"),
        F.when(_every("l_partkey", 31), None)
        .when(_every("l_partkey", 5), F.lower("p_type"))
        .otherwise(F.col("p_type"))
        .alias("category"),
        F.when(_every("c_nationkey", 4), F.lower("r_name")).otherwise(F.col("r_name")).alias("region"),
        F.element_at(
            F.array(*[F.lit(m) for m in ("cc", "COD", "wire", "credit_card", "pay-pal", " Debit ", "Bank Transfer")]),
            (F.col("l_linenumber") % 7 + 1).cast("int"),
        ).alias("payment_method"),
        F.when(F.col("o_orderstatus") == "F", "complete")
        .when(F.col("o_orderstatus") == "O", "PENDING")
        .otherwise("canceled")
        .alias("order_status"),
        F.when(_every("l_orderkey", 37), None)
        .when(_every("l_orderkey", 41), -F.col("l_quantity"))
        .otherwise(F.col("l_quantity"))
        .alias("quantity"),
        F.when(_every("l_orderkey", 43), None)
        .when(_every("l_orderkey", 47), -F.col("p_retailprice"))
        .when(_every("l_orderkey", 53), F.col("p_retailprice") * 100)
        .otherwise(F.col("p_retailprice"))
        .alias("unit_price"),
    )
    copies = F.when(F.col("order_id") % 40 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return selected.withColumn("copy", F.explode(copies)).drop("copy")


def stored_sales(spark: SparkSession, folder: str) -> DataFrame:
    """The same table written once, for operators that read their input several times."""
    return stage(dirty_sales(spark, folder), "dirty-sales", small_tasks=True)


# The same table for the checking engine, as the first entry of a WITH clause.
DIRTY_SALES = """
dirty_sales AS MATERIALIZED (SELECT * EXCLUDE (dup) FROM (SELECT
    l.l_orderkey * 10 + l.l_linenumber AS order_id,
    CASE WHEN l.l_orderkey % 17 = 0 THEN NULL
         WHEN l.l_orderkey % 19 = 0 THEN 'invalid_date'
         WHEN l.l_orderkey % 23 = 0 THEN '2024-02-31'
         WHEN l.l_orderkey % 3 = 1 THEN strftime(o.o_orderdate, '%d/%m/%Y')
         WHEN l.l_orderkey % 3 = 2 THEN strftime(o.o_orderdate, '%Y.%m.%d')
         ELSE strftime(o.o_orderdate, '%Y-%m-%d') END AS order_date,
    CASE WHEN c.c_custkey % 29 = 0 THEN NULL ELSE c.c_name END AS customer_name,
    CASE WHEN c.c_custkey % 13 = 0 THEN NULL
         WHEN c.c_custkey % 13 = 1 THEN 'name' || c.c_custkey || '@com'
         WHEN c.c_custkey % 13 = 2 THEN 'missing_domain@'
         WHEN c.c_custkey % 13 = 3 THEN ' USER' || c.c_custkey || '@Example.COM '
         ELSE 'user' || c.c_custkey || '@example.com' END AS customer_email,
    CASE WHEN l.l_partkey % 7 = 0 THEN upper(p.p_name)
         WHEN l.l_partkey % 7 = 1 THEN '  ' || p.p_name
         WHEN l.l_partkey % 7 = 2 THEN replace(p.p_name, ' ', '   ')
         ELSE p.p_name END AS product,
    CASE WHEN l.l_partkey % 31 = 0 THEN NULL
         WHEN l.l_partkey % 5 = 0 THEN lower(p.p_type) ELSE p.p_type END AS category,
    CASE WHEN c.c_nationkey % 4 = 0 THEN lower(r.r_name) ELSE r.r_name END AS region,
    CASE l.l_linenumber % 7 WHEN 0 THEN 'cc' WHEN 1 THEN 'COD' WHEN 2 THEN 'wire' WHEN 3 THEN 'credit_card'
         WHEN 4 THEN 'pay-pal' WHEN 5 THEN ' Debit ' ELSE 'Bank Transfer' END AS payment_method,
    CASE o.o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'PENDING' ELSE 'canceled' END AS order_status,
    CASE WHEN l.l_orderkey % 37 = 0 THEN NULL WHEN l.l_orderkey % 41 = 0 THEN -l.l_quantity
         ELSE l.l_quantity END AS quantity,
    CASE WHEN l.l_orderkey % 43 = 0 THEN NULL WHEN l.l_orderkey % 47 = 0 THEN -p.p_retailprice
         WHEN l.l_orderkey % 53 = 0 THEN p.p_retailprice * 100 ELSE p.p_retailprice END AS unit_price,
    k.dup
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
    JOIN customer c ON o.o_custkey = c.c_custkey JOIN part p ON l.l_partkey = p.p_partkey
    JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
    CROSS JOIN (VALUES (0), (1)) k(dup)
  WHERE k.dup = 0 OR (l.l_orderkey * 10 + l.l_linenumber) % 40 = 1))
"""


def with_dirty(body: str, *ctes: str) -> str:
    """A statement over ``dirty_sales``; further named queries may come in between."""
    return "WITH " + ",\n".join([DIRTY_SALES.strip(), *ctes]) + "\n" + body


def day_of(column: str) -> str:
    """The date a text spells, NULL when none."""
    formats = ("%Y-%m-%d", "%d/%m/%Y", "%Y.%m.%d")
    return "coalesce(" + ", ".join(f"try_strptime({column}, '{f}')" for f in formats) + ")::DATE"


def title_of(column: str) -> str:
    runs = f"regexp_extract_all({column}, '[A-Za-z]+|[^A-Za-z]+')"
    return f"array_to_string(list_transform({runs}, lambda w: upper(w[1]) || lower(w[2:])), '')"


def squeezed(column: str) -> str:
    return f"trim(regexp_replace({column}, '\\s+', ' ', 'g'))"


EMAIL = "[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+"


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)
