"""Each cleaning step on its own, then whole cleaning runs with their audit and summary."""
from __future__ import annotations

from pyspark.sql import functions as F

from sparkrinse import schema
from sparkrinse.functions import dates as dt
from sparkrinse.functions import text as tx
from sparkrinse.operators import reports, validate
from sparkrinse.plans.cleaning import clean
from sparkrinse.plans.config import CleaningConfig
from sparkrinse.plans.steps import SYNONYMS
from workload.dirty_sales import (
    COLUMNS, TEXT_COLUMNS, day_of, dirty_sales, squeezed, stored_sales, title_of, union_all, with_dirty,
)
from workload.registry import query, table

ROW = ", ".join(COLUMNS)
# Every step switched off; single-step queries turn on one.
IDLE = dict(
    remove_duplicates=False, num_missing_strategy="leave_unchanged", cat_missing_strategy="leave_unchanged",
    strip_whitespace=False, normalize_internal_spaces=False, casing_strategy="preserve",
    standardize_known_categories=False, auto_convert_types=False, standardize_dates=False, fix_negative_values=False,
)


def only(**options) -> CleaningConfig:
    return CleaningConfig(**{**IDLE, **options})


def replaced(relation: str = "dirty_sales", **columns: str) -> str:
    """SELECT of a whole row with some columns recomputed."""
    return "SELECT " + ", ".join(f"{columns[c]} AS {c}" if c in columns else c for c in COLUMNS) + f" FROM {relation}"


# E-mail columns are trimmed and lowered in every run, whatever the options.
EMAIL_STEP = "lower(trim(customer_email))"


def stepped(relation: str = "dirty_sales", **columns: str) -> str:
    return replaced(relation, **{"customer_email": EMAIL_STEP, **columns})


# ---- text ----------------------------------------------------------------------------------------

@query("clean_whitespace", with_dirty("SELECT order_id, " + ", ".join(f"{squeezed(c)} AS {c}" for c in TEXT_COLUMNS) + " FROM dirty_sales"))
def clean_whitespace(spark, folder):
    df = dirty_sales(spark, folder)
    return df.select("order_id", *[tx.squeeze_spaces(schema.col(c)).alias(c) for c in TEXT_COLUMNS])


@query("clean_email", with_dirty("SELECT order_id, lower(trim(customer_email)) AS customer_email FROM dirty_sales"))
def clean_email(spark, folder):
    return dirty_sales(spark, folder).select(
        "order_id", F.lower(tx.trim_spaces(F.col("customer_email"))).alias("customer_email")
    )


# What each spelling stands for, written out apart from the library's own list.
TERMS = {
    "payment": """WHEN 'credit card' THEN 'Credit Card' WHEN 'credit_card' THEN 'Credit Card' WHEN 'cc' THEN 'Credit Card'
    WHEN 'paypal' THEN 'PayPal' WHEN 'pay-pal' THEN 'PayPal' WHEN 'bank transfer' THEN 'Bank Transfer'
    WHEN 'bank_transfer' THEN 'Bank Transfer' WHEN 'wire' THEN 'Bank Transfer' WHEN 'wire transfer' THEN 'Bank Transfer'
    WHEN 'cash on delivery' THEN 'Cash on Delivery' WHEN 'cod' THEN 'Cash on Delivery' WHEN 'debit card' THEN 'Debit Card'
    WHEN 'debit_card' THEN 'Debit Card' WHEN 'debit' THEN 'Debit Card'""",
    "status": """WHEN 'completed' THEN 'Completed' WHEN 'complete' THEN 'Completed' WHEN 'shipped' THEN 'Shipped'
    WHEN 'pending' THEN 'Pending' WHEN 'cancelled' THEN 'Cancelled' WHEN 'canceled' THEN 'Cancelled' WHEN 'refunded' THEN 'Refunded'""",
}


def mapped(column: str, domain: str) -> str:
    return f"CASE lower(trim({column})) {TERMS[domain]} ELSE {column} END"


@query(
    "clean_synonyms",
    with_dirty(f"SELECT order_id, {mapped('payment_method', 'payment')} AS payment_method, "
               f"{mapped('order_status', 'status')} AS order_status FROM dirty_sales"),
)
def clean_synonyms(spark, folder):
    return dirty_sales(spark, folder).select(
        "order_id",
        tx.translate_terms(F.col("payment_method"), SYNONYMS["payment"]).alias("payment_method"),
        tx.translate_terms(F.col("order_status"), SYNONYMS["status"]).alias("order_status"),
    )


CASED = ("customer_name", "product", "category", "region", "payment_method", "order_status")


def _register_casing(style: str, render) -> None:
    sql = with_dirty("SELECT order_id, " + ", ".join(f"{render(c)} AS {c}" for c in CASED) + " FROM dirty_sales")

    @query(f"clean_{style}", sql)
    def cased(spark, folder):
        df = dirty_sales(spark, folder)
        return df.select("order_id", *[tx.recase(schema.col(c), style).alias(c) for c in CASED])


_register_casing("title", title_of)
_register_casing("lower", lambda c: f"lower({c})")
_register_casing("upper", lambda c: f"upper({c})")


# ---- numbers -------------------------------------------------------------------------------------

@query("fix_negatives", with_dirty(stepped(quantity="abs(quantity)", unit_price="abs(unit_price)")))
def fix_negatives(spark, folder):
    return clean(stored_sales(spark, folder), only(fix_negative_values=True)).cleaned


def fences(relation: str, columns: tuple[str, ...]) -> str:
    """CTE with fences and median of each column."""
    inner = ", ".join(
        f"quantile_cont({c}::DOUBLE, 0.25) AS {c}_a, quantile_cont({c}::DOUBLE, 0.75) AS {c}_b, quantile_cont({c}::DOUBLE, 0.5) AS {c}_m"
        for c in columns
    )
    outer = ", ".join(
        f"{c}_a - 1.5 * ({c}_b - {c}_a) AS {c}_low, {c}_b + 1.5 * ({c}_b - {c}_a) AS {c}_high, {c}_m" for c in columns
    )
    return f"fence AS (SELECT {outer} FROM (SELECT {inner} FROM {relation}))"


LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "cap_iqr",
    with_dirty(
        stepped(
            "dirty_sales, fence", quantity="round(CASE WHEN quantity IS NOT NULL THEN greatest(least(quantity, quantity_high), quantity_low) END, 6)",
            unit_price="round(CASE WHEN unit_price IS NOT NULL THEN greatest(least(unit_price, unit_price_high), unit_price_low) END, 6)",
        ),
        fences("dirty_sales", ("quantity", "unit_price")),
    ),
)
def cap_iqr(spark, folder):
    return _rounded(clean(stored_sales(spark, folder), only(outlier_strategy="cap_iqr")).cleaned)


def _rounded(df, scale: int = 6):
    return df.select(
        *[F.round(schema.col(f.name), scale).alias(f.name) if schema.is_float(f.dataType) else f.name for f in df.schema.fields]
    )


def _median_instead(c: str) -> str:
    return f"round(CASE WHEN {c} < {c}_low OR {c} > {c}_high THEN {c}_m ELSE {c} END, 6)"


@query(
    "replace_outlier_median",
    with_dirty(
        stepped("dirty_sales, fence", quantity=_median_instead("quantity"), unit_price=_median_instead("unit_price")),
        fences("dirty_sales", ("quantity", "unit_price")),
    ),
)
def replace_outlier_median(spark, folder):
    return _rounded(clean(stored_sales(spark, folder), only(outlier_strategy="replace_median")).cleaned)


@query(
    "flag_outliers",
    with_dirty(
        "SELECT order_id, quantity, unit_price, " + ", ".join(
            f"{c} < {c}_low OR {c} > {c}_high AS {c}_is_outlier" for c in ("quantity", "unit_price")
        ) + " FROM dirty_sales, fence",
        fences("dirty_sales", ("quantity", "unit_price")),
    ),
)
def flag_outliers(spark, folder):
    columns = ["quantity", "unit_price"]
    return validate.flag_outliers(dirty_sales(spark, folder).select("order_id", *columns), columns)


@query(
    "cap_iqr_lineitem",
    "WITH " + fences("lineitem", LINE) + " SELECT l_orderkey, l_linenumber, " + ", ".join(
        f"round(greatest(least({c}, {c}_high), {c}_low), 6) AS {c}" for c in LINE
    ) + " FROM lineitem, fence",
)
def cap_iqr_lineitem(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", *LINE)
    return _rounded(clean(rows, only(outlier_strategy="cap_iqr")).cleaned)


# ---- dates ---------------------------------------------------------------------------------------

@query("standardize_dates", with_dirty(stepped(order_date=f"strftime({day_of('order_date')}, '%Y-%m-%d')")))
def standardize_dates(spark, folder):
    return clean(stored_sales(spark, folder), only(standardize_dates=True)).cleaned


@query("standardize_dates_as_date", with_dirty(stepped(order_date=day_of("order_date"))))
def standardize_dates_as_date(spark, folder):
    return clean(stored_sales(spark, folder), only(standardize_dates=True, as_date=True)).cleaned


@query(
    "date_target_format",
    with_dirty(stepped(order_date=f"strftime({day_of('order_date')}, '%d.%m.%y')")),
)
def date_target_format(spark, folder):
    options = only(standardize_dates=True, target_date_format="%d.%m.%y")
    return clean(stored_sales(spark, folder), options).cleaned


@query(
    "monthly_bucket",
    with_dirty(f"SELECT strftime({day_of('order_date')}, '%Y-%m') AS month, count(*) AS n FROM dirty_sales "
               f"WHERE {day_of('order_date')} IS NOT NULL GROUP BY 1"),
)
def monthly_bucket(spark, folder):
    df = dirty_sales(spark, folder)
    day = dt.parse_date(F.col("order_date"), df.schema["order_date"].dataType)
    return df.where(day.isNotNull()).groupBy(dt.month_of(day).alias("month")).agg(F.count(F.lit(1)).alias("n"))


# ---- missing values ------------------------------------------------------------------------------

def _fill_number(expression: str) -> str:
    return stepped(
        quantity=f"round(coalesce(quantity, {expression.format(c='quantity')}), 6)",
        unit_price=f"round(coalesce(unit_price, {expression.format(c='unit_price')}), 6)",
    )


_MODE = "(SELECT {c} FROM dirty_sales WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
_MEDIAN = "(SELECT quantile_cont({c}, 0.5) FROM dirty_sales)"


def _register_number_fill(strategy: str, expression: str) -> None:
    @query(f"impute_{strategy}", with_dirty(_fill_number(expression)))
    def imputed(spark, folder):
        return _rounded(clean(stored_sales(spark, folder), only(num_missing_strategy=strategy)).cleaned)


_register_number_fill("median", _MEDIAN)
_register_number_fill("mean", "(SELECT avg({c}) FROM dirty_sales)")
_register_number_fill("mode", _MODE)
_register_number_fill("zero", "0")


@query("impute_unknown", with_dirty(stepped(**{c: f"coalesce({EMAIL_STEP if c == 'customer_email' else c}, 'Unknown')" for c in TEXT_COLUMNS})))
def impute_unknown(spark, folder):
    return clean(stored_sales(spark, folder), only(cat_missing_strategy="unknown")).cleaned


@query(
    "impute_cat_mode",
    with_dirty(
        replaced("emailed", **{
            c: f"coalesce({c}, {_MODE.format(c=c).replace('dirty_sales', 'emailed')}, 'Unknown')" for c in TEXT_COLUMNS
        }),
        f"emailed AS ({stepped()})",
    ),
)
def impute_cat_mode(spark, folder):
    return clean(stored_sales(spark, folder), only(cat_missing_strategy="mode")).cleaned


@query(
    "impute_custom",
    with_dirty(stepped(
        quantity="coalesce(quantity, 0)", unit_price=f"round(coalesce(unit_price, {_MEDIAN.format(c='unit_price')}), 6)",
        category=f"coalesce(category, {_MODE.format(c='category')})", customer_name="coalesce(customer_name, 'Unknown')",
        order_date="coalesce(order_date, 'Unknown')",
    )),
)
def impute_custom(spark, folder):
    rules = {"quantity": "zero", "unit_price": "median", "category": "mode", "customer_email": "leave_unchanged"}
    options = only(cat_missing_strategy="unknown", custom_missing_rules=rules)
    return _rounded(clean(stored_sales(spark, folder), options).cleaned)


# ---- types ---------------------------------------------------------------------------------------

@query(
    "narrow_types",
    """SELECT l_orderkey AS line, l_quantity::BIGINT AS amount, l_discount, l_linenumber::BIGINT AS number_text,
    l_tax AS tax_text, l_returnflag, l_orderkey::VARCHAR AS id_text FROM lineitem""",
)
def narrow_types(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("line"),
        F.col("l_quantity").alias("amount"),
        "l_discount",
        F.col("l_linenumber").cast("string").alias("number_text"),
        F.col("l_tax").cast("string").alias("tax_text"),
        "l_returnflag",
        F.col("l_orderkey").cast("string").alias("id_text"),
    )
    return clean(rows, only(auto_convert_types=True)).cleaned


# ---- whole runs ----------------------------------------------------------------------------------

def cleaning_ctes(style: str = "title", numbers: str = "median") -> list[str]:
    """The default run in SQL: duplicates, text, signs, dates, fills, types."""
    render = {"title": title_of, "lower": lambda c: f"lower({c})", "upper": lambda c: f"upper({c})"}[style]
    spaced = {c: squeezed(c) for c in TEXT_COLUMNS if c not in ("order_date", "customer_email")}
    spaced["customer_email"] = f"lower({squeezed('customer_email')})"
    spaced["payment_method"] = mapped(spaced["payment_method"], "payment")
    spaced["order_status"] = mapped(spaced["order_status"], "status")
    limit = "(SELECT greatest(50, floor(count(*) * 0.1)) FROM spaced)"
    cased = {
        c: f"CASE WHEN (SELECT count(DISTINCT {c}) FROM spaced) < {limit} THEN {render(c)} ELSE {c} END" for c in CASED
    }
    dated = {
        "quantity": "abs(quantity)", "unit_price": "abs(unit_price)",
        "order_date": f"strftime({day_of('order_date')}, '%Y-%m-%d')",
    }
    fill = {"median": "(SELECT quantile_cont({c}, 0.5) FROM dated)", "mean": "(SELECT avg({c}) FROM dated)"}[numbers]
    filled = {c: f"coalesce({c}, 'Unknown')" for c in TEXT_COLUMNS}
    filled["quantity"] = f"coalesce(quantity, {fill.format(c='quantity')})"
    if numbers == "median":
        filled["quantity"] += "::BIGINT"
    filled["unit_price"] = f"round(coalesce(unit_price, {fill.format(c='unit_price')}), 6)"
    return [
        "single AS MATERIALIZED (SELECT DISTINCT * FROM dirty_sales)",
        f"spaced AS MATERIALIZED ({replaced('single', **spaced)})",
        f"cased AS MATERIALIZED ({replaced('spaced', **cased)})",
        f"dated AS MATERIALIZED ({replaced('cased', **dated)})",
        f"cleaned AS MATERIALIZED ({replaced('dated', **filled)})",
    ]


CLEANED = cleaning_ctes()


@query("clean_default", with_dirty(f"SELECT {ROW} FROM cleaned", *CLEANED))
def clean_default(spark, folder):
    return _rounded(clean(dirty_sales(spark, folder)).cleaned)


@query("clean_lower_mean", with_dirty(f"SELECT {ROW.replace('quantity', 'round(quantity, 6) AS quantity')} FROM cleaned", *cleaning_ctes("lower", "mean")))
def clean_lower_mean(spark, folder):
    options = CleaningConfig(casing_strategy="lower", num_missing_strategy="mean")
    return _rounded(clean(dirty_sales(spark, folder), options).cleaned)


@query("clean_orders", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, "
       f"{title_of('o_orderpriority')} AS o_orderpriority FROM orders")
def clean_orders(spark, folder):
    return clean(table(spark, folder, "orders")).cleaned


def audit_sql() -> str:
    spaced = {c: squeezed(c) for c in TEXT_COLUMNS if c != "order_date"}
    lines = [
        """SELECT 0 AS stage, 0 AS place, 'Duplicate Removal' AS operation, 'All Columns' AS "column",
        (SELECT count(*) FROM dirty_sales) - (SELECT count(*) FROM single) AS records_affected"""
    ]
    text = []
    for at, c in enumerate(TEXT_COLUMNS[1:], start=1):
        text.append((at, 0, "Whitespace Normalization", c, f"count(*) FILTER ({c} <> {spaced[c]}) FROM single"))
        if c == "customer_email":
            text.append((at, 1, "Email Standardization", c, f"count(*) FILTER ({spaced[c]} <> lower({spaced[c]})) FROM single"))
            continue
        domain = {"payment_method": "payment", "order_status": "status"}.get(c)
        if domain:
            text.append((at, 1, "Categorical Synonym Standardization", c,
                         f"count(*) FILTER ({spaced[c]} <> {mapped(spaced[c], domain)}) FROM single"))
        limit = "(SELECT greatest(50, floor(count(*) * 0.1)) FROM spaced)"
        text.append((at, 2, "Text Casing Normalization", c,
                     f"count(*) FILTER ({c} <> {title_of(c)} AND (SELECT count(DISTINCT {c}) FROM spaced) < {limit}) FROM spaced"))
    for at, sub, operation, c, count in text:
        lines.append(f"SELECT 1 AS stage, {at * 10 + sub} AS place, '{operation}' AS operation, '{c}' AS \"column\", {count}")
    for at, c in enumerate(("quantity", "unit_price")):
        lines.append(f"SELECT 2, {at}, 'Negative Value Correction', '{c}', count(*) FILTER ({c} < 0) FROM single")
    lines.append(f"SELECT 3, 0, 'Date Standardization', 'order_date', count({day_of('order_date')}) FROM single")
    for at, c in enumerate(COLUMNS):
        lines.append(f"SELECT 4, {at}, 'Missing Value Imputation', '{c}', count(*) - count({c}) FROM dated")
    lines.append("SELECT 5, 0, 'Data Type Conversion', 'quantity', count(*) FROM single")
    return f"""SELECT row_number() OVER (ORDER BY stage, place)::INTEGER AS step, operation, "column", records_affected
    FROM ({union_all(lines)}) WHERE records_affected > 0"""


AUDIT = with_dirty(audit_sql(), *CLEANED)


@query("audit_log", AUDIT)
def audit_log(spark, folder):
    return clean(dirty_sales(spark, folder)).audit_frame().drop("ts", "description")


@query(
    "audit_descriptions",
    with_dirty(
        """SELECT "column", 'Imputed ' || n || ' missing entries ' || how AS description FROM (
        SELECT 'quantity' AS "column", count(*) - count(quantity) AS n,
          'using column Median (' || printf('%.2f', quantile_cont(quantity, 0.5)) || ')' AS how FROM dated
        UNION ALL SELECT 'unit_price', count(*) - count(unit_price),
          'using column Median (' || printf('%.2f', quantile_cont(unit_price, 0.5)) || ')' FROM dated
        UNION ALL SELECT 'category', count(*) - count(category), 'with category ''Unknown''' FROM dated) WHERE n > 0""",
        *CLEANED,
    ),
)
def audit_descriptions(spark, folder):
    log = reports.printed_audit(clean(dirty_sales(spark, folder)).audit_frame(), rows=100)
    wanted = (F.col("operation") == "Missing Value Imputation") & F.col("column").isin("quantity", "unit_price", "category")
    return log.where(wanted).select("column", "description")


@query("printed_audit", AUDIT.replace("WHERE records_affected > 0", "WHERE records_affected > 0 QUALIFY step <= 15"))
def printed_audit(spark, folder):
    return reports.printed_audit(clean(dirty_sales(spark, folder)).audit_frame()).drop("ts", "description")


def missing_cells(relation: str) -> str:
    return "(SELECT " + " + ".join(f"count(*) - count({c})" for c in COLUMNS) + f" FROM {relation})"


@query(
    "cleaning_summary",
    with_dirty(
        f"""SELECT (SELECT count(*) FROM dirty_sales) AS rows_before, 11::BIGINT AS columns_before,
        {missing_cells('dirty_sales')} AS missing_before,
        (SELECT count(*) FROM dirty_sales) - (SELECT count(*) FROM single) AS duplicates_before,
        (SELECT count(*) FROM cleaned) AS rows_after, 11::BIGINT AS columns_after, {missing_cells('cleaned')} AS missing_after,
        (SELECT count(*) FROM cleaned) - (SELECT count(*) FROM (SELECT DISTINCT * FROM cleaned)) AS duplicates_after,
        (SELECT count(*) FROM dirty_sales) - (SELECT count(*) FROM cleaned) AS records_removed,
        {missing_cells('dirty_sales')} - {missing_cells('cleaned')} AS missing_cells_imputed,
        (SELECT count(*) FROM log) AS total_operations""",
        *CLEANED, f"log AS ({audit_sql()})",
    ),
)
def cleaning_summary(spark, folder):
    return clean(dirty_sales(spark, folder)).summary_frame()


@query("data_extract", with_dirty(f"SELECT {ROW} FROM cleaned ORDER BY {ROW} LIMIT 10000", *CLEANED))
def data_extract(spark, folder):
    return reports.data_extract(_rounded(clean(dirty_sales(spark, folder)).cleaned), COLUMNS)
