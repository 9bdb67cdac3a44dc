"""Business figures, statistics, chart data, report tables, sources and sinks."""
from __future__ import annotations

from pyspark.sql import functions as F

from sparkrinse import schema
from sparkrinse.functions import display
from sparkrinse.operators import analytics, charts, reports
from sparkrinse.operators.profile import profile_dataset
from sparkrinse.operators.semantics import detect_semantics
from sparkrinse.plans.cleaning import clean, fit
from sparkrinse.plans.report import build_report
from sparkrinse.sources.metadata import dataset_metadata as metadata_of
from sparkrinse.sources.readers import detect_delimiter, detect_encoding, read_dataset
from sparkrinse.sources.writers import publish_report, read_manifest, read_report, write_audit, write_table
from sparkrinse.staging import fresh_path, stage
from sparkrinse.streaming.clean_stream import clean_stream
from workload.cleaning import AUDIT, CLEANED, missing_cells
from workload.dirty_sales import COLUMNS, dirty_sales, stored_sales, union_all, with_dirty
from workload.profiling import DIRTY_PROFILE, SCORE, day_of, profile_ctes, score_ctes
from workload.registry import query, table

ROLES = detect_semantics(COLUMNS)
MONEY = "coalesce(unit_price, 0) * coalesce(quantity, 0)"


# ---- business figures ----------------------------------------------------------------------------

@query(
    "kpi_sales",
    with_dirty(f"""SELECT round(sum({MONEY}), 2) AS total_revenue, round(avg({MONEY}), 2) AS avg_order_value,
    trunc(sum(coalesce(quantity, 0)))::BIGINT AS total_quantity, count(*) AS total_orders,
    count(DISTINCT customer_name) AS unique_customers FROM dirty_sales"""),
)
def kpi_sales(spark, folder):
    return analytics.sales_totals(dirty_sales(spark, folder), ROLES)


@query(
    "kpi_lineitem",
    """SELECT round(sum(l_extendedprice * l_quantity), 2) AS total_revenue,
    round(avg(l_extendedprice * l_quantity), 2) AS avg_order_value, sum(l_quantity)::BIGINT AS total_quantity,
    count(*) AS total_orders, count(*) AS unique_customers FROM lineitem""",
)
def kpi_lineitem(spark, folder):
    lines = table(spark, folder, "lineitem")
    return analytics.sales_totals(lines, detect_semantics(lines.columns))


def _by(key: str, limit: str = "") -> str:
    return f"""SELECT {key} AS label, round(sum({MONEY}), 2) AS revenue FROM dirty_sales WHERE {key} IS NOT NULL
    GROUP BY {key} ORDER BY sum({MONEY}) DESC, label {limit}"""


@query("revenue_by_category", with_dirty(_by("category")))
def revenue_by_category(spark, folder):
    return analytics.revenue_by(dirty_sales(spark, folder), ROLES, ROLES.category)


@query("revenue_by_region", with_dirty(_by("region")))
def revenue_by_region(spark, folder):
    return analytics.revenue_by(dirty_sales(spark, folder), ROLES, ROLES.region)


@query("top_products", with_dirty(_by("product", "LIMIT 10")))
def top_products(spark, folder):
    return analytics.revenue_by(dirty_sales(spark, folder), ROLES, ROLES.product, analytics.TOP_GROUPS)


def _counts(key: str, relation: str = "dirty_sales") -> str:
    return f"""SELECT {key} AS label, count(*) AS n FROM {relation} WHERE {key} IS NOT NULL
    GROUP BY {key} ORDER BY n DESC, label LIMIT 10"""


@query("payment_dist", with_dirty(_counts("payment_method")))
def payment_dist(spark, folder):
    return analytics.value_distribution(dirty_sales(spark, folder), ROLES.payment)


@query("status_dist", with_dirty(_counts("order_status")))
def status_dist(spark, folder):
    return analytics.value_distribution(dirty_sales(spark, folder), ROLES.status)


@query(
    "monthly_revenue",
    with_dirty(f"""SELECT strftime({day_of("order_date")}, '%Y-%m') AS month, round(sum({MONEY}), 2) AS revenue,
    count(*) AS orders FROM dirty_sales WHERE {day_of("order_date")} IS NOT NULL GROUP BY 1 ORDER BY 1"""),
)
def monthly_revenue(spark, folder):
    return analytics.monthly_revenue(dirty_sales(spark, folder), ROLES)


_MONTHLY_CLEANED = with_dirty(
    """SELECT order_date[1:7] AS month, round(sum(unit_price * quantity), 2) AS revenue, count(*) AS orders
    FROM cleaned WHERE order_date <> 'Unknown' GROUP BY 1 ORDER BY 1""",
    *CLEANED,
)


@query("monthly_revenue_cleaned", _MONTHLY_CLEANED)
def monthly_revenue_cleaned(spark, folder):
    return analytics.monthly_revenue(clean(dirty_sales(spark, folder)).cleaned, ROLES, ("yyyy-MM-dd",))


@query(
    "monthly_orders",
    """SELECT strftime(o_orderdate, '%Y-%m') AS month, round(sum(o_orderkey::DOUBLE), 2) AS revenue, count(*) AS orders
    FROM orders GROUP BY 1 ORDER BY 1""",
)
def monthly_orders(spark, folder):
    orders = table(spark, folder, "orders")
    return analytics.monthly_revenue(orders, detect_semantics(orders.columns))


@query(
    "revenue_by_category_cleaned",
    with_dirty(
        """SELECT category AS label, round(sum(unit_price * quantity), 2) AS revenue FROM cleaned GROUP BY 1
        ORDER BY revenue DESC, label""",
        *CLEANED,
    ),
)
def revenue_by_category_cleaned(spark, folder):
    return analytics.revenue_by(clean(dirty_sales(spark, folder)).cleaned, ROLES, ROLES.category)


# ---- statistics ----------------------------------------------------------------------------------

def _described(c: str, relation: str) -> str:
    x = f"{c}::DOUBLE"
    return f"""SELECT '{c}' AS column_name, count({c}) AS count, round(avg({x}), 2) AS mean, round(stddev_samp({x}), 2) AS std,
    round(min({x}), 2) AS min, round(quantile_cont({x}, 0.25), 2) AS q25, round(quantile_cont({x}, 0.5), 2) AS q50,
    round(quantile_cont({x}, 0.75), 2) AS q75, round(max({x}), 2) AS max, round(skewness({x}), 2) AS skew FROM {relation}"""


LINE_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("describe_stats", union_all([_described(c, "lineitem") for c in LINE_NUMBERS]))
def describe_stats(spark, folder):
    return analytics.describe(table(spark, folder, "lineitem"))


@query("describe_stats_sales", with_dirty(union_all([_described(c, "dirty_sales") for c in ("order_id", "quantity", "unit_price")])))
def describe_stats_sales(spark, folder):
    return analytics.describe(stored_sales(spark, folder))


_CATEGORICAL = tuple(c for c in COLUMNS if c not in ("order_id", "quantity", "unit_price"))


_PART_TEXTS = ("p_name", "p_brand", "p_type", "c_name", "c_mktsegment", "o_orderstatus", "o_orderpriority", "l_returnflag", "l_linestatus")
_PART_ROWS = """lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey"""


@query(
    "cat_distributions_wide",
    f"WITH wide AS (SELECT {', '.join(_PART_TEXTS)} FROM {_PART_ROWS}) " + union_all([
        f"""SELECT * FROM (SELECT '{c}' AS column_name, row_number() OVER (ORDER BY count(*) DESC, {c} NULLS FIRST)::INTEGER AS rank,
        {c} AS value, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM wide), 1) AS percentage
        FROM wide GROUP BY {c}) WHERE rank <= 10"""
        for c in _PART_TEXTS
    ]),
)
def cat_distributions_wide(spark, folder):
    """More categorical columns than a report shows."""
    lines, orders, customers, parts = (table(spark, folder, name) for name in ("lineitem", "orders", "customer", "part"))
    wide = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey")).select(*_PART_TEXTS)
    )
    return analytics.categorical_distributions(stage(wide, "wide"))


@query(
    "cat_distributions",
    with_dirty(union_all([
        f"""SELECT * FROM (SELECT '{c}' AS column_name, row_number() OVER (ORDER BY count(*) DESC, {c} NULLS FIRST)::INTEGER AS rank,
        {c} AS value, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM dirty_sales), 1) AS percentage
        FROM dirty_sales GROUP BY {c}) WHERE rank <= 10"""
        for c in _CATEGORICAL
    ])),
)
def cat_distributions(spark, folder):
    return analytics.categorical_distributions(stored_sales(spark, folder))


def _pairs(columns: tuple[str, ...], relation: str) -> str:
    return union_all([
        f"SELECT '{a}' AS col_x, '{b}' AS col_y, round(corr({a}::DOUBLE, {b}::DOUBLE), 2) AS r FROM {relation}"
        for a in columns for b in columns
    ])


@query("corr_matrix", _pairs(LINE_NUMBERS, "lineitem"))
def corr_matrix(spark, folder):
    return analytics.correlations(table(spark, folder, "lineitem"))


@query("corr_matrix_missing", with_dirty(_pairs(("order_id", "quantity", "unit_price"), "dirty_sales")))
def corr_matrix_missing(spark, folder):
    return analytics.correlations(dirty_sales(spark, folder))


@query(
    "grouped_insight",
    """SELECT l_returnflag AS label, count(l_orderkey) AS count, round(avg(l_orderkey), 2) AS mean,
    round(sum(l_orderkey::DOUBLE), 2) AS sum FROM lineitem GROUP BY 1 ORDER BY sum DESC, label LIMIT 10""",
)
def grouped_insight(spark, folder):
    return analytics.grouped_insight(table(spark, folder, "lineitem"), "l_returnflag", "l_orderkey")


@query(
    "grouped_insight_product",
    with_dirty("""SELECT product AS label, count(quantity) AS count, round(avg(quantity), 2) AS mean,
    round(sum(quantity), 2) AS sum FROM dirty_sales GROUP BY 1 ORDER BY round(sum(quantity), 2) DESC, label LIMIT 10"""),
)
def grouped_insight_product(spark, folder):
    return analytics.grouped_insight(dirty_sales(spark, folder), "product", "quantity")


# ---- chart data ----------------------------------------------------------------------------------

def _bins(column: str, relation: str, bins: int) -> str:
    return f"""SELECT b::INTEGER AS bin, lo + (b - 1) * (hi - lo) / {bins} AS bin_start, lo + b * (hi - lo) / {bins} AS bin_end,
    coalesce(n, 0)::BIGINT AS n FROM range(1, {bins + 1}) r(b) CROSS JOIN (SELECT min({column})::DOUBLE AS lo, max({column})::DOUBLE AS hi FROM {relation}) e
    LEFT JOIN (SELECT least(floor(({column} - lo) / (hi - lo) * {bins}), {bins - 1}) + 1 AS bin, count(*) AS n FROM {relation},
      (SELECT min({column})::DOUBLE AS lo, max({column})::DOUBLE AS hi FROM {relation}) WHERE {column} IS NOT NULL GROUP BY 1) c ON c.bin = b"""


def _rounded_bins(sql: str) -> str:
    return f"SELECT bin, round(bin_start, 6) AS bin_start, round(bin_end, 6) AS bin_end, n FROM ({sql})"


@query("histogram30", _rounded_bins(_bins("l_extendedprice", "lineitem", 30)))
def histogram30(spark, folder):
    found = charts.histogram(table(spark, folder, "lineitem"), "l_extendedprice")
    return found.withColumns({c: F.round(c, 6) for c in ("bin_start", "bin_end")})


@query("histogram35_events", _rounded_bins(_bins("value", "events", 35)))
def histogram35_events(spark, folder):
    found = charts.histogram(table(spark, folder, "events"), "value", charts.EXPLORER_BINS)
    return found.withColumns({c: F.round(c, 6) for c in ("bin_start", "bin_end")})


def _boxes(value: str, relation: str, by: str | None) -> str:
    label = f"{by} AS label, " if by else ""
    group = f"WHERE {by} IS NOT NULL GROUP BY {by}" if by else ""
    joined = f"q ON q.label = x.{by}" if by else "q ON true"
    return f"""WITH q AS (SELECT {label}count({value}) AS n, quantile_cont({value}::DOUBLE, 0.25) AS a, quantile_cont({value}::DOUBLE, 0.5) AS m,
      quantile_cont({value}::DOUBLE, 0.75) AS b FROM {relation} {group})
    SELECT {'label, ' if by else ''}any_value(n) AS n, round(any_value(a), 6) AS q25, round(any_value(m), 6) AS median, round(any_value(b), 6) AS q75,
      min({value}) FILTER ({value} >= a - 1.5 * (b - a) AND {value} <= b + 1.5 * (b - a))::DOUBLE AS low_whisker,
      max({value}) FILTER ({value} >= a - 1.5 * (b - a) AND {value} <= b + 1.5 * (b - a))::DOUBLE AS high_whisker,
      count(*) FILTER ({value} < a - 1.5 * (b - a) OR {value} > b + 1.5 * (b - a)) AS outliers_count
    FROM {relation} x JOIN {joined} {'GROUP BY label' if by else ''}"""


def _box(df, column, by=None):
    found = charts.box_statistics(df, column, by)
    return found.withColumns({c: F.round(c, 6) for c in ("q25", "median", "q75")})


@query("box_by_group", _boxes("c_acctbal", "customer", "c_mktsegment"))
def box_by_group(spark, folder):
    return _box(table(spark, folder, "customer"), "c_acctbal", "c_mktsegment")


@query("box_overall", _boxes("l_extendedprice", "lineitem", None))
def box_overall(spark, folder):
    return _box(table(spark, folder, "lineitem"), "l_extendedprice")


@query("box_events_by_type", _boxes("value", "events", "event_type"))
def box_events_by_type(spark, folder):
    return _box(table(spark, folder, "events"), "value", "event_type")


def _far_points(value: str, relation: str, key: tuple[str, ...], by: str | None, limit: int) -> str:
    label, group = (f"{by} AS label, ", f"WHERE {by} IS NOT NULL GROUP BY {by}") if by else ("", "")
    return f"""WITH q AS (SELECT {label}quantile_cont({value}::DOUBLE, 0.25) AS a, quantile_cont({value}::DOUBLE, 0.75) AS b FROM {relation} {group}),
    beyond AS (SELECT {'label, ' if by else ''}{value}::DOUBLE AS x, {', '.join(key)},
      greatest(a - 1.5 * (b - a) - {value}, {value} - (b + 1.5 * (b - a))) AS distance FROM {relation} t JOIN q ON {f'q.label = t.{by}' if by else 'true'})
    SELECT * EXCLUDE (distance), row_number() OVER ({'PARTITION BY label ' if by else ''}ORDER BY distance DESC, {', '.join(key)})::INTEGER AS rank
    FROM beyond WHERE distance > 0 QUALIFY rank <= {limit}"""


@query("box_outlier_points", _far_points("value", "events", ("event_id",), "event_type", 25))
def box_outlier_points(spark, folder):
    return charts.box_outliers(table(spark, folder, "events"), "value", ["event_id"], "event_type", limit=25)


@query("box_outlier_points_overall", _far_points("l_extendedprice", "lineitem", ("l_orderkey", "l_linenumber"), None, 100))
def box_outlier_points_overall(spark, folder):
    return charts.box_outliers(table(spark, folder, "lineitem"), "l_extendedprice", ["l_orderkey", "l_linenumber"])


@query("preview_15", "SELECT * FROM lineitem LIMIT 15")
def preview_15(spark, folder):
    return reports.preview(table(spark, folder, "lineitem"))


def _line(x: str, y: str, relation: str, by: str | None) -> str:
    label = f"{by} AS label, " if by else ""
    return f"""SELECT {label}regr_count({y}, {x})::BIGINT AS n, round(regr_slope({y}, {x}), 6) AS slope,
    round(regr_intercept({y}, {x}), 4) AS intercept, round(regr_r2({y}, {x}), 6) AS r2 FROM {relation} {f'GROUP BY {by}' if by else ''}"""


def _fitted(df, x, y, by=None):
    found = charts.trendlines(df, x, y, by)
    return found.withColumns({"slope": F.round("slope", 6), "intercept": F.round("intercept", 4), "r2": F.round("r2", 6)})


@query("ols_by_group", _line("l_quantity", "l_extendedprice", "lineitem", "l_returnflag"))
def ols_by_group(spark, folder):
    return _fitted(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")


@query("ols_overall", _line("l_quantity", "l_extendedprice", "lineitem", None))
def ols_overall(spark, folder):
    return _fitted(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice")


@query("scatter_points", "SELECT l_quantity, l_extendedprice, l_returnflag FROM lineitem")
def scatter_points(spark, folder):
    return charts.scatter_points(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")


@query(
    "share_of_total",
    with_dirty(f"""SELECT label, revenue, round(revenue * 100.0::DOUBLE / sum(revenue) OVER (), 1) AS share FROM
    (SELECT region AS label, round(sum({MONEY}), 2) AS revenue FROM dirty_sales GROUP BY 1)"""),
)
def share_of_total(spark, folder):
    return charts.share_of_total(stage(analytics.revenue_by(dirty_sales(spark, folder), ROLES, ROLES.region), "regions"), "revenue")


@query(
    "share_of_payments",
    with_dirty("""SELECT label, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 1) AS share FROM
    (SELECT payment_method AS label, count(*) AS n FROM dirty_sales GROUP BY 1)"""),
)
def share_of_payments(spark, folder):
    return charts.share_of_total(stage(analytics.value_distribution(dirty_sales(spark, folder), ROLES.payment), "payments"), "n")


@query("category_bars", with_dirty(_by("category", "LIMIT 7")))
def category_bars(spark, folder):
    return charts.category_bars(dirty_sales(spark, folder), ROLES)


@query("product_bars", with_dirty(_by("product", "LIMIT 8")))
def product_bars(spark, folder):
    return charts.product_bars(dirty_sales(spark, folder), ROLES)


@query("report_product_bars", with_dirty(_by("product", "LIMIT 6")))
def report_product_bars(spark, folder):
    return charts.product_bars(dirty_sales(spark, folder), ROLES, charts.REPORT_PRODUCTS)


@query("category_counts", _counts("p_brand", "part"))
def category_counts(spark, folder):
    return charts.category_counts(table(spark, folder, "part"), "p_brand")


# ---- report tables -------------------------------------------------------------------------------

@query(
    "kpi_display",
    with_dirty(
        """SELECT 1 AS position, 'Total Gross Revenue' AS metric, '$' || printf('%.2f', revenue / 1e6) || 'M' AS value,
        'Total monetized throughput across valid orders' AS significance FROM totals
        UNION ALL SELECT 2, 'Average Order Value (AOV)', '$' || format('{:,.2f}', aov), 'Mean commercial spend per customer order' FROM totals
        UNION ALL SELECT 3, 'Total Quantity Sold', CASE WHEN units >= 1e6 THEN printf('%.2f', units / 1e6) || 'M' ELSE format('{:,}', units) END,
        'Aggregated units distributed across all transactions' FROM totals
        UNION ALL SELECT 4, 'Total Orders Processed', format('{:,}', orders), 'Net verified purchasing records post-cleaning' FROM totals
        UNION ALL SELECT 5, 'Unique Customers', format('{:,}', buyers), 'Distinct individual clients identified in pipeline' FROM totals""",
        f"""totals AS (SELECT round(sum({MONEY}), 2) AS revenue, round(avg({MONEY}), 2) AS aov, trunc(sum(coalesce(quantity, 0)))::BIGINT AS units,
        count(*) AS orders, count(DISTINCT customer_name) AS buyers FROM dirty_sales)""",
    ),
)
def kpi_display(spark, folder):
    return reports.business_kpis(analytics.sales_totals(dirty_sales(spark, folder), ROLES))


@query(
    "display_formats",
    """SELECT o_orderkey, CASE WHEN o_totalprice >= 1e6 THEN printf('%.2f', o_totalprice / 1e6) || 'M' WHEN o_totalprice >= 1000 THEN
      CASE WHEN o_totalprice % 1 = 0 THEN format('{:,}', o_totalprice::BIGINT) ELSE format('{:,.2f}', o_totalprice) END
      ELSE CASE WHEN o_totalprice % 1 = 0 THEN format('{:d}', o_totalprice::BIGINT) ELSE printf('%.2f', o_totalprice) END END AS as_number,
    CASE WHEN o_totalprice >= 1e6 THEN '$' || printf('%.2f', o_totalprice / 1e6) || 'M' ELSE '$' || format('{:,.2f}', o_totalprice) END AS as_currency,
    printf('%.1f', o_totalprice) || '%' AS as_percent,
    CASE WHEN o_totalprice < 1024 THEN printf('%.1f', o_totalprice) || ' B' WHEN o_totalprice < 1048576 THEN printf('%.1f', o_totalprice / 1024) || ' KB'
      ELSE printf('%.1f', o_totalprice / 1048576) || ' MB' END AS as_size FROM orders""",
)
def display_formats(spark, folder):
    price = F.col("o_totalprice")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        display.show_number(price).alias("as_number"),
        display.show_currency(price).alias("as_currency"),
        display.show_percent(price).alias("as_percent"),
        display.show_bytes(price).alias("as_size"),
    )


_CLEAN_MISSING = "clean_missing AS (" + union_all([
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS cleaned_missing FROM cleaned" for c in COLUMNS
]) + ")"


@query(
    "column_diagnostics",
    with_dirty(
        """SELECT position, d.column_name, inferred_type, null_count AS raw_missing, null_percentage AS raw_missing_pct, cleaned_missing,
        unique_count, issues FROM described d JOIN clean_missing USING (column_name)""",
        *DIRTY_PROFILE, *CLEANED, _CLEAN_MISSING,
    ),
)
def column_diagnostics(spark, folder):
    rows = stored_sales(spark, folder)
    cleaned = stage(clean(rows).cleaned, "cleaned")
    return reports.column_diagnostics(profile_dataset(rows).columns_frame(), profile_dataset(cleaned).columns_frame())


@query(
    "printed_diagnostics",
    with_dirty(
        """SELECT position, column_name, inferred_type, null_count || ' (' || null_percentage || '%)' AS missing, unique_count,
        CASE WHEN issues = 'Clean' THEN 'Fully valid' ELSE issues[1:120] END AS issues FROM described""",
        *DIRTY_PROFILE,
    ),
)
def printed_diagnostics(spark, folder):
    return reports.printed_diagnostics(profile_dataset(stored_sales(spark, folder)).columns_frame())


def _renamed(ctes: list[str], suffix: str) -> list[str]:
    """The profile CTEs a second time under other names, for the cleaned side."""
    names = ("measured", "classed", "profiled", "described", "counts", "parts", "scored")
    renamed = []
    for cte in ctes:
        for name in names:
            for before, after in ((f"{name} AS", f"{name}{suffix} AS"), (f"FROM {name}", f"FROM {name}{suffix}")):
                cte = cte.replace(before, after)
        renamed.append(cte)
    return renamed


_CLEAN_KINDS = [(c, "number" if c in ("order_id", "quantity", "unit_price") else "text") for c in COLUMNS]
_CLEAN_SCORE = _renamed(
    profile_ctes("cleaned", _CLEAN_KINDS, "order_date", ("quantity", "unit_price")) + score_ctes("cleaned", 11), "_after"
)
_GRADE = "CASE WHEN {s} >= 90 THEN 'Excellent' WHEN {s} >= 75 THEN 'Good' WHEN {s} >= 60 THEN 'Fair' WHEN {s} >= 40 THEN 'Poor' ELSE 'Critical' END"


@query(
    "before_after",
    with_dirty(
        f"""SELECT 1 AS position, 'Data Quality Score' AS metric, printf('%.1f', b.overall) || '%' AS raw_input, printf('%.1f', a.overall) || '%' AS cleaned_output,
          printf('%+.1f', a.overall - b.overall) || '%' AS net_change FROM scored b, scored_after a
        UNION ALL SELECT 2, 'Total Rows', format('{{:,}}', b.total::BIGINT), format('{{:,}}', a.total::BIGINT), '-' || format('{{:,}}', (b.total - a.total)::BIGINT) || ' duplicates removed' FROM scored b, scored_after a
        UNION ALL SELECT 3, 'Total Columns', '11', '11', 'Maintained'
        UNION ALL SELECT 4, 'Missing Cells', format('{{:,}}', b.missing::BIGINT) || ' (' || round(b.missing * 100.0::DOUBLE / (b.total * 11), 2) || '%)',
          format('{{:,}}', a.missing::BIGINT) || ' (' || round(a.missing * 100.0::DOUBLE / (a.total * 11), 2) || '%)', format('{{:,}}', (b.missing - a.missing)::BIGINT) || ' imputed' FROM scored b, scored_after a
        UNION ALL SELECT 5, 'Duplicate Records', format('{{:,}}', b.dups::BIGINT), format('{{:,}}', a.dups::BIGINT), format('{{:,}}', (b.dups - a.dups)::BIGINT) || ' dropped' FROM scored b, scored_after a
        UNION ALL SELECT 6, 'Quality Assessment Grade', {_GRADE.format(s='b.overall')}, {_GRADE.format(s='a.overall')}, 'Optimized' FROM scored b, scored_after a""",
        *DIRTY_PROFILE, *score_ctes("dirty_sales", 11), *CLEANED, *_CLEAN_SCORE,
    ),
)
def before_after(spark, folder):
    return build_report(stored_sales(spark, folder)).tables()["before_after"]


@query("quality_score_cleaned", with_dirty(SCORE.replace("FROM scored", "FROM scored_after"), *CLEANED, *_CLEAN_SCORE))
def quality_score_cleaned(spark, folder):
    cleaned = stage(clean(dirty_sales(spark, folder)).cleaned, "cleaned")
    return profile_dataset(cleaned).quality.frame(spark).drop("summary_text", "recommendations")


# ---- sources and sinks ---------------------------------------------------------------------------

@query(
    "csv_round_trip",
    "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer",
)
def csv_round_trip(spark, folder):
    """Written with a semicolon, read back with everything detected."""
    path = fresh_path(spark, "customer-csv")
    table(spark, folder, "customer").write.option("header", True).option("sep", ";").csv(path)
    return read_dataset(spark, path, fmt="csv")


# Texts of about so many bytes go to one file, beyond the least number of files.
CSV_FILE_BYTES, CSV_FILES = 64 << 20, 3


def csv_files(rows):
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(CSV_FILES, -(-size // CSV_FILE_BYTES))


@query("csv_quoted_breaks", "SELECT doc_id, text, lang FROM documents")
def csv_quoted_breaks(spark, folder):
    """Texts with line breaks, commas and quotes, three files of many records each, more of them for large tables."""
    path = fresh_path(spark, "documents-csv")
    rows = table(spark, folder, "documents").select("doc_id", "text", "lang")
    rows = rows.repartition(csv_files(rows))
    rows.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return read_dataset(spark, path, fmt="csv")


@query("csv_latin1", "SELECT doc_id, lang, substr(text, 1, strpos(text || ' ', ' ') - 1) AS word FROM documents WHERE lang IN ('de', 'fr', 'es')")
def csv_latin1(spark, folder):
    """A Latin-1 file, one word of each text that needs it."""
    path = fresh_path(spark, "words-csv")
    rows = table(spark, folder, "documents").where(F.col("lang").isin("de", "fr", "es"))
    rows.select("doc_id", "lang", F.substring_index("text", " ", 1).alias("word")).write.options(header=True, encoding="ISO-8859-1").csv(path)
    return read_dataset(spark, path, fmt="csv")


@query(
    "csv_ragged",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS o_orderpriority
    FROM orders WHERE o_orderkey % 3 < 2""",
)
def csv_ragged(spark, folder):
    """Short rows are padded, rows with too many fields go."""
    path = fresh_path(spark, "ragged-csv")
    key, rest = F.col("o_orderkey").cast("string"), F.concat_ws(",", "o_orderstatus", "o_orderpriority")
    line = F.when(F.col("o_orderkey") % 3 == 0, key).when(F.col("o_orderkey") % 3 == 1, F.concat_ws(",", key, rest)).otherwise(F.concat_ws(",", key, rest, F.lit("more")))
    # The header is the name of the only column, so every task writes it above its own lines.
    lines = table(spark, folder, "orders").select(line.alias("o_orderkey,o_orderstatus,o_orderpriority"))
    lines.write.option("header", True).option("sep", "\x01").option("quote", "").csv(path)
    return read_dataset(spark, path, fmt="csv")


@query("csv_colliding_headers", "SELECT o_orderkey, o_custkey AS o_orderkey_2, o_orderstatus AS status FROM orders")
def csv_colliding_headers(spark, folder):
    """Headers are trimmed, and equal ones are told apart."""
    path = fresh_path(spark, "headers-csv")
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias(" o_orderkey"), F.col("o_custkey").alias("o_orderkey "), F.col("o_orderstatus").alias(" status "))
    plain = orders.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    plain.csv(path)
    return read_dataset(spark, path, fmt="csv")


@query(
    "csv_missing_tokens",
    with_dirty("SELECT order_id, order_date, customer_email, quantity::BIGINT AS quantity, unit_price FROM dirty_sales"),
)
def csv_missing_tokens(spark, folder):
    """Missing cells leave as ``N/A`` in text and come back as nulls in typed columns."""
    path = fresh_path(spark, "sales-csv")
    rows = dirty_sales(spark, folder).select("order_id", "order_date", "customer_email", "quantity", "unit_price")
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("N/A")).alias(c) for c in rows.columns]
    # Written unquoted blanks would be trimmed by the writer.
    plain = rows.select(*texts).write.option("header", True).option("sep", "\t")
    plain.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    found = read_dataset(spark, path, fmt="tsv")
    return found.select(
        "order_id", "order_date", "customer_email", F.col("quantity").cast("bigint").alias("quantity"), "unit_price"
    )


@query(
    "detected_layout",
    "SELECT ';' AS delimiter, 'UTF-8' AS encoding, count(*) AS rows FROM part",
)
def detected_layout(spark, folder):
    path = fresh_path(spark, "part-csv")
    parts = table(spark, folder, "part")
    parts.write.option("header", True).option("sep", ";").csv(path)
    return read_dataset(spark, path, fmt="csv").agg(
        F.lit(detect_delimiter(spark, path)).alias("delimiter"),
        F.lit(detect_encoding(spark, path)).alias("encoding"),
        F.count(F.lit(1)).alias("rows"),
    ).select("delimiter", "encoding", "rows")


@query(
    "dataset_metadata",
    """SELECT 'lineitem.parquet' AS file_name, count(*) AS row_count, 11::BIGINT AS column_count, false AS has_empty_cells, 0::BIGINT AS missing_cells_total,
    count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS duplicate_rows_total,
    'l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate' AS columns
    FROM lineitem""",
)
def dataset_metadata(spark, folder):
    path = f"{folder}/lineitem.parquet"
    return metadata_of(read_dataset(spark, path), path).drop("file_size_bytes", "file_size", "encoding", "delimiter")


@query("cleaned_sink", with_dirty("SELECT " + ", ".join(COLUMNS) + " FROM cleaned", *CLEANED))
def cleaned_sink(spark, folder):
    """The cleaned table written as CSV and read back."""
    path = fresh_path(spark, "cleaned-csv")
    result = clean(dirty_sales(spark, folder))
    write_table(result.cleaned, path, fmt="csv")
    back = read_dataset(spark, path, fmt="csv")
    return back.select(
        *[F.round(c, 6).alias(c) if schema.is_float(schema.type_of(back, c)) else c for c in COLUMNS]
    )


@query(
    "orders_by_month",
    """SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, min(o_orderkey) AS first_key, round(sum(o_totalprice), 2) AS total
    FROM orders GROUP BY 1""",
)
def orders_by_month(spark, folder):
    """A table written in a folder per month and read back from them."""
    path = fresh_path(spark, "orders-by-month")
    write_table(table(spark, folder, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM")), path, partition_by=["month"])
    back = spark.read.parquet(path)
    return back.groupBy(F.col("month").cast("string").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query("audit_sink", AUDIT)
def audit_sink(spark, folder):
    path = fresh_path(spark, "audit-csv")
    write_audit(clean(dirty_sales(spark, folder)).audit_frame(), path)
    back = read_dataset(spark, path, fmt="csv")
    return back.select(F.col("step").cast("int").alias("step"), "operation", "column", "records_affected")


@query(
    "report_bundle",
    with_dirty(
        f"""SELECT 'revenue_by_category' AS name, category AS label, round(sum(unit_price * quantity), 2) AS value FROM cleaned GROUP BY 2
        UNION ALL SELECT 'monthly_revenue', order_date[1:7], round(sum(unit_price * quantity), 2) FROM cleaned WHERE order_date <> 'Unknown' GROUP BY 2
        UNION ALL SELECT 'revenue_by_region', region, round(sum(unit_price * quantity), 2) FROM cleaned GROUP BY 2""",
        *CLEANED,
    ),
)
def report_bundle(spark, folder):
    """The whole bundle written to a folder; every table of it read back, the values of three compared."""
    path = fresh_path(spark, "report")
    tables = build_report(stored_sales(spark, folder)).tables()
    publish_report(tables, path)
    back = read_report(spark, path)
    rows = {line["name"]: line["rows"] for line in read_manifest(spark, path).collect()}
    if set(back) != set(tables):
        raise ValueError("the report came back with other tables")
    for name, frame in back.items():
        if frame.columns != tables[name].columns or frame.count() != rows[name]:
            raise ValueError(f"{name} came back with other columns or rows")
    keys = {"revenue_by_category": "label", "monthly_revenue": "month", "revenue_by_region": "label"}
    parts = [back[name].select(F.lit(name).alias("name"), F.col(key).alias("label"), F.col("revenue").alias("value")) for name, key in keys.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "clean_stream_orders",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
    array_to_string(list_transform(regexp_extract_all(o_orderpriority, '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1]) || lower(w[2:])), '') AS o_orderpriority
    FROM orders""",
)
def clean_stream_orders(spark, folder):
    """A plan fitted on the table, run over the same rows as a stream."""
    orders = table(spark, folder, "orders")
    plan = fit(orders)
    path, checkpoint = fresh_path(spark, "stream-out"), fresh_path(spark, "stream-state")
    rows = spark.readStream.schema(orders.schema).option("pathGlobFilter", "orders.parquet").parquet(folder)
    clean_stream(rows, plan, path, checkpoint).awaitTermination()
    return spark.read.parquet(path)
