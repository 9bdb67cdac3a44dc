"""Missing values, distinct values, classes, validation, scores and duplicates."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrinse import schema
from sparkrinse.functions.numbers import rounded_share
from sparkrinse.functions.text import has_space_defect
from sparkrinse.operators import duplicates, frequency, validate
from sparkrinse.operators.analytics import general_kpis
from sparkrinse.operators.profile import DatasetProfile, classify_columns, profile_dataset
from sparkrinse.operators.tidy import rows_per_column
from workload.dirty_sales import (
    COLUMNS, EMAIL, NUMBER_COLUMNS, TEXT_COLUMNS, day_of, dirty_sales, stored_sales, union_all, with_dirty,
)
from workload.registry import query, table

ROW = ", ".join(COLUMNS)


# ---- counts per column ---------------------------------------------------------------------------

@query(
    "missing_by_column",
    with_dirty(union_all([
        f"""SELECT '{c}' AS column_name, count({c}) AS non_null_count, count(*) - count({c}) AS null_count,
        round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS null_percentage FROM dirty_sales"""
        for c in COLUMNS
    ])),
)
def missing_by_column(spark, folder):
    def measures(name):
        present = F.count(schema.col(name))
        missing = F.count(F.lit(1)) - present
        return {
            "non_null_count": present,
            "null_count": missing,
            "null_percentage": rounded_share(missing, F.count(F.lit(1))),
        }

    return rows_per_column(stored_sales(spark, folder), COLUMNS, measures)


_MISSING = " + ".join(f"count(*) - count({c})" for c in COLUMNS)
DATASET_TOTALS = with_dirty(f"""
SELECT count(*) AS total_records, 11::BIGINT AS total_columns, 3::BIGINT AS numeric_columns,
  8::BIGINT AS categorical_columns, {_MISSING} AS missing_values,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_sales)) AS duplicate_records,
  round((1 - ({_MISSING})::DOUBLE / (count(*) * 11)) * 100, 2) AS data_density
FROM dirty_sales""")


@query("dataset_totals", DATASET_TOTALS)
def dataset_totals(spark, folder):
    return general_kpis(stored_sales(spark, folder))


@query(
    "dup_count",
    with_dirty("""SELECT count(*)::BIGINT AS total_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_sales)) AS distinct_rows,
    count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_sales)) AS duplicate_rows FROM dirty_sales"""),
)
def dup_count(spark, folder):
    return duplicates.duplicate_count(stored_sales(spark, folder))


@query(
    "dup_count_lineitem",
    """SELECT count(*) AS total_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS distinct_rows,
    count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS duplicate_rows FROM lineitem""",
)
def dup_count_lineitem(spark, folder):
    return duplicates.duplicate_count(table(spark, folder, "lineitem"))


@query(
    "distinct_by_column",
    with_dirty(union_all([
        f"""SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count, count({c}) AS non_null_count,
        round(count(DISTINCT {c}) * 100.0::DOUBLE / count({c}), 2) AS unique_percentage FROM dirty_sales"""
        for c in COLUMNS
    ])),
)
def distinct_by_column(spark, folder):
    counts = frequency.distinct_counts(frequency.value_frequencies(stored_sales(spark, folder), COLUMNS))
    share = rounded_share(F.col("distinct_count"), F.col("non_null_count"))
    return counts.drop("folded_count").withColumn("unique_percentage", share)


@query(
    "top5_by_column",
    with_dirty(union_all([
        f"""SELECT * FROM (SELECT '{c}' AS column_name, {c}::VARCHAR AS value, count(*) AS n,
        row_number() OVER (ORDER BY count(*) DESC, {c})::INTEGER AS rank
        FROM dirty_sales WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 5"""
        for c in COLUMNS
    ])),
)
def top5_by_column(spark, folder):
    return frequency.top_values(stored_sales(spark, folder), COLUMNS, 5)


@query(
    "sample_values",
    with_dirty(union_all([
        f"""SELECT * FROM (SELECT '{c}' AS column_name, {c} AS value,
        row_number() OVER (ORDER BY {c})::INTEGER AS rank
        FROM (SELECT DISTINCT {c} FROM dirty_sales WHERE {c} IS NOT NULL)) WHERE rank <= 5"""
        for c in TEXT_COLUMNS
    ])),
)
def sample_values(spark, folder):
    return frequency.first_values(
        frequency.value_frequencies(stored_sales(spark, folder), TEXT_COLUMNS), 5, by_count=False
    ).drop("n")


@query(
    "casing_defects",
    with_dirty(union_all([
        f"""SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count,
        count(DISTINCT lower(trim({c}))) AS folded_count,
        count(DISTINCT lower(trim({c}))) < count(DISTINCT {c}) AS has_mixed_case FROM dirty_sales"""
        for c in TEXT_COLUMNS
    ])),
)
def casing_defects(spark, folder):
    counts = frequency.distinct_counts(frequency.value_frequencies(stored_sales(spark, folder), TEXT_COLUMNS))
    return counts.drop("non_null_count").withColumn("has_mixed_case", F.col("folded_count") < F.col("distinct_count"))


@query(
    "whitespace_defects",
    with_dirty(union_all([
        f"""SELECT '{c}' AS column_name,
        count(*) FILTER ({c} <> trim({c}) OR regexp_matches({c}, '\\s{{2,}}')) AS defects,
        count(*) FILTER ({c} <> trim({c}) OR regexp_matches({c}, '\\s{{2,}}')) > 0 AS has_space_defect FROM dirty_sales"""
        for c in TEXT_COLUMNS
    ])),
)
def whitespace_defects(spark, folder):
    def measures(name):
        found = F.count_if(has_space_defect(schema.col(name)))
        return {"defects": found, "has_space_defect": found > 0}

    return rows_per_column(stored_sales(spark, folder), TEXT_COLUMNS, measures)


@query(
    "profile_samples",
    with_dirty(union_all([
        f"""SELECT * FROM (SELECT '{c}' AS column_name, {c} AS value,
        row_number() OVER (ORDER BY {c})::INTEGER AS rank
        FROM (SELECT DISTINCT {c} FROM dirty_sales WHERE {c} IS NOT NULL)) WHERE rank <= 5"""
        for c in TEXT_COLUMNS
    ])),
)
def profile_samples(spark, folder):
    found = profile_dataset(stored_sales(spark, folder)).columns_frame().where(F.col("column_name").isin(*TEXT_COLUMNS))
    ranked = found.select("column_name", F.posexplode("sample_values").alias("rank", "value"))
    return ranked.withColumn("rank", F.col("rank") + 1)


# ---- validation ----------------------------------------------------------------------------------

def _email_counts(column: str, relation: str) -> str:
    good = f"regexp_full_match(trim({column}), '{EMAIL}')"
    return f"""SELECT '{column}' AS column_name, count(*) AS total_records,
    count(*) FILTER ({good}) AS valid_count, count(*) FILTER (NOT {good}) AS invalid_count,
    count(*) FILTER ({column} IS NULL) AS missing_count,
    round(coalesce(count(*) FILTER ({good}) * 100.0::DOUBLE / nullif(count({column}), 0), 0.0), 2) AS valid_rate
    FROM {relation}"""


@query("email_validation", with_dirty(union_all([_email_counts(c, "dirty_sales") for c in ("customer_email", "product")])))
def email_validation(spark, folder):
    return validate.validate_emails(dirty_sales(spark, folder), ["customer_email", "product"])


@query(
    "email_invalid_sample",
    with_dirty(f"""SELECT order_id, product, trim(customer_email) AS value, 'Malformed email format' AS reason
    FROM dirty_sales WHERE NOT regexp_full_match(trim(customer_email), '{EMAIL}')
    ORDER BY order_id, product, value LIMIT 10"""),
)
def email_invalid_sample(spark, folder):
    return validate.invalid_emails(dirty_sales(spark, folder), "customer_email", ["order_id", "product"])


def _date_counts(column: str, day: str, relation: str) -> str:
    return f"""SELECT '{column}' AS column_name, count(*) AS total_records, count({day}) AS valid_count,
    count({column}) - count({day}) AS invalid_count, count(*) - count({column}) AS missing_count,
    strftime(min({day}), '%Y-%m-%d') AS min_date, strftime(max({day}), '%Y-%m-%d') AS max_date,
    round(count({day}) * 100.0::DOUBLE / count({column}), 2) AS valid_rate FROM {relation}"""


@query("date_validation", with_dirty(_date_counts("order_date", day_of("order_date"), "dirty_sales")))
def date_validation(spark, folder):
    return validate.validate_dates(dirty_sales(spark, folder), ["order_date"])


@query("date_validation_timestamps", _date_counts("l_shipdate", "l_shipdate::DATE", "lineitem"))
def date_validation_timestamps(spark, folder):
    return validate.validate_dates(table(spark, folder, "lineitem"), ["l_shipdate"])


@query(
    "date_invalid_sample",
    with_dirty(f"""SELECT order_id, product, order_date AS value, 'Unparseable date expression' AS reason
    FROM dirty_sales WHERE order_date IS NOT NULL AND {day_of("order_date")} IS NULL
    ORDER BY order_id, product, value LIMIT 10"""),
)
def date_invalid_sample(spark, folder):
    return validate.invalid_dates(dirty_sales(spark, folder), "order_date", ["order_id", "product"])


def _numeric_counts(column: str, relation: str) -> str:
    low, high = "q1 - 1.5 * (q3 - q1)", "q3 + 1.5 * (q3 - q1)"
    return f"""SELECT '{column}' AS column_name, count(*) AS total_records,
    count(*) FILTER ({column} < 0) AS negative_count, count(*) FILTER ({column} = 0) AS zero_count,
    count(*) FILTER ({column} > 0) AS positive_count, count(*) FILTER ({column} IS NULL) AS missing_count,
    count(*) FILTER ({column} < {low} OR {column} > {high}) AS outliers_count,
    round(any_value({low}), 2) AS lower_bound, round(any_value({high}), 2) AS upper_bound,
    count(*) FILTER ({column} < 0) > 0 AS has_negative_issues
    FROM {relation}, (SELECT quantile_cont({column}::DOUBLE, 0.25) AS q1, quantile_cont({column}::DOUBLE, 0.75) AS q3 FROM {relation})"""


@query("numeric_validation", with_dirty(union_all([_numeric_counts(c, "dirty_sales") for c in NUMBER_COLUMNS])))
def numeric_validation(spark, folder):
    return validate.validate_numeric(stored_sales(spark, folder), NUMBER_COLUMNS)


LINE_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("iqr_outliers", union_all([_numeric_counts(c, "lineitem") for c in LINE_NUMBERS]))
def iqr_outliers(spark, folder):
    return validate.validate_numeric(table(spark, folder, "lineitem"), LINE_NUMBERS)


@query(
    "outlier_samples",
    with_dirty(
        """SELECT order_id, product, unit_price AS value, CASE WHEN unit_price < low THEN 'Below Q1 - 1.5*IQR'
        ELSE 'Above Q3 + 1.5*IQR' END AS reason FROM dirty_sales, f WHERE unit_price < low OR unit_price > high
        ORDER BY order_id, product, value LIMIT 10""",
        """f AS (SELECT q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM
        (SELECT quantile_cont(unit_price, 0.25) AS q1, quantile_cont(unit_price, 0.75) AS q3 FROM dirty_sales))""",
    ),
)
def outlier_samples(spark, folder):
    return validate.outlier_samples(stored_sales(spark, folder), "unit_price", ["order_id", "product"])


@query(
    "rejected_samples",
    with_dirty(f"""(SELECT 'customer_email' AS column_name, order_id, product, trim(customer_email) AS value, 'Malformed email format' AS reason
    FROM dirty_sales WHERE NOT regexp_full_match(trim(customer_email), '{EMAIL}') ORDER BY order_id, product, value LIMIT 10)
    UNION ALL (SELECT 'order_date', order_id, product, order_date, 'Unparseable date expression'
    FROM dirty_sales WHERE order_date IS NOT NULL AND {day_of("order_date")} IS NULL ORDER BY order_id, product, order_date LIMIT 10)"""),
)
def rejected_samples(spark, folder):
    """Samples of several columns from one job."""
    return validate.rejected_samples(dirty_sales(spark, folder), ["order_id", "product"], emails=["customer_email"], dates=["order_date"])


# ---- column profiles -----------------------------------------------------------------------------

@query(
    "numeric_profile",
    union_all([
        f"""SELECT '{c}' AS column_name, min({c})::DOUBLE AS min_val, max({c})::DOUBLE AS max_val,
        round(avg({c}), 4) AS mean_val, round(median({c}::DOUBLE), 4) AS median_val, round(stddev_samp({c}), 4) AS std_val,
        round(quantile_cont({c}::DOUBLE, 0.25), 4) AS q25_val, round(quantile_cont({c}::DOUBLE, 0.75), 4) AS q75_val FROM lineitem"""
        for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *LINE_NUMBERS)
    ]),
)
def numeric_profile(spark, folder):
    found = profile_dataset(table(spark, folder, "lineitem")).columns_frame().where("inferred_type = 'Numeric'")
    return found.select(
        "column_name", "min_val", "max_val",
        *[F.round(c, 4).alias(c) for c in ("mean_val", "median_val", "std_val", "q25_val", "q75_val")],
    )


SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
NUMBER = "\\s*[+-]?((\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?|inf|infinity)\\s*"


def profile_ctes(relation: str, columns: list[tuple[str, str]], date: str | None, money: tuple[str, ...]) -> list[str]:
    """Counts and classes of every column of ``relation``; each column comes with its kind."""
    parts = []
    for position, (c, kind) in enumerate(columns, start=1):
        head = f"SELECT {position} AS position, '{c}' AS column_name, '{kind}' AS kind, count(*) AS total, count({c}) AS present, count(DISTINCT {c}) AS uniq"
        by_name = "date" in c or "time" in c or c == date
        day = day_of(c) if kind == "text" else f"{c}::DATE"
        if kind == "time" or (kind == "text" and by_name):
            parts.append(f"{head}, true AS dated, count({day}) AS days, 0 AS numbers, 0::BIGINT AS negatives, 0::BIGINT AS outliers, 0 AS words, 0 AS ats, 0::BIGINT AS bad_emails, 0 AS spaces, 0 AS folded FROM {relation}")
        elif kind == "number":
            fence = f"(SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {relation})"
            parts.append(
                f"{head}, false AS dated, 0::BIGINT AS days, count({c}) AS numbers, count(*) FILTER ({c} < 0) AS negatives, "
                f"count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers, 0 AS words, 0 AS ats, 0::BIGINT AS bad_emails, 0 AS spaces, 0 AS folded FROM {relation}, {fence}"
            )
        else:
            parts.append(
                f"{head}, false AS dated, 0::BIGINT AS days, count(*) FILTER (regexp_full_match({c}, '{NUMBER}')) AS numbers, 0::BIGINT AS negatives, 0::BIGINT AS outliers, "
                f"count(*) FILTER (lower({c}) IN ('true', 'false', '0', '1', 'yes', 'no')) AS words, count(*) FILTER (contains({c}, '@')) AS ats, "
                f"count(*) FILTER (NOT regexp_full_match(trim({c}, {SPACES}), '{EMAIL}')) AS bad_emails, "
                f"count(*) FILTER ({c} <> trim({c}, {SPACES}) OR regexp_matches({c}, '\\s{{2,}}')) AS spaces, "
                f"count(DISTINCT lower(trim({c}, {SPACES}))) AS folded FROM {relation}"
            )
    money_list = ", ".join(f"'{m}'" for m in money) or "''"
    return [
        "measured AS MATERIALIZED (" + union_all(parts) + ")",
        """classed AS (SELECT *, CASE WHEN dated THEN 'Datetime'
            WHEN kind = 'number' OR (present > 0 AND numbers > 0.85 * present) THEN 'Numeric'
            WHEN uniq <= 2 AND words = present THEN 'Boolean'
            WHEN uniq <= greatest(30, floor(total * 0.05)) THEN 'Categorical' ELSE 'Text/ID' END AS inferred_type
          FROM measured)""",
        f"""profiled AS MATERIALIZED (SELECT position, column_name, inferred_type, total, total - present AS null_count,
            round(CASE WHEN total > 0 THEN (total - present) * 100.0::DOUBLE / total ELSE 0 END, 2) AS null_percentage, uniq AS unique_count,
            CASE WHEN inferred_type = 'Numeric' THEN outliers ELSE 0 END AS outliers_count,
            CASE WHEN inferred_type = 'Numeric' THEN negatives ELSE 0 END AS negatives_count,
            CASE WHEN dated THEN present - days ELSE 0 END AS invalid_dates_count,
            CASE WHEN inferred_type IN ('Categorical', 'Text/ID') AND (contains(column_name, 'email') OR ats > 0.5 * present) THEN bad_emails ELSE 0 END AS invalid_emails_count,
            inferred_type IN ('Categorical', 'Text/ID') AND spaces > 0 AS has_spaces,
            inferred_type IN ('Categorical', 'Text/ID') AND folded < uniq AS has_mixed_case, folded,
            column_name IN ({money_list}) AS is_money FROM classed)""",
        """described AS (SELECT *, coalesce(nullif(concat_ws('; ',
            CASE WHEN null_count > 0 THEN null_count || ' missing values (' || printf('%.1f', null_count * 100.0::DOUBLE / total) || '%)' END,
            CASE WHEN invalid_dates_count > 0 THEN invalid_dates_count || ' invalid date formats' END,
            CASE WHEN is_money AND negatives_count > 0 THEN negatives_count || ' negative values detected' END,
            CASE WHEN outliers_count > 0 THEN outliers_count || ' statistical outliers (IQR)' END,
            CASE WHEN invalid_emails_count > 0 THEN invalid_emails_count || ' malformed email addresses' END,
            CASE WHEN has_spaces THEN 'Inconsistent whitespace / extra spaces' END,
            CASE WHEN has_mixed_case THEN 'Inconsistent capitalization (' || unique_count || ' distinct cases vs ' || folded || ' semantic values)' END
          ), ''), 'Clean') AS issues FROM profiled)""",
    ]


def score_ctes(relation: str, columns: int) -> list[str]:
    return [
        f"""counts AS (SELECT any_value(total)::DOUBLE AS total, sum(null_count) AS missing,
            any_value(total) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {relation})) AS dups,
            count(*) FILTER (has_spaces OR has_mixed_case) AS uneven,
            sum(invalid_dates_count + invalid_emails_count + negatives_count) AS failures,
            sum((invalid_dates_count > 0)::INT + (invalid_emails_count > 0)::INT + (negatives_count > 0)::INT) AS kinds
          FROM described)""",
        f"""parts AS (SELECT *, (1 - missing / (total * {columns})) * 100 AS c, (1 - dups / total) * 100 AS u,
            (1 - uneven::DOUBLE / {columns}) * 100 AS k,
            CASE WHEN kinds > 0 THEN (1 - failures / (total * kinds)) * 100 ELSE 100.0::DOUBLE END AS v FROM counts)""",
        "scored AS (SELECT *, round(0.35 * c + 0.25 * u + 0.20 * k + 0.20 * v, 1)::DOUBLE AS overall FROM parts)",
    ]


DIRTY_KINDS = [(c, "number" if c in NUMBER_COLUMNS else "text") for c in COLUMNS]
DIRTY_PROFILE = profile_ctes("dirty_sales", DIRTY_KINDS, "order_date", ("quantity", "unit_price"))
CLASS_COLUMNS = (
    "column_name, inferred_type, null_count, null_percentage, unique_count, outliers_count, negatives_count, "
    "invalid_dates_count, invalid_emails_count, has_spaces, has_mixed_case, issues"
)


def classes(profile: DatasetProfile) -> DataFrame:
    rows = profile.columns_frame()
    issues = F.when(F.size("quality_issues") > 0, F.array_join("quality_issues", "; ")).otherwise("Clean")
    return rows.select(
        "column_name", "inferred_type", "null_count", "null_percentage", "unique_count", "outliers_count",
        "negatives_count", "invalid_dates_count", "invalid_emails_count",
        F.col("has_leading_trailing_spaces").alias("has_spaces"), "has_mixed_case", issues.alias("issues"),
    )


@query("column_classes", with_dirty(f"SELECT {CLASS_COLUMNS} FROM described", *DIRTY_PROFILE))
def column_classes(spark, folder):
    return classes(profile_dataset(stored_sales(spark, folder)))


# The given tables, each column with its kind, the date role and the money roles their headers imply.
GIVEN = {
    "lineitem": (
        [("l_orderkey", "number"), ("l_partkey", "number"), ("l_suppkey", "number"), ("l_linenumber", "number"),
         ("l_quantity", "number"), ("l_extendedprice", "number"), ("l_discount", "number"), ("l_tax", "number"),
         ("l_returnflag", "text"), ("l_linestatus", "text"), ("l_shipdate", "time")],
        "l_shipdate", ("l_extendedprice", "l_quantity"),
    ),
    "orders": (
        [("o_orderkey", "number"), ("o_custkey", "number"), ("o_orderstatus", "text"), ("o_totalprice", "number"),
         ("o_orderdate", "time"), ("o_orderpriority", "text")],
        "o_orderdate", ("o_totalprice",),
    ),
    "customer": (
        [("c_custkey", "number"), ("c_name", "text"), ("c_nationkey", "number"), ("c_acctbal", "number"),
         ("c_mktsegment", "text")],
        None, (),
    ),
    "supplier": (
        [("s_suppkey", "number"), ("s_name", "text"), ("s_nationkey", "number"), ("s_acctbal", "number")], None, (),
    ),
    "part": (
        [("p_partkey", "number"), ("p_name", "text"), ("p_brand", "text"), ("p_type", "text"), ("p_size", "number"),
         ("p_retailprice", "number")],
        None, ("p_retailprice",),
    ),
    "events": (
        [("event_id", "number"), ("ts", "time"), ("user_id", "number"), ("event_type", "text"), ("value", "number"),
         ("props", "text")],
        None, ("ts",),
    ),
    "labels": ([("doc_id", "number"), ("quality", "number"), ("toxic", "number")], None, ()),
    "conversations": (
        [("conv_id", "number"), ("turn", "number"), ("role", "text"), ("text", "text")], None, ("turn",),
    ),
    "nation": ([("n_nationkey", "number"), ("n_name", "text"), ("n_regionkey", "number")], None, ()),
}


DOCUMENT_KINDS = [("doc_id", "number"), ("text", "text"), ("lang", "text"), ("source", "text"), ("n_chars", "number")]


_ANSWERS = {
    "large": "o_totalprice > 100000", "answer": "CASE WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'NO' END",
    "digit": "CASE WHEN o_custkey % 2 = 0 THEN '1' END", "word": "CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'maybe' END",
}


@query(
    "boolean_classes",
    union_all([
        f"""SELECT '{c}' AS column_name, '{kind}' AS inferred_type, count(*) - count({e}) AS null_count, count(DISTINCT {e}) AS unique_count FROM orders"""
        for (c, e), kind in zip(_ANSWERS.items(), ("Boolean", "Boolean", "Numeric", "Categorical"))
    ]),
)
def boolean_classes(spark, folder):
    """Flags, and texts that say yes and no; digits in a text are numbers first."""
    answers = table(spark, folder, "orders").select(*[F.expr(e).alias(c) for c, e in _ANSWERS.items()])
    return profile_dataset(answers).columns_frame().select("column_name", "inferred_type", "null_count", "unique_count")


def _register_given(name: str) -> None:
    columns, date, money = GIVEN[name]
    ctes = profile_ctes(name, columns, date, money)

    @query(f"column_classes_{name}", f"WITH {', '.join(ctes)} SELECT {CLASS_COLUMNS} FROM described")
    def column_classes_of(spark, folder):
        return classes(profile_dataset(table(spark, folder, name)))

    _register_inferred(name, columns, ctes)


def _register_inferred(name: str, columns: list, ctes: list[str]) -> None:
    @query(f"inferred_classes_{name}", f"WITH {', '.join(ctes)} SELECT column_name, inferred_type FROM described")
    def inferred_classes_of(spark, folder):
        return classify_columns(table(spark, folder, name)).drop("position")


for _name in GIVEN:
    _register_given(_name)


_register_inferred("documents", DOCUMENT_KINDS, profile_ctes("documents", DOCUMENT_KINDS, None, ()))


@query("column_classes_documents")
def column_classes_documents(spark, folder):
    return classes(profile_dataset(table(spark, folder, "documents")))


@query("column_classes_embeddings")
def column_classes_embeddings(spark, folder):
    return classes(profile_dataset(table(spark, folder, "embeddings")))


_SUMMARY = f"""SELECT total::BIGINT AS total_rows, 11::BIGINT AS total_columns, (total * 11)::BIGINT AS total_cells,
missing::BIGINT AS total_missing_cells, round(missing * 100.0::DOUBLE / (total * 11), 2) AS missing_cells_pct,
dups::BIGINT AS total_duplicate_rows, round(dups * 100.0::DOUBLE / total, 2) AS duplicate_rows_pct,
(SELECT count(*) FROM described WHERE inferred_type = 'Numeric') AS numeric_columns,
(SELECT count(*) FROM described WHERE inferred_type = 'Categorical') AS categorical_columns,
(SELECT count(*) FROM described WHERE inferred_type = 'Datetime') AS datetime_columns,
(SELECT count(*) FROM described WHERE inferred_type = 'Boolean') AS boolean_columns,
(SELECT count(*) FROM described WHERE inferred_type = 'Text/ID') AS text_columns FROM scored"""


@query("dataset_profile", with_dirty(_SUMMARY, *DIRTY_PROFILE, *score_ctes("dirty_sales", 11)))
def dataset_profile(spark, folder):
    return profile_dataset(stored_sales(spark, folder)).summary_frame()


SCORE = """SELECT overall AS overall_score, CASE WHEN overall >= 90 THEN 'Excellent' WHEN overall >= 75 THEN 'Good'
WHEN overall >= 60 THEN 'Fair' WHEN overall >= 40 THEN 'Poor' ELSE 'Critical' END AS grade,
round(c, 1)::DOUBLE AS completeness_score, round(u, 1)::DOUBLE AS uniqueness_score,
round(k, 1)::DOUBLE AS consistency_score, round(v, 1)::DOUBLE AS validity_score,
CASE WHEN overall >= 85 THEN 'green' WHEN overall >= 70 THEN 'blue' WHEN overall >= 50 THEN 'amber' ELSE 'red' END AS gauge_band
FROM scored"""


def score(profile: DatasetProfile) -> DataFrame:
    return profile.quality.frame(profile.spark).drop("summary_text", "recommendations")


@query("quality_score", with_dirty(SCORE, *DIRTY_PROFILE, *score_ctes("dirty_sales", 11)))
def quality_score(spark, folder):
    return score(profile_dataset(stored_sales(spark, folder)))


@query(
    "quality_score_lineitem",
    f"WITH {', '.join(profile_ctes('lineitem', *GIVEN['lineitem']) + score_ctes('lineitem', 11))} {SCORE}",
)
def quality_score_lineitem(spark, folder):
    return score(profile_dataset(table(spark, folder, "lineitem")))


@query(
    "quality_recommendations",
    with_dirty(
        """SELECT 'Remove ' || dups::BIGINT || ' duplicate records.' AS recommendation FROM scored WHERE dups > 0
        UNION ALL SELECT 'Impute or handle ' || missing::BIGINT || ' missing cells across columns.' FROM scored WHERE missing > 0
        UNION ALL SELECT 'Apply text standardization to fix whitespace and casing inconsistencies.' FROM scored WHERE uneven > 0
        UNION ALL SELECT 'Resolve format anomalies in date, email, or negative quantity fields.' FROM scored WHERE failures > 0
        UNION ALL SELECT 'Dataset meets professional quality benchmarks.' FROM scored WHERE dups + missing + uneven + failures = 0""",
        *DIRTY_PROFILE, *score_ctes("dirty_sales", 11),
    ),
)
def quality_recommendations(spark, folder):
    found = profile_dataset(stored_sales(spark, folder)).quality.frame(spark)
    return found.select(F.explode("recommendations").alias("recommendation"))


# ---- duplicates ----------------------------------------------------------------------------------

@query("dedupe_full", with_dirty(f"SELECT DISTINCT {ROW} FROM dirty_sales"))
def dedupe_full(spark, folder):
    return duplicates.drop_duplicate_rows(dirty_sales(spark, folder))


def _by_text(order: str) -> str:
    return f"""SELECT doc_id, lang, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id {order}) AS rn
    FROM documents) WHERE rn = 1"""


@query("dedupe_by_key_first", _by_text("ASC"))
def dedupe_by_key_first(spark, folder):
    return duplicates.dedupe_by_key(table(spark, folder, "documents"), ["text"], ["doc_id"], "first").drop("text")


@query("dedupe_by_key_last", _by_text("DESC"))
def dedupe_by_key_last(spark, folder):
    return duplicates.dedupe_by_key(table(spark, folder, "documents"), ["text"], ["doc_id"], "last").drop("text")
