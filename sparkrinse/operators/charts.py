"""The data behind each chart; drawing them is left to whatever front end is at hand."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from sparkrinse import schema
from sparkrinse.functions.numbers import to_number
from sparkrinse.operators.analytics import revenue_by, value_distribution
from sparkrinse.operators.quantiles import quantiles
from sparkrinse.operators.semantics import SemanticMapping

HISTOGRAM_BINS = 30
EXPLORER_BINS = 35
CATEGORY_BARS, PRODUCT_BARS, REPORT_PRODUCTS = 7, 8, 6
TRENDLINE_MINIMUM = 5
OUTLIER_POINTS = 100


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins between minimum and maximum, empty bins included.

    The last bin is closed. A constant column gets half a unit of room on either side.
    """
    x = to_number(schema.col(column), schema.type_of(df, column))
    numbers = df.select(x.alias("x")).where(F.col("x").isNotNull())
    ends = numbers.agg(F.min("x").alias("low"), F.max("x").alias("high")).first()
    spark = df.sparkSession
    shape = "bin INT, bin_start DOUBLE, bin_end DOUBLE, n BIGINT"
    if ends["low"] is None:
        return spark.createDataFrame([], shape)
    low, high = ends["low"], ends["high"]
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    place = F.least(F.floor((F.col("x") - low) / (high - low) * bins), F.lit(bins - 1)) + 1
    counted = numbers.groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = spark.range(1, bins + 1, numPartitions=1).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select(
        "bin",
        (F.lit(low) + (F.col("bin") - 1) * width).alias("bin_start"),
        (F.lit(low) + F.col("bin") * width).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def _fences(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """``label, n, q25, median, q75, low_fence, high_fence`` per group, without a label for the whole."""
    spread = quantiles(df, [column], (0.25, 0.5, 0.75), by=keys)
    reach = (F.col("q")[2] - F.col("q")[0]) * 1.5
    return spread.select(
        *[schema.col(k).alias("label") for k in keys],
        "n",
        F.col("q")[0].alias("q25"),
        F.col("q")[1].alias("median"),
        F.col("q")[2].alias("q75"),
        (F.col("q")[0] - reach).alias("low_fence"),
        (F.col("q")[2] + reach).alias("high_fence"),
    )


def box_outliers(df: DataFrame, column: str, key: Sequence[str], by: str | None = None, limit: int = OUTLIER_POINTS) -> DataFrame:
    """``label, rank, x`` and the key of up to ``limit`` points per group beyond the fences, the farthest first.

    Equally far points are ordered by the key. Every task forwards ``limit`` points of a group at most, and
    only points beyond the fences are ordered, so a hot group gathers nowhere.
    """
    keys = [by] if by else []
    fences = _fences(df, column, keys).withColumn("label", F.col("label") if by else F.lit(None).cast("string"))
    fences = fences.select("label", "low_fence", "high_fence")
    x = to_number(schema.col(column), schema.type_of(df, column))
    label = schema.col(by) if by else F.lit(None).cast("string")
    points = df.select(label.alias("label"), x.alias("x"), F.struct(*[schema.col(k).alias(k) for k in key]).alias("key")).where(F.col("x").isNotNull())
    same = points["label"].eqNullSafe(fences["label"])
    beyond = points.join(fences, same).select(
        points["label"], "x", "key", F.greatest(F.col("low_fence") - F.col("x"), F.col("x") - F.col("high_fence")).alias("distance")
    ).where(F.col("distance") > 0)
    order = F.row_number().over(Window.partitionBy("label").orderBy(F.col("distance").desc(), "key"))
    found = beyond.withColumn("rank", order).where(F.col("rank") <= limit)
    return found.select(*(["label"] if by else []), "rank", "x", "key.*")


def box_statistics(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """Quartiles, whiskers within the fences, and how many points lie beyond them, per group."""
    keys = [by] if by else []
    fences = _fences(df, column, keys)
    x = to_number(schema.col(column), schema.type_of(df, column))
    points = df.select(*[schema.col(k).alias("label") for k in keys], x.alias("x")).where(F.col("x").isNotNull())
    if not by:
        return _whole_box(points, fences.first())
    # values are counted before the join, so a hot group crosses it once per distinct value
    points = points.groupBy("label", "x").agg(F.count(F.lit(1)).alias("c"))
    inside = (F.col("x") >= F.col("low_fence")) & (F.col("x") <= F.col("high_fence"))
    return points.join(fences, "label").groupBy("label").agg(
        F.first("n").alias("n"),
        F.first("q25").alias("q25"),
        F.first("median").alias("median"),
        F.first("q75").alias("q75"),
        F.min(F.when(inside, F.col("x"))).alias("low_whisker"),
        F.max(F.when(inside, F.col("x"))).alias("high_whisker"),
        F.sum(F.when(inside, 0).otherwise(F.col("c"))).alias("outliers_count"),
    )


def _whole_box(points: DataFrame, edges: Row | None) -> DataFrame:
    """Without groups one aggregation over the rows suffices, and nothing is shuffled but its result."""
    if edges is None or not edges["n"]:
        shape = "n BIGINT, q25 DOUBLE, median DOUBLE, q75 DOUBLE, low_whisker DOUBLE, high_whisker DOUBLE, outliers_count BIGINT"
        return points.sparkSession.createDataFrame([], shape)
    x = F.col("x")
    inside = (x >= F.lit(edges["low_fence"])) & (x <= F.lit(edges["high_fence"]))
    return points.agg(
        F.lit(edges["n"]).cast("bigint").alias("n"),
        *[F.lit(edges[c]).alias(c) for c in ("q25", "median", "q75")],
        F.min(F.when(inside, x)).alias("low_whisker"),
        F.max(F.when(inside, x)).alias("high_whisker"),
        F.count_if(~inside).alias("outliers_count"),
    )


def trendlines(df: DataFrame, x: str, y: str, by: str | None = None) -> DataFrame:
    """Least-squares line per colour group; none for tables of five rows or fewer."""
    across = to_number(schema.col(x), schema.type_of(df, x))
    up = to_number(schema.col(y), schema.type_of(df, y))
    keys = [schema.col(by).cast("string").alias("label")] if by else []
    rows = df.select(*keys, across.alias("x"), up.alias("y"))
    if len(df.head(TRENDLINE_MINIMUM + 1)) <= TRENDLINE_MINIMUM:
        rows = rows.limit(0)
    labels = ["label"] if by else []
    if by:
        rows = rows.where(F.col("label").isNotNull())
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    spread_x = F.var_pop(F.when(both, F.col("x")))
    slope = F.try_divide(F.covar_pop("x", "y"), spread_x)
    fitted = rows.groupBy(*labels).agg(
        F.regr_count("y", "x").alias("n"),
        slope.alias("slope"),
        (F.avg(F.when(both, F.col("y"))) - slope * F.avg(F.when(both, F.col("x")))).alias("intercept"),
        F.pow(
            F.try_divide(F.covar_pop("x", "y"), F.sqrt(spread_x) * F.stddev_pop(F.when(both, F.col("y")))), F.lit(2.0)
        ).alias("r2"),
    )
    return fitted


def scatter_points(df: DataFrame, x: str, y: str, by: str | None = None, fraction: float | None = None) -> DataFrame:
    """The rows to draw: all of them, or about ``fraction`` of them chosen by a hash of the row."""
    chosen = [schema.col(c) for c in dict.fromkeys(c for c in (x, y, by) if c)]
    points = df.select(*chosen)
    if fraction is None:
        return points
    hashed = F.xxhash64(*[schema.col(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()])
    return df.where(F.pmod(hashed, F.lit(1_000_000)) < F.lit(round(fraction * 1_000_000))).select(*chosen)


def category_counts(df: DataFrame, column: str, top: int = 10) -> DataFrame:
    return value_distribution(df, column, top)


def share_of_total(parts: DataFrame, value: str, scale: int = 1) -> DataFrame:
    """Each row's share of the column total, for a donut. ``parts`` is already grouped."""
    total = parts.agg(F.sum(value).alias("t")).first()["t"]
    share = F.round(F.col(value) * 100.0 / F.lit(total), scale) if total else F.lit(0.0)
    return parts.withColumn("share", share)


def category_bars(df: DataFrame, roles: SemanticMapping, top: int = CATEGORY_BARS) -> DataFrame:
    return revenue_by(df, roles, roles.category, top)


def product_bars(df: DataFrame, roles: SemanticMapping, top: int = PRODUCT_BARS) -> DataFrame:
    return revenue_by(df, roles, roles.product, top)
