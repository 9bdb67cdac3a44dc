"""Exact, linearly interpolated quantiles that never gather a column in one task.

Radix selection: every double has a 64-bit key in the same order. A pass counts the values by the next
sixteen bits of their keys, which is one aggregation with a partial count per task, and keeps the cell
that holds a wanted rank. Four passes decide every rank of every column and group, whatever the
distribution; fewer do where a cell holds one value, or so few that they are counted one by one.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrinse import schema
from sparkrinse.functions.numbers import outside, to_number
from sparkrinse.operators.frequency import numeric_value
from sparkrinse.staging import discard, stage

KEY_BITS, PASS_BITS = 64, 16
# A cell of so few occurrences is cut into single values at once.
LISTED = 32_768
# Fixed values of a double: bits of the fraction, and the exponent of the smallest full number.
FRACTION, SMALLEST = 52, -1022


def quantiles(df: DataFrame, columns: Sequence[str], points: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``by..., column_name, n, q`` with ``q`` an array aligned with ``points``.

    Rows whose group key is missing form no group, and a column without a number in a group has no row.
    ``df`` is read at most four times.
    """
    groups = list(by)
    numbers = df.select(
        *[schema.col(g).alias(f"__g{i}") for i, g in enumerate(groups)],
        *[to_number(schema.col(c), schema.type_of(df, c)).alias(c) for c in columns],
    )
    keys = [f"__g{i}" for i in range(len(groups))]
    for key in keys:
        numbers = numbers.where(F.col(key).isNotNull())
    long = numbers.unpivot(keys, [schema.col(c) for c in columns], "column_name", "x").withColumn("w", F.lit(1).cast("bigint"))
    found = located(long, [*keys, "column_name"], points)
    return found.select(*[F.col(f"__g{i}").alias(g) for i, g in enumerate(groups)], "column_name", "n", "q")


def with_key(long: DataFrame) -> DataFrame:
    """``x`` without negative zero, and its 64-bit key ``k``: the bits of the double, negative for a negative number."""
    size, e, power = F.abs("x"), F.col("__e"), F.col("__power")
    full = (size > 0) & (size < float("inf"))
    # The rounding of a logarithm may miss the exponent by one.
    over, under = (power > size) & (e > SMALLEST), power * 2 <= size
    found = (
        long.withColumn("__e", F.when(full, F.floor(F.log2(F.greatest(size, F.lit(2.0**SMALLEST)))).cast("int")))
        .withColumn("__power", F.pow(F.lit(2.0), e))
        .withColumns({"__e": F.when(over, e - 1).when(under, e + 1).otherwise(e), "__power": F.when(over, power / 2).when(under, power * 2).otherwise(power)})
    )
    bits = (e - SMALLEST).cast("bigint") * F.lit(2**FRACTION) + (size / power * F.lit(2.0**FRACTION)).cast("bigint")
    bits = F.when(full, bits).when(size > 0, F.lit(2047 * 2**FRACTION)).otherwise(F.lit(0).cast("bigint"))
    return found.withColumn("k", F.when(F.col("x") < 0, -bits).otherwise(bits)).withColumn(
        "x", F.when(F.col("x") == 0, F.lit(0.0)).otherwise(F.col("x"))
    ).drop("__e", "__power")


def located(long: DataFrame, keys: list[str], points: Sequence[float]) -> DataFrame:
    """``keys..., n, q`` for rows ``keys..., x, w``: value ``x`` occurs ``w`` times. The result is stored."""
    long = with_key(long.where(F.col("x").isNotNull()))
    at = [F.lit(float(p)) * (F.col("n") - 1) for p in points]
    wanted = F.array_distinct(F.array(*[side(a).cast("bigint") for a in at for side in (F.floor, F.ceil)]))
    cells = _counted(long.withColumn("cell", F.shiftright("k", KEY_BITS - PASS_BITS)), keys)
    n = F.sum("c").over(Window.partitionBy(*keys))
    chosen = cells.withColumn("n", n).withColumn("rank", F.explode(F.filter(wanted, lambda r: _holds(r, F.col("under")))))
    ranges = stage(_ranges(chosen, keys, F.col("under"), F.lit(KEY_BITS - PASS_BITS)), "quantile-ranges")
    while not (pending := ranges.where("value is null")).isEmpty():
        done = ranges.where("value is not null").unionByName(_narrowed(long, keys, pending))
        before, ranges = ranges, stage(done, "quantile-ranges")
        discard(before)
    ranked = ranges.groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
    found = []
    for a in at:
        low, high = (F.element_at("at", side(a).cast("bigint")) for side in (F.floor, F.ceil))
        share = a - F.floor(a)
        found.append(F.when(share == 0, low).otherwise(low * (1 - share) + high * share))
    result = stage(ranked.select(*keys, "n", F.array(*found).alias("q")), "quantiles")
    discard(ranges)
    return result


def _counted(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Occurrences ``c`` per cell with its ends ``a`` and ``b``, and how many are ``under`` it."""
    counts = cells.groupBy(*keys, "cell").agg(F.sum("w").alias("c"), F.min("x").alias("a"), F.max("x").alias("b"))
    return counts.withColumn("under", F.sum("c").over(Window.partitionBy(*keys).orderBy("cell")) - F.col("c"))


def _holds(rank: Column, start: Column) -> Column:
    return (start <= rank) & (rank < start + F.col("c"))


def _ranges(chosen: DataFrame, keys: list[str], below: Column, shift: Column) -> DataFrame:
    """Per wanted rank the cell it lies in, how much is below it and in it, and its value once there is one only."""
    # What the next pass leaves of the key.
    following = F.when(F.col("c") <= LISTED, 0).otherwise(F.greatest(shift - PASS_BITS, F.lit(0)))
    value = F.when(F.col("a") == F.col("b"), F.col("a"))
    return chosen.select(
        *keys, "n", "rank", F.col("cell").alias("prefix"), shift.cast("int").alias("shift"), following.cast("int").alias("following"),
        below.alias("below"), value.alias("value"),
    )


def _narrowed(long: DataFrame, keys: list[str], ranges: DataFrame) -> DataFrame:
    """One pass: the cell of each range that holds its rank, as the new range."""
    part = ["prefix", "shift", "following"]
    # Null-safe, so that no test of the whole key for null is pushed below the join.
    within = long.join(ranges.select(*keys, *part).distinct(), keys).where("shiftright(k, shift) <=> prefix")
    cells = _counted(within.withColumn("cell", F.expr("shiftright(k, following)")), [*keys, *part])
    chosen = ranges.select(*keys, *part, "n", "rank", "below").join(cells, [*keys, *part]).where(_holds(F.col("rank"), F.col("below") + F.col("under")))
    return _ranges(chosen, keys, F.col("below") + F.col("under"), F.col("following"))


def quantile_values(df: DataFrame, columns: Sequence[str], points: Sequence[float]) -> dict[str, list[float]]:
    """Quantiles of whole columns on the driver: one short list per column that has a value."""
    if not columns:
        return {}
    return {r["column_name"]: list(r["q"]) for r in quantiles(df, columns, points).collect()}


def value_quantiles(values: DataFrame, columns: Sequence[str], points: Sequence[float]) -> dict[str, list[float]]:
    """The same from the table of distinct values."""
    if not columns:
        return {}
    numbers = values.where(F.col("column_name").isin(*columns)).select("column_name", numeric_value().alias("x"), F.col("n").alias("w"))
    return {r["column_name"]: list(r["q"]) for r in located(numbers, ["column_name"], points).collect()}


def per_column_constants(settings: Mapping[str, Sequence[float]]) -> Column:
    """The constants of the row's column, from a literal of one short array per column."""
    entries = [part for c, v in settings.items() for part in (F.lit(c), F.array(*[F.lit(float(x)) for x in v]))]
    return F.element_at(F.create_map(*entries), F.col("column_name"))


def measure_spread(values: DataFrame, means: Mapping[str, float], fences: Mapping[str, tuple[float, float]]) -> DataFrame:
    """One row per numeric column: second and third moments about the mean, and occurrences beyond the fences."""
    settings = {c: (means[c], *fences[c]) for c in fences}
    numbers = values.where(F.col("column_name").isin(*fences)).select(
        "column_name", "n", numeric_value().alias("x"), per_column_constants(settings).alias("at")
    )
    gap = F.col("x") - F.col("at")[0]
    beyond = outside(F.col("x"), F.col("at")[1], F.col("at")[2])
    return numbers.groupBy("column_name").agg(
        F.sum(gap * gap * F.col("n")).alias("squares"),
        F.sum(gap * gap * gap * F.col("n")).alias("cubes"),
        F.sum(F.when(beyond, F.col("n")).otherwise(0)).alias("outliers"),
    )


def numeric_summaries(df: DataFrame, columns: Sequence[str]) -> dict[str, dict]:
    """Counts by sign, moments, quartiles and outliers of numeric columns, a few numbers each.

    A column without a number is left out.
    """
    quartiles = quantile_values(df, columns, (0.25, 0.5, 0.75))
    fences = iqr_fences(quartiles)
    columns = [c for c in columns if c in quartiles]
    if not columns:
        return {}
    typed = df.select(*[to_number(schema.col(c), schema.type_of(df, c)).alias(c) for c in columns])
    # The plan does not grow with the number of columns, so it stays compiled.
    limits = df.sparkSession.createDataFrame([(c, *map(float, fence)) for c, fence in fences.items()], "column_name STRING, low DOUBLE, high DOUBLE")
    x = F.col("x")
    rows = typed.unpivot([], [schema.col(c) for c in columns], "column_name", "x").where(x.isNotNull()).join(F.broadcast(limits), "column_name")
    measured = rows.groupBy("column_name").agg(
        F.count(x).alias("numbers"), F.avg(x).alias("mean"), F.min(x).alias("least"), F.max(x).alias("most"),
        F.var_pop(x).alias("variance"), F.skewness(x).alias("skewness"),
        F.count_if(x < 0).alias("negative"), F.count_if(x == 0).alias("zero"), F.count_if(x > 0).alias("positive"),
        F.count_if(outside(x, F.col("low"), F.col("high"))).alias("outliers"),
    )
    found = {line["column_name"]: line.asDict() for line in measured.collect()}
    for c, f in found.items():
        f |= {"quartiles": quartiles[c], "fence": fences[c], "squares": f["variance"] * f["numbers"]}
        f["cubes"] = (f["skewness"] or 0.0) * f["variance"] ** 1.5 * f["numbers"]
    return found


def iqr_fences(quartiles: Mapping[str, Sequence[float]]) -> dict[str, tuple[float, float]]:
    """Tukey's fences from (q25, ..., q75) of each column."""
    fences = {}
    for name, q in quartiles.items():
        reach = 1.5 * (q[-1] - q[0])
        fences[name] = (q[0] - reach, q[-1] + reach)
    return fences
