"""Top values and classes without a shuffle of all values."""
from pyspark.sql import functions as F

from sparkrinse.operators import frequency, profile
from sparkrinse.staging import stage


def skewed(spark):
    """Twenty thousand values, three of them frequent; and columns of other shapes."""
    i = F.col("id")
    hot = F.when(i % 10 < 3, F.concat(F.lit("hot"), (i % 10).cast("string")))
    return spark.range(30_000, numPartitions=4).select(
        i.alias("number"),
        F.coalesce(hot, F.concat(F.lit("v"), i.cast("string"))).alias("few hot"),
        F.when(i % 4 == 0, None).when(i % 10 < 3, (i % 3) * 0.5).otherwise(i * -1.25).alias("doubles"),
        F.when(i % 2 == 0, F.lit("x" * 300)).otherwise(F.concat(F.lit("y" * 280), (i % 5).cast("string"))).alias("long"),
        F.when(i % 3 == 0, None).otherwise(i % 7).cast("int").alias("small"),
        F.when(i % 5 == 0, F.lit(float("nan"))).when(i % 2 == 0, F.lit(-0.0)).otherwise(F.lit(0.0)).alias("zeros"),
        (i % 2 == 0).alias("flag"),
        F.lit(None).cast("string").alias("empty"),
        F.date_add(F.lit("2020-01-01").cast("date"), (i % 11).cast("int")).alias("day"),
        ((i % 9) / 3).cast("decimal(8,3)").alias("exact"),
    )


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_same_as_counting_all_values(spark, monkeypatch):
    df = skewed(spark)
    for missing in (False, True):
        expected = rows(frequency.first_values(frequency.value_frequencies(df, df.columns, keep_missing=missing), 3))
        counted = []
        whole = frequency.value_frequencies
        with monkeypatch.context() as patch:
            patch.setattr(frequency, "value_frequencies", lambda d, columns, *a, **k: counted.extend(columns) or whole(d, columns, *a, **k))
            assert rows(frequency.top_values(df, df.columns, 3, keep_missing=missing)) == expected
        # only where all values are equally rare, or too long to be tracked, they are all counted
        assert set(counted) <= {"number", "long", "exact", "doubles"}, counted


def test_more_asked_for_than_stand_out(spark):
    df = skewed(spark).select("few hot", "small")
    expected = rows(frequency.first_values(frequency.value_frequencies(df, df.columns), 10))
    assert rows(frequency.top_values(df, df.columns, 10)) == expected


def test_empty_table(spark):
    df = skewed(spark).where("number < 0")
    assert rows(frequency.top_values(df, df.columns, 5)) == []
    assert {r["inferred_type"] for r in profile.classify_columns(df.select("long", "small")).collect()} == {
        r.inferred_type for r in profile.profile_dataset(df.select("long", "small")).columns.values()
    }


def test_classes_are_those_of_the_profile(spark):
    i = F.col("id")
    df = spark.range(4_000).select(
        i.alias("row_id"), F.concat(F.lit("n"), i % 200).alias("at gate"), F.concat(F.lit("n"), i % 201).alias("beyond gate"),
        F.concat(F.lit("n"), i).alias("free text"), F.when(i % 2 == 0, "Yes").otherwise("no").alias("answer"),
        F.when(i % 2 == 0, "Yes").otherwise("maybe").alias("other"), i.cast("string").alias("spelled"), (i % 2 == 0).alias("flag"),
        F.lit(None).cast("string").alias("nothing"), F.lit("x").alias("order date"), F.array(i).alias("nested"),
        F.lit(None).cast("timestamp").alias("unset"), F.current_date().alias("today"),
    )
    expected = {c: p.inferred_type for c, p in profile.profile_dataset(df).columns.items()}
    found = {r["column_name"]: r["inferred_type"] for r in profile.classify_columns(df).collect()}
    assert found == expected
    assert found["at gate"] == "Categorical" and found["beyond gate"] == "Text/ID" and found["answer"] == "Boolean"


def test_texts_are_no_shuffle_keys_when_only_classes_are_asked_for(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(profile.frequency, "value_frequencies", lambda df, columns: asked.extend(columns))
    df = spark.range(5_000).select(F.concat(F.lit("a text "), F.col("id")).alias("text"), (F.col("id") * 2).alias("n"))
    assert {r["inferred_type"] for r in profile.classify_columns(df).collect()} == {"Text/ID", "Numeric"}
    assert asked == []


def test_values_beyond_number_are_grouped_in_small_tasks(spark, monkeypatch):
    asked = []

    def watched(df, label, **options):
        asked.append((label, options))
        return stage(df, label, **options)

    monkeypatch.setattr(frequency, "stage", watched)
    df = spark.range(40_000).selectExpr("id", "cast(id % 3 as string) as few")
    got = {(r.column_name, r["rank"]): (r.value, r.n) for r in frequency.top_values(df, ["id", "few"], 2).collect()}
    assert got == {("id", 1): ("0", 1), ("id", 2): ("1", 1), ("few", 1): ("0", 13_334), ("few", 2): ("1", 13_333)}
    assert ("top-values", {"small_tasks": True}) in asked


def test_little_but_the_outermost_values_is_sorted(spark):
    df = skewed(spark).withColumn("twice", F.when(F.col("number") % 100 == 7, F.col("number") - 1).otherwise(F.col("number")))
    for missing in (False, True):
        values = stage(frequency.value_frequencies(df, df.columns, keep_missing=missing), "values")
        for k in (1, 5):
            outer = stage(frequency.outermost(values, k), "outermost")
            for by_count in (True, False):
                assert rows(frequency.first_values(outer, k, by_count)) == rows(frequency.first_values(values, k, by_count))
        left = dict(outer.where("column_name in ('number', 'twice', 'doubles')").groupBy("column_name").count().collect())
        assert left["number"] < 200 and left["twice"] < 600 and left["doubles"] < 200
    assert frequency.outermost(values.where("false"), 5).count() == 0


def test_profiles_sort_few_numbers(spark, monkeypatch):
    sizes = {}

    def watched(df, label, *rest, **options):
        out = stage(df, label, *rest, **options)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(profile, "stage", watched)
    found = profile.profile_dataset(spark.range(20_000).withColumn("half", F.col("id") / 2)).columns
    assert found["id"].sample_values == [str(i) for i in range(5)] and found["half"].top_values[1] == ("0.5", 1)
    assert sizes["values"] == 40_000 and sizes["outermost"] < 1000
