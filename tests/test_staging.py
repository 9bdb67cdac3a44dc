import time

from pyspark.sql import functions as F

from sparkrinse import staging


def _shuffles(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {name for name in blocks.mkString(" ").split(" ") if name.startswith("shuffle_")}


def test_no_shuffle_files_stay(spark):
    before = _shuffles(spark)
    staged = staging.stage(spark.range(10_000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")), "counts")
    end = time.time() + 10
    while _shuffles(spark) - before and time.time() < end:
        time.sleep(0.1)
    assert not _shuffles(spark) - before
    assert spark.conf.get(staging._CLEANUP, "false") == "false"
    assert sorted(r.n for r in staged.collect()) == [1428, 1428, 1428, 1429, 1429, 1429, 1429]


def test_tasks_stay_small(spark):
    """Rows of about 6 MB in four partitions of the session, each over a megabyte: as many tasks as there are megabytes."""
    wide = spark.range(40_000).select(F.sha2(F.col("id").cast("string"), 512).alias("a"), F.sha2(F.col("id").cast("string"), 384).alias("b"))
    before = {key: spark.conf.get(key, None) for key in staging._SMALL_TASKS}
    staged = staging.stage(wide.groupBy("a", "b").agg(F.count("*").alias("n")), "wide", small_tasks=True)
    files = staged.select(F.input_file_name()).distinct().count()
    assert files > 4 and staged.count() == 40_000
    assert before == {key: spark.conf.get(key, None) for key in staging._SMALL_TASKS}
