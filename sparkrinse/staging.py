"""Materialise an intermediate result on shared storage so several jobs can read it back.

A written table survives the loss of executors and is column-pruned by every later read, which a
cached copy is not. The folder is the one the cluster names in ``spark.checkpoint.dir``.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_staged: dict[str, list[str]] = {}
# Spark's setting by which a finished job's shuffle files go at once.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Tasks of a bounded size whatever the table's: many partitions are written, and adaptive execution joins small
# ones up to 4 MB of shuffled bytes, some 200,000 joined rows; a task of a scan reads 16 MB.
_SMALL_TASKS = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
    "spark.sql.files.maxPartitionBytes": "16m",
}


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/sparkrinse/{label}-{uuid.uuid4().hex}"
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stage(df: DataFrame, label: str, compression: str = "snappy", small_tasks: bool = False) -> DataFrame:
    """Write ``df`` once as parquet and return a frame that reads it; ``zstd`` takes less disk and more time.

    What the job shuffled is deleted as soon as it is written, not when the driver's memory is next cleaned.
    ``small_tasks`` is for jobs that group very many wide keys, whose tasks would else hold more the larger the table.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    settings = {_CLEANUP: "true"} | (_SMALL_TASKS if small_tasks else {})
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df.write.parquet(path, compression=compression)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_path = path
    return staged


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(staged: DataFrame) -> None:
    """Delete what ``stage`` wrote for this frame, once everything built on it has been staged itself."""
    spark = staged.sparkSession
    _staged[spark.sparkContext.applicationId].remove(staged.staged_path)
    _delete(spark, staged.staged_path)


def release(spark: SparkSession) -> int:
    """Delete what this application staged, once no result built on it is needed any more."""
    paths = _staged.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)
