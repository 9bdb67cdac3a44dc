"""Sinks: the cleaned table, the audit log and the report bundle."""
from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST_FOLDER = "manifest"
MANIFEST = "version STRING, name STRING, path STRING, format STRING, rows BIGINT, schema STRING"


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "errorifexists"
) -> None:
    """The whole cleaned table, one file per task."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_audit(audit: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The audit log, a few dozen rows, as a single CSV file in the order of its steps."""
    ordered = audit.coalesce(1).sortWithinPartitions("step")
    ordered.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_report(tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """One sub-folder per report table."""
    for name, table in tables.items():
        write_table(table, f"{folder.rstrip('/')}/{name}", fmt=fmt, mode=mode)


def publish_report(tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> str:
    """All tables or none: they go to a fresh folder below ``folder``, and a manifest names them last.

    Readers follow the latest manifest, so a run that fails half-way leaves what was there before, and a
    repeated run replaces it. The name of the new version is returned.
    """
    if not tables:
        raise ValueError("a report needs at least one table")
    root, version = folder.rstrip("/"), uuid.uuid4().hex
    entries = []
    for name, table in tables.items():
        seen = Observation()
        write_table(table.observe(seen, F.count(F.lit(1)).alias("rows")), f"{root}/{version}/{name}", fmt=fmt)
        entries.append((version, name, f"{version}/{name}", fmt, seen.get["rows"], table.schema.json()))
    spark = next(iter(tables.values())).sparkSession
    manifest = spark.createDataFrame(entries, MANIFEST).withColumn("written", F.current_timestamp())
    # One file, which appears whole or not at all.
    manifest.coalesce(1).write.mode("append").parquet(f"{root}/{MANIFEST_FOLDER}")
    return version


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``version, name, path, format, rows, schema`` of the tables of the latest report in ``folder``."""
    every = spark.read.parquet(f"{folder.rstrip('/')}/{MANIFEST_FOLDER}")
    latest = every.agg(F.max(F.struct("written", "version"))["version"].alias("version"))
    return every.join(F.broadcast(latest), "version").drop("written")


def read_report(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the latest report, by name."""
    return {
        line["name"]: spark.read.format(line["format"]).schema(T.StructType.fromJson(json.loads(line["schema"])))
        .option("header", True).option("escape", '"').load(f"{folder.rstrip('/')}/{line['path']}")
        for line in read_manifest(spark, folder).collect()
    }
