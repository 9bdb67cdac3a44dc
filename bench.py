"""Time the headline queries and print one JSON line."""
from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

from workload.catalog import QUERIES

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "missing_by_column", "dup_count_lineitem", "top5_by_column", "email_validation", "date_validation",
    "iqr_outliers", "column_classes_lineitem", "quality_score", "dedupe_full", "cap_iqr_lineitem",
    "clean_default", "monthly_revenue", "monthly_revenue_cleaned", "kpi_sales", "describe_stats",
    "cat_distributions", "corr_matrix", "histogram30", "box_overall", "ols_by_group", "csv_round_trip",
)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="sparkrinse-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or HEADLINE
    # One small scan so that no query pays for starting the engine.
    spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(FOLDER).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
