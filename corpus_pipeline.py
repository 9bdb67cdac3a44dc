"""Documents to packed training sequences: five stages, each written as Parquet and read by the next."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrinse.llm import catalog, decontaminate, line_dedup, near_duplicates, packing, quality_rules
from sparkrinse.staging import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that pass the fixed rules and the fences of their language and source."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without lines that stand earlier; ``n_chars`` follows the text."""
    kept = line_dedup.drop_duplicate_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in kept.columns else kept


def near(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of every group of near duplicates, five words and a similarity of 0.8."""
    return near_duplicates.keep_one(docs, numerator=80, denominator=100)


def benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    return decontaminate.drop_contaminated(docs, catalog.table(spark, folder, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Where each piece of each document stands in the packed sequences."""
    return packing.pack_documents(docs, catalog.word_tokenizer())


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near dedup", near),
    ("decontamination", benchmark),
    ("packing", sequences),
]
# Edit distance joins, components and packing have no SQL form; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the ``documents`` table."""
    docs = catalog.table(spark, folder, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, folder), "corpus-" + name.replace(" ", "-"))
    return docs
