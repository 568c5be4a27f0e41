"""The corpus pipeline: quality, repeated lines, near duplicates, benchmark leaks, mixture.

Each stage takes what its predecessor kept, written as Parquet and read again. All but the last return the columns
of ``documents``; the last adds the domain, the rate and the number of copies. No SQL states the whole: two stages
are fitted models (``tests/llm`` compares the others with brute force and follows the documents through all).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glassledger.llm.decontamination import decontaminate
from glassledger.llm.line_dedup import without_repeated_lines
from glassledger.llm.mixing import mixture
from glassledger.llm.near_dedup import near_duplicates
from glassledger.llm.quality_classifier import good_documents
from glassledger.llm.store import keep
from glassledger.plans.joins import where_computed
from glassledger.session import ship_package

SIMILAR = 80

def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    ship_package(spark)
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go, and documents of which no word is left; others stay."""
    ship_package(spark)
    return where_computed(without_repeated_lines(docs, short_repeats=True), F.col("text").rlike("[^\\x20\\x09-\\x0D]"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (``SIMILAR`` hundredths of their shingles or more) the document of the smallest doc_id stays."""
    ship_package(spark)
    judged = near_duplicates(docs, SIMILAR).groupBy(F.col("doc_id").alias("_doc")).agg(F.max("kept").alias("_kept"))
    gone = keep(judged.where(~F.col("_kept")).select("_doc"), "near-copies")
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("_doc")), "left_anti")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    ship_package(spark)
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = keep(where_computed(found, F.col("contaminated")).select(F.col("doc_id").alias("_doc")).distinct(), "leaks")
    return docs.join(leaks, docs["doc_id"].eqNullSafe(F.col("_doc")), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken at the rates that meet the target weights."""
    ship_package(spark)
    return mixture(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("benchmark", benchmark), ("mix", mix)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    name, last = STAGES[-1]
    return last(spark, docs, sf_dir)
