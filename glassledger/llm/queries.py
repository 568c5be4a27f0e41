"""The registered queries of this subpackage and their SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glassledger.llm import chat_format, decontamination, merkle, prefix_trie, substring_dedup, warc
from glassledger.llm.language_id import predict_language
from glassledger.llm.line_dedup import dedup_lines
from glassledger.llm.mixing import mixed
from glassledger.llm.near_dedup import near_duplicates
from glassledger.llm.quality_classifier import quality_scores
from glassledger.llm.quality_rules import quality_rules
from glassledger.llm.toxicity import toxicity_scores


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_read(spark, sf_dir, "documents"), short_repeats=True)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(_read(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_conversations(chat_format.with_probe(_read(spark, sf_dir, "conversations")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_language(_read(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_read(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_read(spark, sf_dir, "documents"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_index(_read(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_substring_dedup, op3_near_dedup, op4_mixing, op5_chat_format, op6_language_id, op7_quality_classifier, op8_quality_rules,
                                   op9_toxicity, op10_decontamination, op11_prefix_trie, op12_merkle_manifest, op13_warc)}
ORACLE = {"op2_substring_dedup": substring_dedup.ORACLE, "op5_chat_format": chat_format.ORACLE, "op10_decontamination": decontamination.ORACLE,
          "op11_prefix_trie": prefix_trie.ORACLE, "op12_merkle_manifest": merkle.ORACLE, "op13_warc": warc.ORACLE}
