"""Folds and bounded training samples over ``documents`` and ``labels``."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder() -> Column:
    """crc32 of the doc_id as text, modulo 5; null without an id."""
    return F.crc32(F.col("doc_id").cast("string")) % 5


def held_out() -> Column:
    """True in the fold nothing is learned from. A row without an id is in no fold."""
    return F.coalesce(remainder() == 0, F.lit(False))


def labels_to_learn(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of the learning folds. Of repeated rows the largest label counts."""
    return (labels.select("doc_id", F.col(label).cast("int").alias("label"))
            .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (remainder() != 0))
            .groupBy("doc_id").agg(F.max("label").alias("label")))


def sample_of_labels(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents, those of the smallest hash: the same ones in every run."""
    return labels_to_learn(labels, label).orderBy(F.xxhash64(F.lit(label), "doc_id"), "doc_id").limit(rows)


def sample_of_texts(documents: DataFrame, labels: DataFrame, label: str, rows: int, columns: tuple[str, ...] = ()) -> DataFrame:
    """The sample with its texts. Only ``rows`` ids and labels are broadcast, whatever the tables hold."""
    wanted = F.broadcast(sample_of_labels(labels, label, rows))
    return documents.select("doc_id", "text", *columns).join(wanted, "doc_id")
