"""Joins of a large fact frame to a per-key summary of itself.

A summary is broadcast only when one column-pruned pass, or the written summary
itself, has shown that it fits ``BROADCAST_BYTES``. Beyond that the join is an ordinary shuffle join, where
adaptive execution splits the partitions of hot keys.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 1024 * 1024
_SKETCH_ERROR = 0.05


def where_computed(df: DataFrame, condition: Column) -> DataFrame:
    """A filter on a costly computed column that is not computed a second time.

    The optimizer moves a filter below the projection that makes its column and
    repeats the expression there. It does not do so across a task-dependent column,
    so the partition number is put in between. Not for stored columns: their filters should move.
    """
    tag = "_partition"
    return df.withColumn(tag, F.spark_partition_id()).where(condition & (F.col(tag) >= 0)).drop(tag)


@dataclass(frozen=True)
class KeySize:
    """Upper estimates of how many keys there are and how long the longest is."""

    keys: int
    widest: int

    def fits(self, extra_bytes: int) -> bool:
        return self.keys * (self.widest + extra_bytes) <= BROADCAST_BYTES


def measure_keys(df: DataFrame, keys: dict[str, Column]) -> dict[str, KeySize]:
    """One job over the key columns only: sketch of distinct keys, widest key."""
    aggs = []
    for name, c in keys.items():
        aggs.append(F.approx_count_distinct(c, _SKETCH_ERROR).alias(f"{name}__n"))
        aggs.append(F.max(F.octet_length(c.cast("string"))).alias(f"{name}__w"))
    row = df.agg(*aggs).first()
    # four standard errors of head-room over the sketch
    return {
        name: KeySize(int(row[f"{name}__n"] * (1 + 4 * _SKETCH_ERROR)) + 1, row[f"{name}__w"] or 0)
        for name in keys
    }


def summary_size(summary: DataFrame, on: str) -> KeySize:
    """The exact size of a summary that has been written, one row a key."""
    row = summary.agg(F.count("*").alias("n"), F.max(F.octet_length(F.col(on).cast("string"))).alias("w")).first()
    return KeySize(row["n"], row["w"] or 0)


def join_summary(
    fact: DataFrame, summary: DataFrame, on: str, size: KeySize, extra_bytes: int = 48, how: str = "left"
) -> DataFrame:
    # a summary has one row a key: its partitions are hashed, as sorting the wide rows would cost more than the join
    summary = F.broadcast(summary) if size.fits(extra_bytes) else summary.hint("shuffle_hash")
    return fact.join(summary, on, how)
