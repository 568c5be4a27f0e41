"""Exact linear-interpolated quantiles that hold at any row count.

The value range is narrowed by counting rows per bucket (a small aggregate)
until the rows around each wanted rank are few, and only those are ranked by the
built-in ``percentile``. The values are kept between passes, so whatever made
them runs once.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BUCKETS = 2048


def interpolated_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], weight: str | None = None, direct_limit: int = 20_000
) -> list[float | None]:
    """Quantiles of a double column; ``weight`` holds how often each row counts."""
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    vals = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), w.alias("w"))
    vals = vals.persist()
    try:
        head = vals.agg(
            F.sum("w").alias("n"), F.count("*").alias("rows"), F.min("v").alias("lo"), F.max("v").alias("hi")
        ).first()
        if not head["n"]:
            return [None] * len(probs)
        ranks = {p: p * (head["n"] - 1) for p in probs}
        wanted = sorted({r for pos in ranks.values() for r in (math.floor(pos), math.ceil(pos))})
        at = _values_at_ranks(vals, wanted, head["lo"], head["hi"], direct_limit)
        out = []
        for p in probs:
            lo, hi = math.floor(ranks[p]), math.ceil(ranks[p])
            out.append(at[lo] + (at[hi] - at[lo]) * (ranks[p] - lo))
        return out
    finally:
        vals.unpersist()


def _values_at_ranks(
    vals: DataFrame, ranks: list[int], lo: float, hi: float, direct_limit: int, before: int = 0
) -> dict[int, float]:
    """The values at 0-based ``ranks`` (by weight), all between ``lo`` and ``hi``;
    ``before`` rows lie below ``lo``."""
    if lo == hi:
        return dict.fromkeys(ranks, lo)
    inside = vals.where((F.col("v") >= lo) & (F.col("v") <= hi))
    width = (hi - lo) / _BUCKETS
    splits = width > 0 and lo + width > lo
    bucket = F.least(F.floor((F.col("v") - lo) / width), F.lit(_BUCKETS - 1)) if splits else F.col("v")
    counts = (
        inside.groupBy(bucket.alias("b"))
        .agg(F.sum("w").alias("n"), F.count("*").alias("rows"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        .orderBy("b")
        .collect()  # at most _BUCKETS rows, or the few values left between two neighbouring doubles
    )
    out: dict[int, float] = {}
    for c in counts:
        mine = [r for r in ranks if before <= r < before + c["n"]]
        if mine:
            if c["lo"] == c["hi"]:
                out |= dict.fromkeys(mine, c["lo"])
            elif c["rows"] <= direct_limit:
                out |= _ranked(inside.where((F.col("v") >= c["lo"]) & (F.col("v") <= c["hi"])), mine, before)
            else:
                out |= _values_at_ranks(vals, mine, c["lo"], c["hi"], direct_limit, before)
        before += c["n"]
    return out


def _ranked(few: DataFrame, ranks: list[int], before: int) -> dict[int, float]:
    """Ranks among at most ``direct_limit`` rows."""
    rows = few.groupBy("v").agg(F.sum("w").alias("n")).orderBy("v").collect()
    out = {}
    for r in rows:
        out |= {k: r["v"] for k in ranks if before <= k < before + r["n"]}
        before += r["n"]
    return out
