"""Review reasons per vendor and statement, kept as rows until the end."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dollars, percent
from ..rules import eligibility as E
from ..rules import vendors as R

# order in which reasons are listed
PHASE = {"low_match": 1, "near_threshold": 2, "unknown_entity": 3, "normalisation": 4,
         "combined_total": 5, "mismatch": 6, "variant": 7}
KEY = ["statement", "canonical_name"]


def low_match(conf: Column) -> Column:
    text = F.concat(F.lit("Low name-match confidence ("), percent(conf), F.lit(") — verify this is the correct payee"))
    return F.when(conf < E.LOW_CONFIDENCE, text)


def near_threshold(total: Column) -> Column:
    start = F.concat(F.lit("Near-threshold ("), dollars(total), F.lit(") — "))
    text = F.when(total < R.THRESHOLD, F.concat(start, F.lit("may cross $600 with one more payment"))).otherwise(
        F.concat(start, F.lit("verify all payments captured before filing"))
    )
    return F.when(total.between(R.NEAR_LOW, R.NEAR_HIGH), text)


def unknown_entity(total: Column, entity: Column) -> Column:
    hit = (total >= R.THRESHOLD) & (F.coalesce(entity, F.lit("")) == "")
    return F.when(hit, "Entity type unknown — verify LLC/Corp/Individual via W-9 before filing decision")


def with_signals(vendors: DataFrame) -> DataFrame:
    """The three per-vendor signals; the rollup's own reason only if none of them fired."""
    own = F.concat_ws("; ", F.col("review_reasons"))
    carried = F.when(own != "", F.concat(F.lit("Flagged during normalization — "), own)).otherwise(
        "Flagged during normalization"
    )
    df = vendors.withColumns(
        {
            "low_match": low_match(F.col("match_confidence")),
            "near_threshold": near_threshold(F.col("total_amount")),
            "unknown_entity": unknown_entity(F.col("total_amount"), F.col("entity_type")),
        }
    )
    none = F.col("low_match").isNull() & F.col("near_threshold").isNull() & F.col("unknown_entity").isNull()
    return df.withColumn("normalisation", F.when(none & F.col("needs_review"), carried))


def statement_reasons(vendors: DataFrame) -> DataFrame:
    """Per-statement reasons as rows (statement, canonical_name, phase, at, signal, reason)."""
    df = with_signals(vendors)
    names = ["low_match", "near_threshold", "unknown_entity", "normalisation"]
    rows = F.array_compact(F.array(*[
        F.when(F.col(n).isNotNull(), F.struct(F.lit(PHASE[n]).alias("phase"), F.lit("").alias("at"),
                                              F.lit(n).alias("signal"), F.col(n).alias("reason")))
        for n in names
    ]))
    return df.select(*KEY, F.inline(rows))


def both_sides(pairs: DataFrame, signal: str, reason: Column, at: Column, name_a: str, name_b: str) -> DataFrame:
    """A finding about two vendors becomes a reason on each of them."""
    sides = F.array(
        F.struct(F.col("statement_a").alias("statement"), F.col(name_a).alias("canonical_name")),
        F.struct(F.col("statement_b").alias("statement"), F.col(name_b).alias("canonical_name")),
    )
    return (
        pairs.withColumns({"_reason": reason, "_at": at})
        .select(F.inline(sides), F.lit(PHASE[signal]).alias("phase"), F.col("_at").alias("at"),
                F.lit(signal).alias("signal"), F.col("_reason").alias("reason"))
    )


def merge_reasons(parts: list[DataFrame]) -> DataFrame:
    """Unique reasons in order, one row per flagged vendor and statement."""
    rows = reduce(DataFrame.unionByName, parts)
    first = rows.groupBy(*KEY, "reason").agg(
        F.min(F.struct("phase", "at", "signal")).alias("o"), F.collect_set("signal").alias("signals")
    )
    listed = first.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("o", "reason"))).alias("r"),
        F.array_distinct(F.flatten(F.collect_list("signals"))).alias("s"),
    )
    return listed.select(
        *KEY,
        F.transform("r", lambda x: x["reason"]).alias("reasons"),
        F.lit(True).alias("flagged"),
        F.array_contains("s", "low_match").alias("low_match_confidence"),
        F.array_contains("s", "variant").alias("name_variant_detected"),
        F.array_contains("s", "near_threshold").alias("near_threshold"),
        F.array_contains("s", "mismatch").alias("cross_statement_mismatch"),
        F.array_contains("s", "unknown_entity").alias("unknown_entity_over_threshold"),
    )
