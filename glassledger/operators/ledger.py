"""Ledger clean-up, review signals, materiality scoring and the review queue."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from ..plans.joins import join_summary, summary_size, where_computed
from ..plans.quantiles import interpolated_quantiles
from ..plans.stored import stored
from ..rules import ledger as R

UNKNOWN_VENDOR = "UNKNOWN"
_DATE_FORMATS = ["M/d/yyyy", "M/d/yy"]


def missing_columns(df: DataFrame) -> list[str]:
    """Required columns the frame lacks; empty when it can be reviewed."""
    return [c for c in R.REQUIRED_COLUMNS if c not in df.columns]


def _as_timestamp(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    if isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp")
    s = strip(c.cast("string"))
    return F.coalesce(F.try_to_timestamp(s), *[F.try_to_timestamp(s, F.lit(f)) for f in _DATE_FORMATS])


def as_number(c: Column) -> Column:
    """A double, or null when the text is no number (never NaN)."""
    n = c.try_cast("double")
    return F.when(~F.isnan(n), n)


def clean_ledger(df: DataFrame) -> DataFrame:
    """Typed ledger: bad dates and amounts become null, ``abs_amount`` is added."""
    cols = {"date": _as_timestamp(df, "date"), "amount": as_number(F.col("amount"))}
    for c in ("debit_amount", "credit_amount"):
        if c in df.columns:
            cols[c] = F.coalesce(as_number(F.col(c)), F.lit(0.0))
    for c in ("vendor", "description", "account_name", "account_code"):
        if c in df.columns:
            cols[c] = F.col(c).cast("string")
    return df.withColumns(cols).withColumn("abs_amount", F.abs("amount"))


def is_round_number(amount: Column) -> Column:
    return F.coalesce((F.abs(amount) % 100 == 0).cast("int"), F.lit(0))


def is_near_limit(amount: Column) -> Column:
    a, hit = F.abs(amount), F.lit(False)
    for limit in R.APPROVAL_LIMITS:
        hit = hit | ((a >= limit * R.NEAR_LIMIT_SHARE) & (a < limit))
    return F.coalesce(hit.cast("int"), F.lit(0))


def is_weekend(date: Column) -> Column:
    return F.coalesce(F.weekday(date).isin(5, 6).cast("int"), F.lit(0))


def is_blank_description(c: Column) -> Column:
    s = strip(c)
    return (c.isNull() | (s == "") | (F.lower(s) == "nan")).cast("int")


def account_stats(df: DataFrame) -> DataFrame:
    """Mean and population deviation of ``abs_amount`` per account; null accounts have none.

    Both come from exact decimal sums of the amounts (to four places) and of their squares, so they are the same to the
    last bit on any partitioning. Sums of squares hold up to 10^30; beyond, the job fails rather than giving a wrong figure.
    """
    money = F.col("abs_amount").cast("decimal(18,4)")
    moments = df.where(F.col("account_name").isNotNull()).groupBy("account_name").agg(
        F.count(money).alias("_n"), F.sum(money).cast("double").alias("_s"), F.sum(money * money).cast("double").alias("_q"),
        (F.min(money) == F.max(money)).alias("_constant"))
    mean = F.col("_s") / F.nullif(F.col("_n"), F.lit(0))
    spread = (F.col("_q") - F.col("_s") * mean) / F.nullif(F.col("_n"), F.lit(0))
    return moments.select("account_name", mean.alias("_mean"), F.when(F.col("_constant"), 0.0).otherwise(F.sqrt(F.greatest(spread, F.lit(0.0)))).alias("_std"))


def vendor_counts(df: DataFrame) -> DataFrame:
    key = F.coalesce("vendor", F.lit(UNKNOWN_VENDOR))
    return df.groupBy(key.alias("_vendor_key")).agg(F.count("*").alias("vendor_txn_count"))


def add_signals(df: DataFrame) -> DataFrame:
    """Six signals on a clean ledger, plus their counts.

    Account and vendor statistics are aggregated first and joined back, so a
    single huge account or vendor never has to sit in one window partition. Both
    summaries are written once; their sizes come from them, not from the ledger.
    """
    keyed = df.withColumn("_vendor_key", F.coalesce("vendor", F.lit(UNKNOWN_VENDOR)))
    accounts, vendors = stored(account_stats(df), "accounts"), stored(vendor_counts(df), "vendors")
    out = join_summary(keyed, accounts, "account_name", summary_size(accounts, "account_name"))
    out = join_summary(out, vendors, "_vendor_key", summary_size(vendors, "_vendor_key"))
    z = (
        F.when(F.col("account_name").isNull(), F.lit(None).cast("double"))
        .when(F.coalesce(F.col("_std"), F.lit(0.0)) == 0, F.lit(0.0))
        .otherwise((F.col("abs_amount") - F.col("_mean")) / F.col("_std"))
    )
    flags = list(R.FLAG_LABELS)
    out = out.withColumns(
        {
            R.Z_COLUMN: z,
            "is_round_number": is_round_number(F.col("abs_amount")),
            "is_weekend_posting": is_weekend(F.col("date")),
            "missing_description": is_blank_description(F.col("description")),
            "is_new_vendor": (F.col("vendor_txn_count") < R.RARE_VENDOR_ROWS).cast("int"),
            "is_near_approval_threshold": is_near_limit(F.col("abs_amount")),
        }
    )
    total = sum((F.col(f) for f in flags[1:]), F.col(flags[0]))
    out = out.withColumns(
        {
            "control_gap_score": F.col("missing_description") + F.col("is_weekend_posting"),
            "fraud_flag_count": total,
        }
    ).withColumn("fraud_risk_flag", (F.col("fraud_flag_count") >= 2).cast("int"))
    return out.drop("_vendor_key", "_mean", "_std")


# --- tiers -----------------------------------------------------------------


def contamination(sensitivity: str | None) -> float:
    return R.SENSITIVITY.get(sensitivity or "", R.SENSITIVITY[R.DEFAULT_SENSITIVITY])


def tier_cuts(df: DataFrame, share: float, score: str = "anomaly_score", weight: str | None = None) -> list:
    """Score cut-offs of the High and the Medium band (exact, interpolated)."""
    probs = [share, min(share * (1.0 + R.MEDIUM_BAND), R.MEDIUM_CEILING)]
    return interpolated_quantiles(df, score, probs, weight)


def raw_tier(score: Column, high_cut: float | None, medium_cut: float | None) -> Column:
    return F.when(score <= F.lit(high_cut), "High").when(score <= F.lit(medium_cut), "Medium").otherwise("Low")


def with_raw_tier(df: DataFrame, sensitivity: str | None = None, score: str = "anomaly_score") -> DataFrame:
    df = stored(df, "scored")  # the cuts need a pass of their own, and each report is another
    high, medium = tier_cuts(df, contamination(sensitivity), score)
    return df.withColumn("raw_tier", raw_tier(F.col(score), high, medium))


def tier_rank(c: Column) -> Column:
    rank = F.lit(None).cast("int")
    for i, name in enumerate(R.TIERS):
        rank = F.when(c == name, F.lit(i)).otherwise(rank)
    return rank


def tier_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in R.TIERS]), rank + 1)


def downgrade(tier: Column, steps: int = 1) -> Column:
    """One tier milder; an unknown tier becomes Monitor."""
    return tier_name(F.greatest(F.coalesce(tier_rank(tier) - steps, F.lit(0)), F.lit(0)))


def upgrade(tier: Column, steps: int = 1) -> Column:
    """One tier graver; an unknown tier stays as it is."""
    top = F.lit(len(R.TIERS) - 1)
    return F.when(tier_rank(tier).isNull(), tier).otherwise(tier_name(F.least(tier_rank(tier) + steps, top)))


def materiality(entity_type: Column, benchmark: Column) -> dict[str, Column]:
    """Statement, performance and transaction materiality, to the cent."""
    pct = F.when(entity_type == "Public company", F.lit(0.05)).otherwise(F.lit(0.04))
    fs = benchmark * pct
    return {
        "fs_pct": pct,
        "fs_materiality": F.bround(fs, 2),
        "performance_materiality": F.bround(fs * 0.50, 2),
        "transaction_materiality": F.bround(fs * 0.80, 2),
    }


def with_materiality(entities: DataFrame, entity_type: str = "entity_type", benchmark: str = "benchmark") -> DataFrame:
    return entities.withColumns(materiality(F.col(entity_type), F.col(benchmark)))


def materiality_values(entity_type: str, benchmark: float) -> dict[str, float]:
    """The same figures for one review run, as plain numbers."""
    pct = 0.05 if entity_type == "Public company" else 0.04
    fs = benchmark * pct
    return {
        "fs_pct": pct,
        "fs_materiality": round(fs, 2),
        "performance_materiality": round(fs * 0.50, 2),
        "transaction_materiality": round(fs * 0.80, 2),
    }


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def cascade_tier(raw: Column, abs_amount: Column, performance, transaction) -> Column:
    a = F.coalesce(abs_amount, F.lit(0.0))
    return F.when(a >= _lit(transaction), raw).when(a >= _lit(performance), downgrade(raw)).otherwise("Monitor")


def materiality_note(abs_amount: Column, performance, transaction) -> Column:
    a = F.coalesce(abs_amount, F.lit(0.0))
    return (
        F.when(a >= _lit(transaction), "Exceeds Transaction Materiality")
        .when(a >= _lit(performance), "Below Transaction Materiality")
        .otherwise("Below Performance Materiality")
    )


def active_flags() -> Column:
    parts = [F.when(F.abs(F.col(R.Z_COLUMN)) >= R.UNUSUAL_Z, R.Z_LABEL)]
    parts += [F.when(F.col(c) == 1, label) for c, label in R.FLAG_LABELS.items()]
    return F.coalesce(F.nullif(F.concat_ws("; ", *parts), F.lit("")), F.lit(R.NO_FLAG_LABEL))


def score_ledger(df: DataFrame, performance, transaction) -> DataFrame:
    """Materiality cascade, then the co-occurrence override, then labels.

    ``performance`` and ``transaction`` are numbers, or columns when many
    entities with their own benchmarks are scored together.
    """
    raw = F.coalesce(F.col("raw_tier"), F.lit("Low"))
    df = df.withColumns(
        {
            "_cascade": cascade_tier(raw, F.col("abs_amount"), performance, transaction),
            "_lifted": upgrade(raw),
            "materiality_annotation": materiality_note(F.col("abs_amount"), performance, transaction),
            "active_flags": active_flags(),
        }
    )
    lift = (F.col("fraud_risk_flag") == 1) & (tier_rank(F.col("_lifted")) > tier_rank(F.col("_cascade")))
    note = F.format_string(
        "Escalated to %s: %s indicators co-occur (qualitative materiality). Raw tier %s; "
        "materiality alone would assign %s.",
        F.col("_lifted"), F.col("fraud_flag_count").cast("string"), raw, F.col("_cascade"),
    )
    df = df.withColumns(
        {
            "final_tier": F.when(lift, F.col("_lifted")).otherwise(F.col("_cascade")),
            "is_qualitative_override": F.coalesce(lift.cast("int"), F.lit(0)),
            "qualitative_override_note": F.when(lift, note).otherwise(""),
        }
    ).drop("_cascade", "_lifted")
    labels = F.create_map(*[F.lit(x) for kv in R.TIER_LABELS.items() for x in kv])
    return df.withColumns(
        {
            "pcaob_label": F.coalesce(labels[F.col("final_tier")], F.lit(R.TIER_LABELS["Monitor"])),
            "flagged_status": F.when(F.col("final_tier").isin("High", "Medium"), "Flagged").otherwise("Not flagged"),
        }
    )


# --- queue -----------------------------------------------------------------


def queue_rank(tier: Column) -> Column:
    return F.when(tier == "High", 0).when(tier == "Medium", 1).when(tier == "Low", 2).when(tier == "Monitor", 3).otherwise(9)


def flagged_rows(scored: DataFrame) -> DataFrame:
    """The rows to follow up; the score behind the status is computed once."""
    return where_computed(scored, F.col("flagged_status") == "Flagged")


def queue_order() -> list[Column]:
    """Gravest tier first, then most anomalous; ties by the row's own fields."""
    tie = [F.col(c) for c in ("journal_ref", "date", "account_name", "vendor", "amount", "description")]
    return [queue_rank(F.col("final_tier")), F.col("anomaly_score"), *tie]


def review_queue(scored: DataFrame) -> DataFrame:
    """The flagged rows in review order.

    A global sort looks at its input twice (ranges first, rows second). The few
    flagged rows are dealt out before it, so that the ledger is scored once.
    """
    spread = F.xxhash64("journal_ref", "date", "vendor", "amount", "description")
    return flagged_rows(scored).repartition(spread).orderBy(*queue_order())


def top_rows(scored: DataFrame, n: int = 3) -> DataFrame:
    """The first one to five queue rows, in the shape shown to the reviewer."""
    rows = flagged_rows(scored).orderBy(*queue_order()).limit(max(1, min(int(n), 5)))
    return rows.select(
        F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit("")).alias("date"),
        F.col("account_name").alias("account"),
        "vendor",
        F.round(F.coalesce("abs_amount", F.lit(0.0)), 2).alias("amount"),
        F.col("final_tier").alias("priority"),
        "pcaob_label",
        F.col("active_flags").alias("signals"),
        (F.col("is_qualitative_override") == 1).alias("override"),
    )


def queue_export(scored: DataFrame) -> DataFrame:
    """The flagged rows with the export columns that exist."""
    rows = flagged_rows(scored)
    return rows.select(*[c for c in R.QUEUE_COLUMNS if c in rows.columns])


def by_anomaly(scored: DataFrame) -> DataFrame:
    """Whole ledger, most anomalous first; for writing out only."""
    return scored.orderBy("anomaly_score", "journal_ref")
