"""Summary cards, signal counts and evidence facts of a ledger review."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import ledger as R
from .ledger import flagged_rows, queue_order


def _count(cond: Column) -> Column:
    return F.count_if(cond)


def summary_cards(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count("*").alias("transactions_analyzed"),
        _count(F.col("flagged_status") == "Flagged").alias("flagged_for_follow_up"),
        _count(F.col("final_tier") == "High").alias("high_priority"),
        _count(F.col("final_tier") == "Medium").alias("medium_priority"),
        _count(F.col("is_qualitative_override") == 1).alias("escalated_by_override"),
    )


def signal_counts(scored: DataFrame) -> DataFrame:
    """Per signal, how many rows fired in the ledger and how many in the queue.

    The z-score signal is counted for the queue only.
    """
    queued = F.col("flagged_status") == "Flagged"
    aggs = []
    for c in R.FLAG_LABELS:
        aggs.append(_count(F.col(c) == 1).alias(f"{c}_all"))
        aggs.append(_count(queued & (F.col(c) == 1)).alias(f"{c}_queue"))
    aggs.append(_count(queued & (F.abs(F.col(R.Z_COLUMN)) >= R.UNUSUAL_Z)).alias("z_queue"))
    one = scored.agg(*aggs)
    rows = [
        F.struct(F.lit(label).alias("signal"), F.col(f"{c}_all").alias("population"), F.col(f"{c}_queue").alias("in_queue"))
        for c, label in R.FLAG_LABELS.items()
    ]
    none = F.lit(None).cast("bigint")
    rows.append(F.struct(F.lit(R.Z_LABEL).alias("signal"), none.alias("population"), F.col("z_queue").alias("in_queue")))
    return one.select(F.inline(F.array(*rows)))


def most_frequent(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """Top values by row count; equal counts go by name."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("rows"))
        .orderBy(F.desc("rows"), column)
        .limit(n)
    )


def fired_signals() -> Column:
    """Keys of the signals that fired on a row, the z-score first."""
    z = F.when(F.abs(F.coalesce(F.col(R.Z_COLUMN), F.lit(0.0))) >= R.UNUSUAL_Z, F.lit(R.Z_COLUMN))
    flags = [F.when(F.col(c) == 1, F.lit(c)) for c in R.FLAG_LABELS]
    return F.array_compact(F.array(z, *flags))


def anchor_table(spark) -> DataFrame:
    rows = [(i, k, *v) for i, (k, v) in enumerate(R.ANCHORS.items())]
    return spark.createDataFrame(rows, "anchor_no int, signal string, source string, rationale string, evidence string")


def signal_anchors(rows: DataFrame) -> DataFrame:
    """One row per fired signal with the standard it is designed around."""
    dim = F.broadcast(anchor_table(rows.sparkSession))  # six rows
    return rows.withColumn("signal", F.explode(fired_signals())).join(dim, "signal")


def anchor_text() -> Column:
    """The anchors of a row as one text, in signal order."""
    table = F.create_map(*[
        x for k, (source, why, ask) in R.ANCHORS.items()
        for x in (F.lit(k), F.lit(f"- {k}: designed around {source} — {why}. Evidence hint: {ask}."))
    ])
    text = F.array_join(F.transform(fired_signals(), lambda k: table[k]), "\n")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("- (no discrete flags; statistical anomaly only)"))


def evidence_facts(rows: DataFrame) -> DataFrame:
    """The facts a reviewer's memo may state about a queue row."""
    facts = F.struct(
        F.coalesce(F.col("date").cast("string"), F.lit("")).alias("date"),
        F.col("account_name").alias("account"),
        F.col("vendor"),
        F.coalesce("abs_amount", "amount").alias("amount"),
        F.col("final_tier").alias("priority_tier"),
        F.col("pcaob_label"),
        F.col("active_flags"),
        F.col("materiality_annotation").alias("materiality"),
        F.when(F.col("is_qualitative_override") == 1, "yes").otherwise("no").alias("qualitative_override"),
    )
    return rows.select(
        "journal_ref", facts.alias("facts"), anchor_text().alias("anchors"),
        F.col("qualitative_override_note").alias("override_note"),
    )


def top_evidence(scored: DataFrame, n: int = 3) -> DataFrame:
    return evidence_facts(flagged_rows(scored).orderBy(*queue_order()).limit(max(1, min(int(n), 5))))


def packet_overview(scored: DataFrame, findings: DataFrame, materiality: dict[str, float], period: str | None = None) -> DataFrame:
    """One row with every fact of the packet: counts, top lists, checks, signals."""

    def listed(df: DataFrame, column: str) -> Column:
        ranked = F.array_sort(F.collect_list(F.struct((-F.col("rows")).alias("o"), F.col(column).alias("v"))))
        return most_frequent(df, column).agg(F.transform(ranked, lambda s: s["v"]).alias("a")).scalar()

    checks = findings.agg(
        F.array_sort(F.collect_list(F.struct("position", "name", "status", "summary"))).alias("a")
    )
    signals = signal_counts(scored).agg(F.collect_list(F.struct("signal", "population", "in_queue")).alias("a"))
    return summary_cards(scored).withColumns(
        {
            "period": F.lit(period or "not specified"),
            "top_accounts": listed(scored, "account_name"),
            "top_vendors": listed(scored, "vendor"),
            "integrity": checks.scalar(),
            "signals": signals.scalar(),
            **{k: F.lit(v) for k, v in materiality.items()},
        }
    )


def banned_phrases(memo: Column) -> Column:
    """The banned phrases a memo holds, in list order."""
    low = F.lower(F.coalesce(memo, F.lit("")))
    return F.filter(F.array(*[F.lit(p) for p in R.BANNED_PHRASES]), lambda p: F.contains(low, p))


def scan_memos(df: DataFrame, memo: str = "memo") -> DataFrame:
    hits = banned_phrases(F.col(memo))
    return df.withColumn("guardrail_hits", hits).withColumn("guardrail_ok", F.size("guardrail_hits") == 0)
