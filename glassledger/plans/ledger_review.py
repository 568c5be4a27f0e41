"""The ledger review end to end."""
from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame

from ..operators import forest, integrity, ledger, packet
from ..rules import ledger as R


@dataclass
class LedgerReview:
    materiality: dict[str, float]
    findings: DataFrame
    scored: DataFrame
    cards: DataFrame
    queue: DataFrame
    top: DataFrame
    overview: DataFrame


def review_ledger(
    df: DataFrame,
    entity_type: str = "Private company",
    benchmark: float = 150000.0,
    sensitivity: str = R.DEFAULT_SENSITIVITY,
    period_start: date | None = None,
    period_end: date | None = None,
    top_n: int = 3,
) -> LedgerReview:
    """Clean, check, add signals, score by forest, apply materiality, queue."""
    missing = ledger.missing_columns(df)
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")
    m = ledger.materiality_values(entity_type, benchmark)
    clean = ledger.clean_ledger(df)
    findings = integrity.integrity_checks(clean, period_start, period_end)
    scored = ledger.score_ledger(
        forest.score_with_forest(ledger.add_signals(clean), sensitivity),
        m["performance_materiality"], m["transaction_materiality"],
    )
    period = f"{period_start} .. {period_end}" if period_start else None
    return LedgerReview(
        materiality=m,
        findings=findings,
        scored=scored,
        cards=packet.summary_cards(scored),
        queue=ledger.review_queue(scored),
        top=ledger.top_rows(scored, top_n),
        overview=packet.packet_overview(scored, findings, m, period),
    )
