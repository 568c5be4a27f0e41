"""Does a statement's own arithmetic hold, and were all of its rows extracted?"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import to_decimal
from ..rules import statements as R

_CENTS = "decimal(18,2)"
# figure -> names it may come under in a snapshot
_FIGURES = {
    "beginning_balance": ["beginning_balance", "beginning"],
    "total_deposits": ["total_deposits", "deposits"],
    "total_withdrawals": ["total_withdrawals", "withdrawals"],
    "checks": ["checks"],
    "transfers": ["transfers"],
    "fees": ["fees"],
    "reported_ending_balance": ["reported_ending_balance", "ending_balance"],
}


def _figure(df: DataFrame, name: str) -> Column:
    found = [to_decimal(F.col(c)) for c in _FIGURES[name] if c in df.columns]
    return found[0] if found else F.lit(None).cast(_CENTS)


def reconcile(snapshots: DataFrame) -> DataFrame:
    """Source A. beginning + deposits - withdrawals - checks - transfers - fees = ending.

    Keeps the stated checks, transfers and fees beside the ones counted as 0
    when absent, as the completeness check needs to tell them apart.
    """
    df = snapshots.withColumns({f: _figure(snapshots, f) for f in _FIGURES})
    zero = F.lit(0).cast(_CENTS)
    parts = {f"{f}_used": F.coalesce(F.col(f), zero) for f in ("checks", "transfers", "fees")}
    needed = ["beginning_balance", "total_deposits", "total_withdrawals", "reported_ending_balance"]
    ready = F.lit(True)
    for f in needed:
        ready = ready & F.col(f).isNotNull()
    df = df.withColumns(parts)
    calculated = (
        F.col("beginning_balance") + F.col("total_deposits") - F.col("total_withdrawals")
        - F.col("checks_used") - F.col("transfers_used") - F.col("fees_used")
    ).cast(_CENTS)
    df = df.withColumns({"available": ready, "calculated_ending": F.when(ready, calculated)})
    df = df.withColumn("difference", (F.col("calculated_ending") - F.col("reported_ending_balance")).cast(_CENTS))
    why = F.when(~ready, "Statement did not report all four figures needed to reconcile.")
    return df.withColumns({"balanced": F.abs("difference") <= R.TOLERANCE, "unavailable_reason": why})


def reconciliation_status(available: Column, balanced: Column) -> Column:
    return (
        F.when(~F.coalesce(available, F.lit(False)), "unavailable").when(balanced, "balanced").otherwise("needs_review")
    )


def bucket_sums(rows: DataFrame, keys: list[str], buckets: dict[str, str] | None = None) -> DataFrame:
    """Amount per activity bucket; types outside the map count nowhere."""
    mapping = F.create_map(*[F.lit(x) for kv in (buckets or R.BUCKETS).items() for x in kv])
    bucket = mapping[F.col("transaction_type")]
    amount = F.coalesce("amount", F.lit(0).cast(_CENTS))
    return rows.groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.when(bucket == b, amount)), F.lit(0)).cast(_CENTS).alias(f"{b}_row_sum") for b in R.BUCKET_NAMES]
    )


def extraction_check(reconciled: DataFrame, sums: DataFrame, keys: list[str]) -> DataFrame:
    """Source B. Extracted rows against the statement's stated activity totals.

    When only total withdrawals are stated (checks, transfers and fees absent or
    zero) all debits together are compared with that one figure.
    """
    tol = R.TOLERANCE
    df = reconciled.join(sums, keys, "left")
    zero = F.lit(0).cast(_CENTS)
    df = df.withColumns({f"{b}_row_sum": F.coalesce(f"{b}_row_sum", zero) for b in R.BUCKET_NAMES})
    ready = F.col("available")
    stated = {
        "deposits": F.col("total_deposits"), "withdrawals": F.col("total_withdrawals"),
        "checks": F.col("checks_used"), "transfers": F.col("transfers_used"), "fees": F.col("fees_used"),
    }

    def absent(c: Column) -> Column:
        return c.isNull() | (F.abs(c) <= tol)

    def delta(b: str) -> Column:
        row, st = F.col(f"{b}_row_sum"), stated[b]
        return F.when(st.isNull(), F.when(F.abs(row) > tol, row)).otherwise((row - st).cast(_CENTS))

    debits = sum((F.col(f"{b}_row_sum") for b in ("checks", "transfers", "fees")), F.col("withdrawals_row_sum")).cast(_CENTS)
    lumped = ready & stated["withdrawals"].isNotNull() & absent(stated["checks"]) & absent(stated["transfers"]) & absent(stated["fees"])
    df = df.withColumns({"lumped_debits": F.coalesce(lumped, F.lit(False)), "_debits": debits})
    lump = F.col("lumped_debits")
    cols: dict[str, Column] = {}
    off = F.lit(False)
    for b in R.BUCKET_NAMES:
        d = delta(b)
        shown = F.when(ready, stated[b])
        if b == "withdrawals":
            d = F.when(lump, (F.col("_debits") - stated[b]).cast(_CENTS)).otherwise(d)
        elif b != "deposits":
            d, shown = F.when(~lump, d), F.when(~lump, shown)
        d = F.when(ready, d)
        cols[f"{b}_stated"], cols[f"{b}_delta"] = shown, d
        off = off | F.coalesce(F.abs(d) > tol, F.lit(False))
    cols["extraction_status"] = F.when(~ready, "unavailable").when(off, "incomplete").otherwise("complete")
    cols["extraction_notes"] = F.when(
        lump, "Statement lumps all debits into one total; compared combined debit rows against it."
    )
    df = df.withColumns(cols)
    return df.withColumn("withdrawals_row_sum", F.when(lump, F.col("_debits")).otherwise(F.col("withdrawals_row_sum"))).drop("_debits")


def status_tally(statements: DataFrame) -> DataFrame:
    """Balanced / review / unavailable and complete / incomplete / unavailable over good statements."""
    a, b = F.coalesce("reconciliation_status", F.lit("")), F.coalesce("extraction_status", F.lit(""))
    return statements.agg(
        F.count("*").alias("statements"),
        F.count_if(a == "balanced").alias("balanced"),
        F.count_if(a == "needs_review").alias("needs_review"),
        F.count_if(~a.isin("balanced", "needs_review")).alias("unavailable"),
        F.count_if(b == "complete").alias("complete"),
        F.count_if(b == "incomplete").alias("incomplete"),
        F.count_if(~b.isin("complete", "incomplete")).alias("not_assessed"),
    )
