"""Advisory integrity checks on a clean ledger; each is one row of findings."""
from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dollars, python_list

STATUSES = ["Pass", "Warning", "Fail"]


def _detail(pairs: dict[str, Column]) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v.cast("string"))])


@dataclass(frozen=True)
class Check:
    """Sums a check needs, and the finding made of them.

    Checks are kept apart from their run so that several share one pass.
    """

    name: str
    sums: dict[str, Column]
    ok: Column
    summary: Column
    detail: dict[str, Column]

    def finding(self, position: int) -> Column:
        detail = _detail(self.detail) if self.detail else F.create_map().cast("map<string,string>")
        return F.struct(
            F.lit(position).alias("position"), F.lit(self.name).alias("name"),
            F.when(self.ok, "Pass").otherwise("Warning").alias("status"),
            self.summary.alias("summary"), detail.alias("detail"),
        )


def _skipped(name: str, why: str) -> Check:
    return Check(name, {}, F.lit(True), F.lit(why), {})


def run_checks(df: DataFrame, checks: list[Check]) -> DataFrame:
    """One row per check, all from a single pass over the ledger."""
    sums = {k: v for c in checks for k, v in c.sums.items()}
    one = df.agg(F.count("*").alias("_rows"), *[v.alias(k) for k, v in sums.items()])
    return one.select(F.inline(F.array(*[c.finding(i) for i, c in enumerate(checks, 1)])))


def _has_sides(df: DataFrame) -> bool:
    return {"debit_amount", "credit_amount"} <= set(df.columns)


def _total(c: Column) -> Column:
    """An exact sum: money as decimals, so that neither the order of rows nor their number moves it against the tolerance."""
    money = c.try_cast("decimal(20,4)")
    return F.coalesce(F.sum(money), F.lit(0)).cast("decimal(38,4)")


def hash_total_check(df: DataFrame, tol: float = 0.01) -> Check:
    """Sum of absolute amounts against sum of debits and credits."""
    if not _has_sides(df):
        return _skipped("Hash total", "Hash-total check skipped (no debit_amount / credit_amount columns).")
    sum_abs, sum_dc = F.col("sum_abs"), F.col("sum_d") + F.col("sum_c")
    diff = F.abs(sum_abs - sum_dc)
    text = F.concat(
        F.lit("Σ|amount| = "), dollars(sum_abs), F.lit("; Σ(debit+credit) = "), dollars(sum_dc),
        F.lit("; diff = "), dollars(diff), F.lit("."),
    )
    sums = {"sum_abs": _total(F.abs("amount")), "sum_d": _total(F.col("debit_amount")), "sum_c": _total(F.col("credit_amount"))}
    detail = {"sum_abs": sum_abs, "sum_dc": sum_dc, "diff": diff}
    return Check("Hash total", sums, diff <= F.lit(str(tol)).cast("decimal(18,4)"), text, {k: v.cast("double") for k, v in detail.items()})


def cross_footing_check(df: DataFrame, tol: float = 0.01) -> Check:
    """Sum of debits against sum of credits."""
    if not _has_sides(df):
        return _skipped("Cross-footing", "Cross-footing check skipped (no debit_amount / credit_amount columns).")
    d, c = F.col("sum_d"), F.col("sum_c")
    diff = F.abs(d - c)
    pct = diff.cast("double") / F.greatest(d.cast("double"), F.lit(1.0)) * 100
    text = F.concat(
        F.lit("ΣDebit = "), dollars(d), F.lit("; ΣCredit = "), dollars(c),
        F.lit("; diff = "), dollars(diff), F.lit(" ("), F.format_string("%.2f", pct), F.lit("%)."),
    )
    sums = {"sum_d": _total(F.col("debit_amount")), "sum_c": _total(F.col("credit_amount"))}
    detail = {"sum_d": d, "sum_c": c, "diff": diff, "pct": pct}
    return Check("Cross-footing", sums, diff <= F.lit(str(tol)).cast("decimal(18,4)"), text, {k: v.cast("double") for k, v in detail.items()})


def period_check(start: date | None, end: date | None) -> Check:
    """Rows outside the period; both bounds count, the end one at midnight."""
    if start is None or end is None:
        return _skipped("Date in period", "Period bounds not provided — check skipped.")
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    d = F.col("date")
    sums = {"n_total": F.count(d), "n_out_of_bounds": F.count_if((d < lo) | (d > hi)), "n_null": F.count_if(d.isNull())}
    out, null = F.col("n_out_of_bounds"), F.col("n_null")
    text = F.concat(
        out.cast("string"), F.lit(" of "), F.col("n_total").cast("string"),
        F.lit(f" rows fall outside [{start.isoformat()} .. {end.isoformat()}]"),
        F.when(null > 0, F.concat(F.lit("; "), null.cast("string"), F.lit(" rows have an unparseable date"))).otherwise(""),
        F.lit("."),
    )
    detail = {k: F.col(k) for k in sums} | {"period_start": F.lit(start.isoformat()), "period_end": F.lit(end.isoformat())}
    return Check("Date in period", sums, (out == 0) & (null == 0), text, detail)


def hash_total(df: DataFrame, tol: float = 0.01) -> DataFrame:
    return run_checks(df, [hash_total_check(df, tol)])


def cross_footing(df: DataFrame, tol: float = 0.01) -> DataFrame:
    return run_checks(df, [cross_footing_check(df, tol)])


def date_in_period(df: DataFrame, start: date | None, end: date | None) -> DataFrame:
    return run_checks(df, [period_check(start, end)])


def account_offenders(df: DataFrame) -> DataFrame:
    """Every code with several names and every name with several codes, as rows."""
    pairs = df.where(F.col("account_code").isNotNull() | F.col("account_name").isNotNull()).select(
        "account_code", "account_name"
    ).distinct()

    def side(kind: str, key: str, other: str) -> DataFrame:
        return (
            pairs.where(F.col(key).isNotNull())
            .groupBy(F.col(key).alias("value"))
            .agg(F.count(other).alias("partners"))
            .where("partners > 1")
            .select(F.lit(kind).alias("kind"), "value", "partners")
        )

    return side("account_code", "account_code", "account_name").unionByName(
        side("account_name", "account_name", "account_code")
    )


def account_mapping(df: DataFrame, position: int = 1) -> DataFrame:
    """Code and name must map one to one; three offenders of each kind are shown."""
    if not {"account_code", "account_name"} <= set(df.columns):
        skipped = _skipped("Account mapping", "Account mapping check skipped (columns missing).")
        return df.limit(0).agg(F.count("*")).select(F.inline(F.array(skipped.finding(position))))
    bad = account_offenders(df)
    t = bad.agg(
        F.count_if(F.col("kind") == "account_code").alias("n_codes"),
        F.count_if(F.col("kind") == "account_name").alias("n_names"),
    ).withColumns(
        {"codes": _smallest_three(bad, "account_code", "codes").scalar(),
         "names": _smallest_three(bad, "account_name", "names").scalar()}
    )
    parts = [
        F.when(F.col(f"n_{a}") > 0, F.concat(
            F.col(f"n_{a}").cast("string"), F.lit(f" {k}(s) map to multiple {b} (e.g. "),
            python_list(F.col(a)), F.lit(")")))
        for k, a, b in (("account_code", "codes", "names"), ("account_name", "names", "codes"))
    ]
    ok = (F.col("n_codes") == 0) & (F.col("n_names") == 0)
    text = F.when(ok, "Account code ↔ name mapping is consistent.").otherwise(
        F.concat(F.concat_ws("; ", *parts), F.lit("."))
    )
    check = Check("Account mapping", {}, ok, text, {"bad_codes": F.col("n_codes"), "bad_names": F.col("n_names")})
    return t.select(F.inline(F.array(check.finding(position))))


def _smallest_three(bad: DataFrame, kind: str, name: str) -> DataFrame:
    top = bad.where(F.col("kind") == kind).orderBy("value").limit(3)
    return top.agg(F.sort_array(F.collect_list("value")).alias(name))


def integrity_checks(df: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    """The four checks, numbered in display order; the three sums share one pass."""
    sums = run_checks(df, [hash_total_check(df), cross_footing_check(df), period_check(start, end)])
    return sums.unionByName(account_mapping(df, 4))


def findings_by_status(findings: DataFrame) -> DataFrame:
    """One row with the count of each status, zero when absent."""
    return findings.agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES])
