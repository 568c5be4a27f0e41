"""Ordered rules that type statement rows and decide 1099 inclusion."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, title
from ..rules import statements as R


_CHECK = r"^\s*CHECK\s+\d+\b|^(?:" + "|".join(R.CHECK_STARTS) + ")"


def check_payee_visible(desc: Column) -> Column:
    """True when letters are left once the check number and trailing figures go."""
    rest = strip(F.regexp_replace(desc, "(?i)" + R.CHECK_NUMBER, ""))
    rest = strip(F.regexp_replace(rest, r"[\d,$.]+\s*$", ""))
    return rest.rlike("[A-Za-z]{3,}")


def _worded(desc: Column, words: list[str], reason: str) -> Column:
    if "{}" not in reason:
        return F.lit(reason)
    return F.coalesce(*[F.when(desc.contains(w), F.lit(reason.format(title(w)))) for w in words])


_FAMILIES = [
    ("balance", R.BALANCE), ("metadata", R.METADATA), ("payroll", R.PAYROLL), ("transfer", R.TRANSFER),
    ("interest", R.INTEREST), ("deposit", R.DEPOSIT), ("fee", R.FEE),
]


def transaction_type(description: Column, amount: Column) -> Column:
    desc = strip(F.upper(description))
    kind = F.when(F.coalesce(description, F.lit("")) == "", "unknown")
    for name, words in _FAMILIES:
        kind = kind.when(desc.rlike("|".join(words)), name)
    return (
        kind.when(desc.rlike(_CHECK), F.when(check_payee_visible(desc), "check").otherwise("check_unverified"))
        .when(amount > 0, "vendor_payment")
        .otherwise("unknown")
    )


def exclusion_text(kind: Column, description: Column) -> Column:
    """Why a row of this type is left out; empty for included rows."""
    desc = strip(F.upper(description))
    text = F.when(F.coalesce(description, F.lit("")) == "", R.REASONS["empty"])
    for name, words in _FAMILIES:
        text = text.when(kind == name, _worded(desc, words, R.REASONS[name]))
    for name in ("check_unverified", "unknown"):
        text = text.when(kind == name, R.REASONS[name])
    return text.otherwise("")


def classify_rows(df: DataFrame) -> DataFrame:
    """Sets type, inclusion and review flag; an earlier exclusion reason is
    replaced only on rows the rules exclude. ``raw_description`` goes before
    ``description`` when both are there."""
    desc = F.col("description")
    if "raw_description" in df.columns:
        desc = F.coalesce(F.nullif(F.col("raw_description"), F.lit("")), desc)
    df = df.withColumns({"_desc": desc}).withColumn("transaction_type", transaction_type(F.col("_desc"), F.col("amount")))
    included = F.col("transaction_type").isin("check", "vendor_payment")
    earlier = F.col("exclusion_reason") if "exclusion_reason" in df.columns else F.lit("")
    return df.withColumns(
        {
            "include_for_1099": included,
            "review_required": F.col("transaction_type").isin("check", "check_unverified", "unknown"),
            "exclusion_reason": F.when(included, F.coalesce(earlier, F.lit(""))).otherwise(
                exclusion_text(F.col("transaction_type"), F.col("_desc"))
            ),
        }
    ).drop("_desc")


def included_rows(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce(F.col("include_for_1099"), F.lit(True)))


def fill_defaults(df: DataFrame) -> DataFrame:
    """The full statement-row shape: absent or null fields get their defaults."""
    have = set(df.columns)

    def col(name: str, kind: str, default) -> Column:
        d = F.lit(default).cast(kind)
        return F.coalesce(F.col(name).cast(kind), d) if name in have else d

    src = col("source", "string", "bank")
    return df.withColumns(
        {
            "date_raw": F.nullif(F.col("date_raw"), F.lit("")) if "date_raw" in have else F.lit(None).cast("string"),
            "description": col("description", "string", ""),
            "amount": col("amount", "decimal(18,2)", 0),
            "source": F.when(src.isin("bank", "credit_card"), src).otherwise("bank"),
            "transaction_type": col("transaction_type", "string", "vendor_payment"),
            "include_for_1099": col("include_for_1099", "boolean", True),
            "review_required": col("review_required", "boolean", False),
            "exclusion_reason": col("exclusion_reason", "string", ""),
            "confidence": col("confidence", "double", 0.0),
            "source_page": col("source_page", "int", 0),
        }
    )


def type_breakdown(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows per transaction type."""
    return df.groupBy(*(keys or []), "transaction_type").agg(F.count("*").alias("rows"))


def inclusion_totals(df: DataFrame, keys: list[str]) -> DataFrame:
    """Included and excluded rows and the included amount."""
    yes = F.coalesce(F.col("include_for_1099"), F.lit(True))
    return df.groupBy(*keys).agg(
        F.count_if(yes).alias("included_count"),
        F.count_if(~yes).alias("excluded_count"),
        F.coalesce(F.sum(F.when(yes, F.col("amount"))), F.lit(0)).cast("decimal(18,2)").alias("included_total"),
    )
