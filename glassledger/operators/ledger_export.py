"""Accounting-package exports: clean-up, profile, outliers and duplicate names."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dollars, strip
from .ledger import _as_timestamp, as_number

# fixed values: export header -> our column
RENAME = {
    "Type": "type", "Date": "date", "Num": "check_num", "Name": "name",
    "Memo": "memo", "Split": "split_account", "Amount": "amount", "Balance": "balance",
}
SPACER_VALUES = 2
OUTLIER_STD = 2.5
CHUNK_ROWS = 1_000_000


def forward_fill(df: DataFrame, value: Column, name: str, keys: list[str], order: str, chunk: int = CHUNK_ROWS) -> DataFrame:
    """Carries the last non-null ``value`` down in ``order`` within ``keys``.

    Rows are cut into chunks of ``order``; each chunk is filled by itself, and the
    last value before a chunk comes from a short list with one row per chunk. A
    single file of any length is thus spread over many tasks.
    """
    cut = df.withColumns({"_v": value, "_chunk": F.floor(F.col(order) / chunk)})
    at = [*keys, "_chunk"]
    ends = cut.groupBy(*at).agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*at, F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    inside = Window.partitionBy(*at).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = cut.withColumn("_in", F.last("_v", ignorenulls=True).over(inside)).join(carried, at, "left")
    return filled.withColumn(name, F.coalesce("_in", "_carry")).drop("_v", "_chunk", "_in", "_carry")


def clean_export(df: DataFrame, file_keys: list[str] | None = None, order: str = "row_no") -> DataFrame:
    """Typed ledger rows of an export with section headers and spacer columns."""
    unnamed = [c for c in df.columns if "Unnamed" in c]
    drop: list[str] = []
    if unnamed:
        n = df.agg(*[F.count_distinct(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(unnamed)]).first()
        drop = [c for i, c in enumerate(unnamed) if n[f"n{i}"] <= SPACER_VALUES]
    df = df.drop(*drop)
    keys = list(file_keys or [])
    if "Unnamed: 1" in df.columns:
        head = strip(F.col("`Unnamed: 1`"))
        section = F.when(F.col("`Unnamed: 1`").isNotNull() & F.col("Type").isNull() & ~head.startswith("Total"), head)
        base = df if keys else df.withColumn("_file", F.lit(0))
        df = forward_fill(base, section, "account_category", keys or ["_file"], order).drop("Unnamed: 1", "_file")
    if "Type" in df.columns:
        df = df.where(F.col("Type").isNotNull())
    if "Unnamed: 0" in df.columns:
        df = df.where(F.coalesce(F.col("`Unnamed: 0`") != "TOTAL", F.lit(True)))
    df = df.drop(*[c for c in df.columns if "Unnamed" in c])
    df = df.withColumnsRenamed({k: v for k, v in RENAME.items() if k in df.columns})
    cols = {}
    if "date" in df.columns:
        cols["date"] = _as_timestamp(df, "date")
    for c in ("amount", "balance"):
        if c in df.columns:
            cols[c] = as_number(F.col(c))
    if "check_num" in df.columns:
        number = F.col("check_num").try_cast("double")
        cols["check_num"] = F.coalesce(number.try_cast("bigint").cast("string"), F.col("check_num"), F.lit(""))
    if "name" in df.columns:
        cols["name"] = F.coalesce("name", F.lit(""))
    return df.withColumns(cols)


def outliers(df: DataFrame, amount: str = "amount") -> DataFrame:
    """Rows further than 2.5 sample deviations from the mean, with the reason."""
    s = df.agg(F.struct(F.avg(amount).alias("m"), F.stddev_samp(amount).alias("s")).alias("x")).scalar()
    a = F.col(amount)
    far = F.abs(a - s["m"]) > OUTLIER_STD * s["s"]
    text = F.concat(F.lit("Amount "), dollars(a), F.lit(f" is more than {OUTLIER_STD} std deviations from mean ("),
                    dollars(s["m"]), F.lit(")"))
    return df.where(far).withColumn("reason", text)


def file_totals(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("total_transactions"),
        F.date_format(F.min("date"), "yyyy-MM-dd").alias("start"),
        F.date_format(F.max("date"), "yyyy-MM-dd").alias("end"),
    )


def type_counts(df: DataFrame) -> DataFrame:
    return df.where("type IS NOT NULL").groupBy("type").agg(F.count("*").alias("rows"))


def top_names(df: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent names; equal counts go by name."""
    return (
        df.where("name <> ''").groupBy("name").agg(F.count("*").alias("transaction_count"))
        .orderBy(F.desc("transaction_count"), "name").limit(n)
    )


def account_breakdown(df: DataFrame) -> DataFrame:
    """Sum and count per account section (or split account), smallest total first."""
    key = "account_category" if "account_category" in df.columns else "split_account"
    return (
        df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("account"))
        .agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total_amount"), F.count("amount").alias("count"))
        .orderBy("total_amount", "account")
    )


def name_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[ ,.]", "")


def duplicate_names(df: DataFrame, order: str = "row_no") -> DataFrame:
    """Names that differ only in blanks, commas, periods or case from one seen earlier."""
    names = df.where("name <> ''").groupBy("name").agg(F.min(order).alias("seen"))
    keyed = names.withColumn("key", name_key(F.col("name")))
    first = keyed.groupBy("key").agg(F.min_by("name", F.struct("seen", "name")).alias("name_1"))
    return (
        keyed.join(first, "key").where("name <> name_1")
        .select("name_1", F.col("name").alias("name_2"),
                F.lit("Possible duplicate — same name with different formatting").alias("issue"))
    )
