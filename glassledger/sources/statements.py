"""Transcribed statement documents (nested JSON, possibly inside other text)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

REQUIRED = ["date", "description", "amount", "transaction_type", "include_for_1099"]
_META = "detected_type string, detected_layout string, page_count int, statement_period string"
_SNAPSHOT = (
    "beginning_balance string, total_deposits string, total_withdrawals string, checks string, transfers string, "
    "fees string, reported_ending_balance string, fields_found array<string>, notes string"
)
_ROW = (
    "date string, description string, amount string, transaction_type string, include_for_1099 boolean, "
    "exclusion_reason string, review_required boolean, review_reason string, confidence string, "
    "source_page string, source_text string"
)
DOCUMENT = (
    f"document_metadata struct<{_META.replace(' string', ':string').replace(' int', ':int')}>, "
    "reconciliation_snapshot string, transactions array<string>"
)


def json_in_text(text: Column) -> Column:
    """The JSON object in a text: bare, fenced, or between its first and last brace."""
    bare = strip(text)
    unfenced = strip(F.regexp_replace(F.regexp_replace(bare, r"^```(?:json)?\n?", ""), r"\n?```$", ""))
    whole = F.when(bare.startswith("```"), unfenced).otherwise(bare)
    braced = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    fenced = F.nullif(strip(F.regexp_extract(text, r"(?s)```(?:json)?\s*\n(.*?)\n```", 1)), F.lit(""))
    return F.coalesce(*[F.when(F.try_parse_json(c).isNotNull(), c) for c in (whole, braced, fenced)])


def scan_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: (statement, json)."""
    files = spark.read.option("wholetext", "true").text(path)
    return files.select(F.col("_metadata.file_name").alias("statement"), json_in_text(F.col("value")).alias("json"))


def parse_documents(docs: DataFrame, key: str = "statement", text: str = "json") -> DataFrame:
    """Adds metadata, snapshot and status; documents that could not be read fail."""
    d = F.from_json(F.col(text), DOCUMENT)
    out = docs.withColumn("_d", d).select(
        key,
        F.col("_d.document_metadata").alias("metadata"),
        F.from_json(F.col("_d.reconciliation_snapshot"), _SNAPSHOT).alias("snapshot"),
        F.col("_d.transactions").alias("_rows"),
        F.col(text).isNotNull().alias("_parsed"),
    )
    kind = F.coalesce(F.col("metadata.detected_type"), F.lit(""))
    pages = F.coalesce(F.col("metadata.page_count"), F.lit(0))
    unknown = (kind == "unknown") | (pages == 0)
    status = F.when(~F.col("_parsed"), "failed_json").when(unknown, "failed_unknown_type").otherwise("success")
    return out.withColumns(
        {
            "status": status,
            "error_message": F.when(~F.col("_parsed"), "No JSON object found").when(
                unknown, F.concat(F.lit("Could not interpret document (detected_type='"), kind, F.lit("', page_count="),
                                  pages.cast("string"), F.lit(")"))),
        }
    ).drop("_parsed")


def document_rows(parsed: DataFrame, key: str = "statement") -> DataFrame:
    """The transactions of good documents; rows that lack a core field are dropped."""
    rows = parsed.where("status = 'success'").select(key, F.posexplode("_rows").alias("line_no", "_text"))
    keys = F.json_object_keys("_text")
    complete = F.lit(True)
    for f in REQUIRED:
        complete = complete & F.array_contains(keys, f)
    rows = rows.where(F.coalesce(complete, F.lit(False))).withColumn("_t", F.from_json("_text", _ROW))

    def text(name: str, default: str = "") -> Column:
        return F.coalesce(F.nullif(F.col(f"_t.{name}"), F.lit("")), F.lit(default))

    return rows.select(
        key,
        (F.col("line_no") + 1).cast("long").alias("line_no"),
        text("date").alias("date_raw"),
        text("description").alias("description"),
        F.coalesce(F.col("_t.amount").try_cast("decimal(18,2)"), F.lit(0)).cast("decimal(18,2)").alias("amount"),
        text("transaction_type", "vendor_payment").alias("transaction_type"),
        F.coalesce(F.col("_t.include_for_1099"), F.lit(False)).alias("include_for_1099"),
        text("exclusion_reason").alias("exclusion_reason"),
        F.coalesce(F.col("_t.review_required"), F.lit(False)).alias("review_required"),
        text("review_reason").alias("review_reason"),
        F.coalesce(F.col("_t.confidence").try_cast("double"), F.lit(0.0)).alias("confidence"),
        F.coalesce(F.col("_t.source_page").try_cast("int"), F.lit(0)).alias("source_page"),
        text("source_text").alias("source_text"),
    )


def document_snapshots(parsed: DataFrame, key: str = "statement") -> DataFrame:
    """Stated figures per good document, one column each."""
    return parsed.where("status = 'success'").select(key, "snapshot.*")
