"""Append-only archive of results, partitioned by tool."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREVIEW = 240
_DEFAULTS = {
    "title": "", "language": "", "input_summary": "", "output_content": "", "output_preview": "",
    "output_format": "markdown", "artifact_path": None, "file_type": None, "is_sensitive": False,
    "masked_export_available": False,
}
COLUMNS = [
    "id", "tool_name", "title", "created_at", "language", "input_summary", "output_preview", "output_content",
    "output_format", "artifact_path", "file_type", "is_sensitive", "masked_export_available",
]


def archive_entries(results: DataFrame) -> DataFrame:
    """Results in the archive's shape; the preview is cut from the content when absent.

    ``id`` and ``created_at`` are kept when given (a rerun of lost tasks then
    writes the same ids), else made.
    """
    have = set(results.columns)
    cols = {}
    for name, default in _DEFAULTS.items():
        kind = "boolean" if isinstance(default, bool) else "string"
        d = F.lit(default).cast(kind)
        cols[name] = F.coalesce(F.col(name).cast(kind), d) if name in have else d
    cols["id"] = F.col("id").cast("string") if "id" in have else F.replace(F.uuid(), F.lit("-"), F.lit(""))
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    cols["created_at"] = F.col("created_at").cast("string") if "created_at" in have else now
    df = results.withColumns(cols)
    shown = F.coalesce(F.nullif("output_preview", F.lit("")), F.substring("output_content", 1, PREVIEW))
    return df.withColumn("output_preview", shown).select(*COLUMNS)


def append_history(results: DataFrame, path: str) -> None:
    archive_entries(results).write.mode("append").partitionBy("tool_name").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def list_history(history: DataFrame, tool: str | None = None) -> DataFrame:
    """Newest first; one tool only when named (its partition alone is read)."""
    df = history.where(F.col("tool_name") == tool) if tool else history
    return df.orderBy(F.desc("created_at"), F.desc("id"))


def list_tools(history: DataFrame) -> DataFrame:
    return history.select("tool_name").distinct().orderBy("tool_name")
