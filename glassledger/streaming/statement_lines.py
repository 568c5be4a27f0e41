"""Statement text files as they arrive, through the same operators as in batch.

Every step works on one line at a time, so the stream keeps no state and needs
no watermark; exactly-once delivery comes from the sink's checkpoint.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import strip
from ..operators.classify_rows import classify_rows
from ..operators.statement_lines import extract_rows, skip_line


def read_lines(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Lines of new text files: (document, line)."""
    stream = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return stream.select(F.col("_metadata.file_name").alias("document"), F.col("value").alias("line"))


def typed_rows(lines: DataFrame) -> DataFrame:
    """Classified rows of a stream (or a batch) of lines."""
    filled = lines.where((strip(F.col("line")) != "") & ~skip_line(F.col("line")))
    return classify_rows(extract_rows(filled))


def write_rows(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to a table; runs until the files at hand are done."""
    return (
        rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
