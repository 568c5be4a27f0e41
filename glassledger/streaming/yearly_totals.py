"""Running yearly totals per vendor over arriving statement rows, with one alert when a total reaches the filing threshold.

Rows carry their own day, which is the event time: a row older than the watermark (the latest day seen less ``lateness``) is late and left
out, so ``lateness`` says how far out of order files may arrive. A row seen twice within that span, by (statement, line_no), counts once.
The state is a total, a number of payments and whether the alert went out, per vendor and year; it goes when the watermark has passed
the year. Every micro-batch writes the totals it changed under its own number, replacing what a failed attempt left there, so that a
restart from the checkpoint neither loses nor repeats an alert. Amounts of zero or more give the same totals and alerts for any order
of files; after a negative amount (a refund) a total may fall again, and the alert stands.

Rows without a readable day belong to no year and are left out. Null vendor or amount: left out as well.
"""
from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import strip
from ..operators.classify_rows import classify_rows
from ..operators.vendor_names import normalise_vendors
from ..operators.vendor_rollup import countable_rows
from ..rules import vendors as R

ROW = "statement string, line_no long, date_raw string, description string, amount decimal(18,2)"
_CHANGE = "canonical_name string, year int, cents long, payments long, before long, crossed boolean"
_STATE = "cents long, payments long, alerted boolean"


def read_rows(spark: SparkSession, folder: str, schema: str = ROW, files_per_trigger: int = 1000) -> DataFrame:
    """Statement rows of new Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def payments(rows: DataFrame) -> DataFrame:
    """The rows of a stream (or a batch) that count for 1099 totals: statement, line_no, canonical_name, paid_at, cents."""
    text = F.nullif(strip(F.col("date_raw")), F.lit(""))
    paid = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("M/d/yyyy", "M/d/yy", "yyyy-M-d")])
    named = countable_rows(normalise_vendors(classify_rows(rows)))
    return named.select("statement", "line_no", "canonical_name", paid.cast("timestamp").alias("paid_at"), (F.col("amount") * 100).cast("long").alias("cents")).where(
        "canonical_name IS NOT NULL AND paid_at IS NOT NULL AND cents IS NOT NULL")


def _add(threshold: int):
    def update(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before, count, alerted = state.get if state.exists else (0, 0, False)
        cents = before
        for chunk in chunks:
            cents += int(chunk["cents"].sum())
            count += len(chunk)
        crossed = cents >= threshold and not alerted
        state.update((cents, count, alerted or crossed))
        state.setTimeoutTimestamp(int(datetime(key[1] + 1, 1, 1, tzinfo=timezone.utc).timestamp() * 1000))
        yield pd.DataFrame({"canonical_name": [key[0]], "year": [key[1]], "cents": [cents], "payments": [count], "before": [before], "crossed": [crossed]})

    return update


def yearly_changes(rows: DataFrame, lateness: str = "400 days", threshold: float = R.THRESHOLD) -> DataFrame:
    """One row for each total that a micro-batch changes; ``crossed`` is true once for a vendor and year."""
    once = payments(rows).withWatermark("paid_at", lateness).dropDuplicatesWithinWatermark(["statement", "line_no"])
    by = once.withColumn("year", F.year("paid_at")).groupBy("canonical_name", "year")
    changed = by.applyInPandasWithState(_add(round(threshold * 100)), _CHANGE, _STATE, "append", GroupStateTimeout.EventTimeTimeout)

    def money(c: str):
        return (F.col(c).cast("decimal(20,0)") / 100).cast("decimal(18,2)")

    return changed.select("canonical_name", "year", money("cents").alias("total_amount"), "payments", money("before").alias("previous_amount"), "crossed")


def keep_changes(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes every micro-batch's changes under ``path``; runs until the files at hand are done."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


_KEPT = "canonical_name string, year int, total_amount decimal(18,2), payments long, previous_amount decimal(18,2), crossed boolean, batch int"


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_KEPT).parquet(path)


def latest_totals(changes: DataFrame) -> DataFrame:
    """The totals as they stand: canonical_name, year, total_amount, payments, alerts."""
    last = F.max_by(F.struct("total_amount", "payments"), "batch").alias("_t")
    return changes.groupBy("canonical_name", "year").agg(last, F.count_if("crossed").alias("alerts")).select("canonical_name", "year", "_t.*", "alerts")


def alerts(changes: DataFrame) -> DataFrame:
    return changes.where("crossed").select("canonical_name", "year", "previous_amount", "total_amount", "batch")
