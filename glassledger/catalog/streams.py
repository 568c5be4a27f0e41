"""Streaming queries over the benchmark tables, run until all files are read."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.adapters import statement_rows
from ..session import scratch_path
from ..streaming import yearly_totals as Y
from .sql import BASE


#: Files of all years arrive mixed, so a row may be as late as the orders' dates reach.
LATENESS = "4000 days"


def yearly_totals_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Orders dealt over files by key, taken in three micro-batches or so: the changes of all totals."""
    landing, out, marks = (scratch_path(spark, label) for label in ("landing", "yearly", "yearly-marks"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    statement_rows(spark, sf).repartition(n, "line_no").write.parquet(landing)
    rows = Y.read_rows(spark, landing, files_per_trigger=max(1, -(-n // 3)))
    Y.keep_changes(Y.yearly_changes(rows, LATENESS), out, marks).awaitTermination()
    return Y.read_changes(spark, out)


def yearly_vendor_totals(spark: SparkSession, sf: str) -> DataFrame:
    return Y.latest_totals(yearly_totals_stream(spark, sf)).withColumn("total_amount", F.col("total_amount").cast("double"))


def threshold_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Each alert with what can be said of it for any order of files."""
    found = Y.alerts(yearly_totals_stream(spark, sf))
    return found.select("canonical_name", "year", (F.col("previous_amount") < 600).alias("was_below"), (F.col("total_amount") >= 600).alias("is_over"))


_PAID = "WITH " + BASE + ",\npaid AS (SELECT canonical_name, year(paid_on) AS year, amount FROM norm WHERE NOT norm_excluded AND include_for_1099)\n"
QUERIES = {"yearly_vendor_totals": yearly_vendor_totals, "threshold_alerts": threshold_alerts}
ORACLE = {
    "yearly_vendor_totals": _PAID + """SELECT canonical_name, year, CAST(sum(amount) AS DOUBLE) AS total_amount, count(*) AS payments,
  CAST(CASE WHEN sum(amount) >= 600 THEN 1 ELSE 0 END AS BIGINT) AS alerts FROM paid GROUP BY 1, 2""",
    "threshold_alerts": _PAID + "SELECT canonical_name, year, true AS was_below, true AS is_over FROM paid GROUP BY 1, 2 HAVING sum(amount) >= 600",
}
