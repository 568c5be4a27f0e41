"""Tables written between jobs, in the folder that all executors share."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glassledger.session import scratch_path


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A task is given so many rows at least, as long as there are two tasks a core.
ROWS = 1 << 14


def in_tasks(df: DataFrame, rows: int) -> DataFrame:
    """The rows, some ``rows`` in number, in no more tasks than they need, however many partitions their shuffle has.

    A task costs its start, its Python worker's call and the files it writes, whatever it holds. Nothing moves for it,
    and with more rows there are more tasks, up to the partitions there are."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS)))


def keep(df: DataFrame, label: str) -> DataFrame:
    """The rows written once and read again: later jobs neither repeat the work nor hang on a lost executor.

    Once they are written, the shuffle files behind them are of no more use and go at once."""
    spark = df.sparkSession
    path, before = scratch_path(spark, label), spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        # planned anew, so that the setting holds for it
        df.select("*").write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._kept_path = path
    return table


def forget(*tables: DataFrame | None) -> None:
    """Deletes tables made by ``keep`` that no later step reads."""
    for df in tables:
        path = getattr(df, "_kept_path", None)
        if path:
            folder, conf = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path), df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            folder.getFileSystem(conf).delete(folder, True)


def _stars(batches):
    """The edges of a task, some at a time, as stars: every id tied to the smallest that it reaches through them, in both directions."""
    for rows in blocks(batches):
        ids, ends = np.unique(np.concatenate([rows.column(c).to_numpy() for c in ("v", "m")]), return_inverse=True)
        a, b = np.split(ends, 2)
        top = np.arange(len(ids))
        while True:
            x, y = top[a], top[b]
            if (x == y).all():
                break
            np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
            while (top != top[top]).any():
                top = top[top]
        low = top < np.arange(len(ids))
        v, m = ids[low], ids[top[low]]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([v, m])), pa.array(np.concatenate([m, v]))], ["v", "m"])


def blocks(batches, rows: int = 1 << 20):
    """The batches of a task, put together up to so many rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _settled(now: DataFrame) -> bool:
    """Whether every component is one star: nothing is tied twice, and what others are tied to is tied to nothing."""
    ends = now.select(F.col("v").alias("id"), F.lit(1).alias("_tied"), F.lit(0).alias("_top")).unionByName(now.select(F.col("m").alias("id"), F.lit(0).alias("_tied"), F.lit(1).alias("_top")))
    ends = ends.groupBy("id").agg(F.sum("_tied").alias("_tied"), F.max("_top").alias("_top"))
    return not ends.where(F.col("_tied") + F.col("_top") > 1).take(1)


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each end of an edge (a, b) reaches.

    Edges are contracted: every task turns the edges it holds into stars; then, in turn, every id ties its larger neighbours to
    its smallest one (large star), then itself and its smaller neighbours to the smallest (small star), until each component is one star.
    The rounds grow with the logarithm of the longest path, whatever the order of its ids, and no edge is added. A hub is many partial
    minima, and its join is split by adaptive execution. Each table goes as soon as its successor is written.
    """
    now = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).where("v <> m")
    while True:
        # written, as both uses must see the same stars: they depend on which edges meet in a task
        both = keep(now.mapInArrow(_stars, "v long, m long"), "stars")
        forget(now)
        rows = both.count()
        least = both.groupBy("v").agg(F.least(F.min("m"), F.col("v")).alias("least"))
        large = both.where("m > v").join(least, "v").select(F.col("m").alias("v"), F.col("least").alias("m"))
        large = keep(in_tasks(large.where("v <> m").distinct(), rows), "edges")
        forget(both)
        least = large.groupBy("v").agg(F.min("m").alias("least"))
        small = large.join(least, "v")
        ties = small.select("v", F.col("least").alias("m")).unionByName(small.select(F.col("m").alias("v"), F.col("least").alias("m")))
        now = keep(in_tasks(ties.where("v <> m").distinct(), rows), "edges")
        forget(large)
        if _settled(now):
            break
    ends = F.explode(F.array(F.struct(F.col("v").alias("id"), F.col("m").alias("component")), F.struct(F.col("m").alias("id"), F.col("m").alias("component"))))
    labels = keep(in_tasks(now.select(ends.alias("end")).select("end.*").distinct(), rows), "labels")
    forget(now)
    return labels
