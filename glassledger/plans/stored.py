"""Frames that several later steps read, written once in the shared scratch folder."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written as Parquet and read again: later passes read the columns they need and do not repeat the work.

    Columns without a type (all null) cannot be written; they are put back when read.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    untyped = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NullType)}
    written = df.drop(*untyped)
    written.write.parquet(path)
    back = spark.read.schema(written.schema).parquet(path)
    return back.select(*[F.lit(None).alias(c) if c in untyped else F.col(f"`{c}`") for c in df.columns])
