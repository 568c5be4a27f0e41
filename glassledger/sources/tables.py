"""Delimited tables, ledgers and vendor lists as frames; frames as files."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from ..operators.ledger import missing_columns, queue_export
from ..operators.table_repair import repair_table
from ..rules import vendors as V
from .names import unique_names

# fixed values: cell texts that stand for a missing value
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
           "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


#: Quotes inside quoted cells are doubled, and a backslash is an ordinary character.
DIALECT = {"quote": '"', "escape": '"'}


def _separator(path: str) -> str:
    return "\t" if path.lower().rstrip("/").endswith(".tsv") else ","


def header_row(spark: SparkSession, path: str, sep: str) -> list[str | None]:
    """The first line of the file(s), cell by cell."""
    row = spark.read.options(**DIALECT).option("sep", sep).option("header", "false").csv(path).first()
    return list(row) if row is not None else []


def read_text_columns(spark: SparkSession, path: str, names: list[str], sep: str = ",", multi_line: bool = False) -> DataFrame:
    """Every column as text, missing-value marks as null.

    ``multi_line`` lets quoted cells hold line breaks; a file is then read by one task, as it cannot be split."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    reader = spark.read.options(**DIALECT).option("sep", sep).option("header", "true").option("multiLine", multi_line)
    df = reader.option("enforceSchema", "true").csv(path, schema=schema)
    return df.select(*[F.when(~F.col(f"`{n}`").isin(MISSING), F.col(f"`{n}`")).alias(n) for n in names])


def scan_table(spark: SparkSession, path: str, repair: bool = True, multi_line: bool = False) -> DataFrame:
    """A CSV (or TSV, by extension) with safe unique names; money and dates repaired."""
    sep = _separator(path)
    df = read_text_columns(spark, path, unique_names(header_row(spark, path, sep)), sep, multi_line)
    return repair_table(df) if repair else df


def scan_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A ledger CSV; an error names the required columns it lacks."""
    names = [(n or "").strip() for n in header_row(spark, path, ",")]
    df = read_text_columns(spark, path, names)
    missing = missing_columns(df)
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")
    return df


def scan_ledger_export(spark: SparkSession, path: str) -> DataFrame:
    """An accounting-package export: blank headers become ``Unnamed: i``; adds ``row_no``."""
    names = [n if n else f"Unnamed: {i}" for i, n in enumerate(header_row(spark, path, ","))]
    return read_text_columns(spark, path, names).withColumn("row_no", F.monotonically_increasing_id())


def scan_vendor_list(spark: SparkSession, path: str, profile: str = "consolidated") -> DataFrame:
    """First column as vendor names (pos, name); each file's header line and blanks are dropped.

    ``pos`` orders by file name, then by place in the file (up to 1,024 files and a million splits fit into it).
    """
    heads = V.LIST_HEADERS if profile == "consolidated" else V.WORKSHEET_LIST_HEADERS
    read = spark.read.options(**DIALECT).option("header", "false").csv(path)
    rows = read.select(F.col("_metadata.file_path").alias("_file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("id")).alias("_at"),
                       strip(F.coalesce("_c0", F.lit(""))).alias("name"))
    # one row per file, so the window is as small as the list of files
    files = rows.groupBy("_file").agg(F.min("_at").alias("_top")).withColumn("_rank", F.row_number().over(Window.orderBy("_file")) - 1)
    rows = rows.join(files, "_file")
    header = (F.col("_at") == F.col("_top")) & F.lower("name").isin(heads)
    pos = F.shiftleft(F.col("_rank").cast("long"), 53) + F.col("_at.id")
    return rows.where((F.col("name") != "") & ~header).select(pos.alias("pos"), "name")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    writer.options(**DIALECT).option("header", "true").csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def write_queue(scored: DataFrame, path: str, fmt: str = "csv") -> None:
    """The flagged rows with their export columns."""
    write_table(queue_export(scored), path, fmt)


def write_sheets(sheets: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """One folder per report sheet."""
    for name, df in sheets.items():
        write_table(df, f"{path}/{name}", fmt)


def preview(df: DataFrame, rows: int = 50) -> DataFrame:
    """The first rows for display: dates as yyyy-MM-dd, nulls as empty text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(F.coalesce(c.cast("string"), F.lit("")).alias(f.name))
    return df.limit(rows).select(*cols)
