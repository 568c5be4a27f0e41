"""Type repair of all-text tables: money to numbers, dates to ISO companions."""
from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip

MONEY = r"^\(?-?\$?\s*[\d,]+(\.\d+)?\)?$"
SHARE = 0.8
# fixed values: date shapes; (name, regex, parts in order)
DATE_SHAPES = [
    ("ymd", r"^(\d{4})-(\d{1,2})-(\d{1,2})$"),
    ("slash4", r"^(\d{1,2})/(\d{1,2})/(\d{4})$"),
    ("slash2", r"^(\d{1,2})/(\d{1,2})/(\d{2})$"),
    ("dot", r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$"),
]
_ANY_DATE = "|".join(f"(?:{r})" for _, r in DATE_SHAPES)
_PIVOT_YEAR = 70


def money_to_number(c: Column) -> Column:
    """``$1,850.00`` / ``(25.00)`` -> double; anything else null."""
    bare = F.regexp_replace(F.regexp_replace(strip(c), r"[$,\s]", ""), r"^\((.*)\)$", "-$1")
    n = bare.try_cast("double")
    return F.when(~F.isnan(n), n)


def iso_date(c: Column, day_first: bool) -> Column:
    """``yyyy-MM-dd`` by the shape alone; no calendar check, so 2024-13-40 can come out."""
    s = strip(c)
    out = None
    for name, regex in DATE_SHAPES:
        a, b, d = (F.regexp_extract(s, regex, i) for i in (1, 2, 3))
        if name == "ymd":
            y, m, day = a, b, d
        else:
            m, day = (b, a) if day_first else (a, b)
            y = d
            if name == "slash2":
                y = F.concat(F.when(d.try_cast("int") < _PIVOT_YEAR, "20").otherwise("19"), d)
        text = F.concat(F.lpad(y, 4, "0"), F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))
        out = F.when(s.rlike(regex), text) if out is None else out.when(s.rlike(regex), text)
    return out


def _text_columns(df: DataFrame, skip: list[str]) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in skip]


def measure_text(df: DataFrame, columns: list[str]):
    """Per column, in one pass: filled cells, money, plain numbers, dates, first parts above 12."""
    aggs = []
    for i, name in enumerate(columns):
        s = strip(F.col(f"`{name}`"))
        first = F.regexp_extract(s, r"^(\d{1,2})[/.]", 1).try_cast("int")
        filled = s.isNotNull() & (s != "")
        aggs += [
            F.count_if(filled).alias(f"n{i}"),
            F.count_if(filled & s.rlike(MONEY)).alias(f"m{i}"),
            F.count_if(filled & s.try_cast("double").isNotNull()).alias(f"p{i}"),
            F.count_if(filled & s.rlike(_ANY_DATE)).alias(f"d{i}"),
            F.count_if(s.rlike(_ANY_DATE) & (first > 12)).alias(f"f{i}"),
        ]
    return df.agg(*aggs).first()


def repair_table(df: DataFrame, skip: list[str] | None = None) -> DataFrame:
    """A text column becomes numeric when at least 80 % of its filled cells are money
    (or all are numbers); one with at least 80 % dates gets a ``<name>_iso`` companion.
    Day-first is taken when any first part exceeds 12."""
    columns = _text_columns(df, skip or [])
    if not columns:
        return df
    m = measure_text(df, columns)
    changed, added = {}, {}
    for i, name in enumerate(columns):
        n = m[f"n{i}"]
        if not n:
            continue
        if m[f"m{i}"] / n >= SHARE or m[f"p{i}"] == n:
            changed[name] = money_to_number(F.col(f"`{name}`"))
        elif m[f"d{i}"] / n >= SHARE:
            added[f"{name}_iso"] = iso_date(F.col(f"`{name}`"), m[f"f{i}"] > 0)
    kept = [changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in df.columns]
    return df.select(*kept, *[v.alias(k) for k, v in added.items()])


_DATE_CELL = r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$"


def looks_like_data(cells: Column) -> Column:
    """True when a would-be header row holds money or a date."""
    def is_data(c: Column) -> Column:
        s = strip(F.coalesce(c, F.lit("")))
        return (s != "") & (s.rlike(MONEY) | s.rlike(_DATE_CELL))

    return F.exists(cells, is_data)


def _least_values(k: int):
    """A task's number of rows and, for each column, the ``k`` least distinct values."""
    def task(batches):
        rows, found = 0, {}
        for b in batches:
            rows += b.num_rows
            for i, column in enumerate(b.columns):
                values = pc.unique(column).drop_null()
                few = values.take(pc.bottom_k_unstable(values, k)).to_pylist() if len(values) else []
                found[i] = sorted({*found.get(i, ()), *few}, key=str.encode)[:k]
        n, part = len(found), TaskContext.get().partitionId() % _MERGERS
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(1, n + 1), pa.int32()), pa.array([part] * n, pa.int32()), pa.array([rows] * n, pa.int64()), pa.array(list(found.values()), pa.list_(pa.string()))],
            ["position", "part", "rows", "samples"])

    return task


_MERGERS = 64


def schema_profile(df: DataFrame, table: str, samples: int = 3) -> DataFrame:
    """Per column: type, rows of the table and up to ``samples`` distinct filled values (the least ones).

    One pass over all columns: every task keeps the least distinct values of each, and these few are merged in two steps, so
    that neither the distinct values of a column nor the lists of all tasks are ever gathered.
    """
    spark, names = df.sparkSession, df.columns
    texts = [F.nullif(strip(F.col(f"`{n}`").cast("string")), F.lit("")).alias(f"c{i}") for i, n in enumerate(names)]
    parts = df.select(*texts).mapInArrow(_least_values(samples), "position int, part int, rows long, samples array<string>")

    def merged(by: DataFrame, *keys: str) -> DataFrame:
        least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("samples")))), 1, samples)
        return by.groupBy(*keys).agg(F.sum("rows").alias("rows"), least.alias("samples"))

    columns = spark.createDataFrame([(table, i, n, t) for i, (n, t) in enumerate(df.dtypes, 1)], "table_name string, position int, column_name string, column_type string")
    found = merged(merged(parts, "position", "part"), "position")
    return columns.join(found, "position", "left").select(
        "table_name", "position", "column_name", "column_type", F.coalesce("rows", F.lit(0)).alias("rows"),
        F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))
