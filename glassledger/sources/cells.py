"""Tables given as cells: (document, page, table_no, row_no, cells array)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.text import strip
from ..operators.table_repair import looks_like_data, repair_table

TABLE = ["document", "table_no"]


def _clean(cells: Column) -> Column:
    return F.transform(cells, lambda c: strip(F.coalesce(c, F.lit(""))))


def number_repeats(names: Column) -> Column:
    """The second and later uses of a name get ``_1``, ``_2``."""
    def one(h: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(names, 1, i), lambda x: x == h))
        return F.when(before == 0, h).otherwise(F.concat(h, F.lit("_"), before.cast("string")))

    return F.transform(names, one)


def safe_names(names: Column) -> Column:
    """As ``sources.names.unique_names``, for header cells held in a column."""
    def safe(h: Column, i: Column) -> Column:
        s = F.btrim(F.regexp_replace(F.regexp_replace(strip(F.coalesce(h, F.lit(""))), "[^0-9a-zA-Z_]", "_"), "_+", "_"), F.lit("_"))
        s = F.when(s.rlike(r"^\d"), F.concat(F.lit("t_"), s)).otherwise(s)
        return F.when(s == "", F.concat(F.lit("col"), (i + 1).cast("string"))).otherwise(s)

    return number_repeats(F.transform(names, safe))


def concat_tables(cells: DataFrame, page_texts: DataFrame) -> DataFrame:
    """All tables under each other by column name, absent columns null.

    The first row of a table is its header; tables of one row are passed over.
    Without any table the page texts come back as (page, content).
    """
    tidy = cells.withColumn("cells", _clean(F.col("cells")))
    head = tidy.where("row_no = 0").select(*TABLE, number_repeats(F.col("cells")).alias("header"))
    body = tidy.where("row_no > 0").join(head, TABLE)
    width = F.least(F.size("header"), F.size("cells"))
    pairs = body.withColumn(
        "_m", F.map_from_arrays(F.slice("header", 1, width), F.slice("cells", 1, width))
    )
    # names become columns, so they have to be known here; they are as few as a frame may have columns
    seen = body.select(*TABLE, F.posexplode("header").alias("at", "name")).groupBy("name").agg(
        F.min(F.struct(*TABLE, "at")).alias("o")
    )
    names = [r["name"] for r in seen.orderBy("o").select("name").collect()]
    if not names:
        return page_texts.where(strip(F.col("text")) != "").select("page", strip(F.col("text")).alias("content"))
    wide = pairs.select(*[F.col("_m")[n].alias(n) for n in names]).dropna("all")
    filled = wide.agg(*[F.count(F.col(f"`{n}`")).alias(f"n{i}") for i, n in enumerate(names)]).first()
    return wide.select(*[F.col(f"`{n}`") for i, n in enumerate(names) if filled[f"n{i}"]])


def page_tables(cells: DataFrame) -> DataFrame:
    """Rows of page tables with the table each belongs to.

    Gives (document, table_name, columns, values, source_page, source_label, row_no).
    A first row that is data gets generic column names. Tables of one document and
    kind with the columns of the first of them are one table; any other becomes a
    table of its own, numbered from 2. ``cells`` has ``page`` and ``label`` too.
    """
    first = cells.where("row_no = 0").join(
        cells.groupBy(*TABLE).agg(F.max(F.size("cells")).alias("width")), TABLE
    )
    data = looks_like_data(F.col("cells"))
    generic = F.when(F.col("width") == 2, F.array(F.lit("label"), F.lit("value"))).otherwise(
        F.transform(F.sequence(F.lit(1), F.col("width")), lambda i: F.concat(F.lit("col"), i.cast("string")))
    )
    words = F.lower(F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit(""))), " "))
    kind = (
        F.when(words.contains("date") & (words.contains("description") | words.contains("amount")), "transactions")
        .when(F.size("cells") == 2, "summary")
        .otherwise(F.concat(F.lit("t"), F.col("table_no").cast("string")))
    )
    tables = first.select(
        *TABLE, kind.alias("kind"), data.alias("headless"),
        F.when(data, generic).otherwise(safe_names(F.col("cells"))).alias("columns"),
    )
    w = Window.partitionBy("document", "kind").orderBy("table_no")  # tables of one document only
    tables = tables.withColumn("_first", F.first("columns").over(w)).withColumn("_new", (F.col("columns") != F.col("_first")).cast("int"))
    nth = F.sum("_new").over(w)
    stem = F.concat(F.col("document"), F.lit("_"), F.col("kind"))
    name = F.when(F.col("_new") == 1, F.concat(stem, F.lit("_"), (nth + 1).cast("string"))).otherwise(stem)
    tables = tables.withColumn("table_name", name).drop("_first", "_new", "kind")
    rows = cells.join(tables, TABLE).where(F.col("headless") | (F.col("row_no") > 0))
    rows = rows.where(F.exists("cells", lambda c: strip(F.coalesce(c, F.lit(""))) != ""))
    values = F.transform(F.sequence(F.lit(0), F.size("columns") - 1), lambda i: F.get(F.col("cells"), i))
    return rows.select(
        "document", "table_name", "columns", values.alias("values"), F.col("page").alias("source_page"),
        F.col("label").alias("source_label"), "table_no", "row_no",
    )


def page_table(rows: DataFrame, table_name: str) -> DataFrame:
    """One of the ``page_tables`` as a frame of its own, money and dates repaired."""
    mine = rows.where(F.col("table_name") == table_name)
    names = mine.select("columns").first()["columns"]
    body = mine.select(*[F.col("values")[i].alias(n) for i, n in enumerate(names)], "source_page", "source_label")
    return repair_table(body, skip=["source_label"])
