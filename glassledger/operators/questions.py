"""Question routing, ad-hoc SQL and ready answers to common questions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: words that name the document or the table as the source
DOCUMENT_CUES = [
    "read the pdf", "in the pdf", "from the pdf", "the pdf says", "in the document", "from the document",
    "per the document", "according to the document", "in the statement", "on the statement",
    "문서에서", "문서를", "pdf에서", "pdf를", "명세서에서", "서류에서",
]
TABLE_CUES = [
    "in the table", "from the table", "in the csv", "from the csv", "in the spreadsheet", "from the spreadsheet",
    "in the excel", "from the excel", "query the table", "run sql",
    "표에서", "표를", "엑셀에서", "엑셀을", "csv에서", "시트에서", "데이터에서",
]
THRESHOLD = 600.0


def explicit_source(question: Column) -> Column:
    """``rag`` or ``sql`` when exactly one source is named, else null."""
    low = F.lower(F.coalesce(question, F.lit("")))
    doc, table = (F.exists(F.array(*[F.lit(c) for c in cues]), lambda c: F.contains(low, c)) for cues in (DOCUMENT_CUES, TABLE_CUES))
    return F.when(doc & ~table, "rag").when(table & ~doc, "sql")


def route(question: Column, has_table: Column, has_document: Column) -> Column:
    named = explicit_source(question)
    return (
        F.when((named == "rag") & has_document, "rag")
        .when((named == "sql") & has_table, "sql")
        .when(has_table & has_document, "sql_then_rag")
        .when(has_table, "sql")
        .when(has_document, "rag")
        .otherwise("general")
    )


def register_tables(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def ask_tables(spark: SparkSession, sql: str) -> DataFrame | None:
    """The query's result, or None when it has no answer: no row, or one row of nulls."""
    df = spark.sql(sql)
    head = df.limit(2).collect()
    if not head or (len(head) == 1 and all(v is None for v in head[0])):
        return None
    return df


def has_answer(result: DataFrame) -> Column:
    """Whether a result is an answer, as a scalar that is part of a plan: it has two rows, or one that is not all null."""
    filled = F.lit(False)
    for c in result.columns:
        filled = filled | F.col(f"`{c}`").isNotNull()
    return result.limit(2).agg(((F.count("*") > 1) | (F.count_if(filled) > 0)).alias("x")).scalar()


def answer_or_retrieve(result: DataFrame, retrieved: DataFrame) -> DataFrame:
    """The rows of a table query as text, or the retrieved chunks where the query has no answer: (source, rank, text).

    One lazy plan: the answer is looked at by a scalar subquery, which switches either side off before it is read.
    """
    found = has_answer(result)
    row = F.concat_ws(" | ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in result.columns])
    answer = result.where(found).select(F.lit("tables").alias("source"), F.lit(None).cast("int").alias("rank"), row.alias("text"))
    chunks = retrieved.where(~found).select(F.lit("documents").alias("source"), F.col("rank").cast("int").alias("rank"), "text")
    return answer.unionByName(chunks)


def table_names(spark: SparkSession, like: str = "*", files: DataFrame | None = None) -> DataFrame:
    """What is loaded: registered tables whose names are ``like`` a pattern and, if given, the ``file_name`` of documents; each once, in order."""
    loaded = spark.sql(f"SHOW VIEWS LIKE '{like}'").where("isTemporary").select(F.col("viewName").alias("table_name"))
    if files is not None:
        loaded = loaded.unionByName(files.select(F.col("file_name").alias("table_name")))
    return loaded.distinct().orderBy("table_name")


# --- vendor master -----------------------------------------------------------------


def vendor_master_answers(vendors: DataFrame) -> DataFrame:
    """One pass over (vendor_name, entity_type, w9_on_file, category, ytd_paid, state)."""
    paid, no_w9 = F.col("ytd_paid"), F.col("w9_on_file") == "No"
    over = paid >= THRESHOLD
    return vendors.agg(
        F.count("*").alias("vendors"),
        F.round(F.sum(paid), 2).alias("total_paid"),
        F.count_if(over).alias("over_600"),
        F.count_if(no_w9).alias("no_w9"),
        F.count_if(no_w9 & over).alias("no_w9_over_600"),
        F.count_if((F.col("entity_type") != "Corporation") & over).alias("non_corporate_over_600"),
        F.max_by("vendor_name", F.struct(paid, "vendor_name")).alias("highest_paid"),
        F.max(paid).alias("highest_paid_amount"),
        F.count_distinct("category").alias("categories"),
    )


def vendors_by(vendors: DataFrame, column: str) -> DataFrame:
    """Vendors and spend per state, category or the like."""
    return vendors.groupBy(column).agg(F.count("*").alias("vendors"), F.round(F.sum("ytd_paid"), 2).alias("total_paid"))


def top_categories(vendors: DataFrame, n: int = 5) -> DataFrame:
    return vendors_by(vendors, "category").orderBy(F.desc("total_paid"), "category").limit(n)


# --- statement periods ----------------------------------------------------------------


def period_answers(rows: DataFrame, opening: Column | float) -> DataFrame:
    """Per period: beginning, deposits, withdrawals, ending balance and rows.

    ``rows`` has period, withdrawal and deposit. One row per period remains
    before the running balance is taken.
    """
    per = rows.groupBy("period").agg(
        F.sum("deposit").alias("deposits"), F.sum("withdrawal").alias("withdrawals"), F.count("*").alias("rows")
    )
    net = F.col("deposits") - F.col("withdrawals")
    w = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    start = opening if isinstance(opening, Column) else F.lit(opening).cast("decimal(18,2)")
    return (
        per.withColumn("ending_balance", (start + F.sum(net).over(w)).cast("decimal(18,2)"))
        .withColumn("beginning_balance", (F.col("ending_balance") - net).cast("decimal(18,2)"))
        .select("period", "beginning_balance", "deposits", "withdrawals", "ending_balance", "rows")
    )


def statement_totals(rows: DataFrame) -> DataFrame:
    big = F.struct("withdrawal", "description")
    return rows.agg(
        F.sum("deposit").alias("deposits"), F.sum("withdrawal").alias("withdrawals"), F.count("*").alias("rows"),
        F.max("withdrawal").alias("largest_withdrawal"), F.max_by("description", big).alias("largest_withdrawal_to"),
    )


def paid_to(rows: DataFrame, words: str) -> DataFrame:
    """What was paid to payees whose description holds the words."""
    return rows.where(F.lower("description").contains(words.lower())).agg(
        F.coalesce(F.sum("withdrawal"), F.lit(0)).cast("decimal(18,2)").alias("paid"), F.count("*").alias("rows")
    )
