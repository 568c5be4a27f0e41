"""Ledger, statement and document frames derived from the benchmark tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A benchmark table; how its files are split is the session's business (``spark.sql.files.maxPartitionBytes``)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as ledger entries."""
    li, part, supp = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    joined = li.join(part, li.l_partkey == part.p_partkey).join(supp, li.l_suppkey == supp.s_suppkey)
    price = F.col("l_extendedprice")
    return joined.select(
        F.col("l_shipdate").alias("date"),
        F.when(F.col("l_linenumber") == 7, F.round(price, -2)).otherwise(price).alias("amount"),
        F.col("p_type").alias("account_name"),
        F.col("p_brand").alias("account_code"),
        F.concat("s_name", F.lit("-"), (F.col("l_partkey") % 200).cast("string")).alias("vendor"),
        F.when(~((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)), F.col("p_name")).alias("description"),
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("journal_ref"),
        F.when(F.col("l_linestatus") == "F", price).otherwise(0.0).alias("debit_amount"),
        F.when(F.col("l_linestatus") == "O", price).otherwise(0.0).alias("credit_amount"),
    )


def dealt_orders(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Narrow order rows dealt out by their key, as costly text rules follow: one large file would else be one task."""
    return table(spark, sf_dir, "orders").select("o_orderkey", *columns).repartition("o_orderkey")


def statement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines of yearly bank statements; every part in turn names the payee."""
    part = table(spark, sf_dir, "part")
    names = part.select("p_partkey", F.upper(F.concat("p_name", F.lit(" "), "p_type")).alias("nm"))
    n_parts = part.agg(F.count("*").alias("n")).scalar()
    key = F.col("o_orderkey")
    orders = dealt_orders(spark, sf_dir, "o_orderdate", "o_totalprice").withColumn("_part", key % n_parts)
    rows = orders.join(names, F.col("p_partkey") == F.col("_part"))
    no, nm = key.cast("string"), F.col("nm")
    kind = F.floor(key / 7) % 10
    text = (
        F.when(kind == 0, F.concat(F.lit("ACH Payment - "), nm, F.lit(" LLC")))
        .when(kind == 1, F.concat(F.lit("Check "), no, F.lit(" - "), nm))
        .when(kind == 2, F.concat(F.lit("Check #"), no))
        .when(kind == 3, F.lit("PAYROLL DIRECT DEP"))
        .when(kind == 4, F.lit("TRANSFER TO SAVINGS"))
        .when(kind == 5, F.lit("OPENING BALANCE"))
        .when(kind == 6, F.concat(F.lit("Debit Card - "), nm, F.lit(" INC")))
        .when(kind == 7, F.lit("MONTHLY FEE"))
        .when(kind == 8, F.lit("INTEREST EARNED"))
        .otherwise(F.concat(nm, F.lit(" LAW GROUP")))
    )
    cents = F.floor(F.round(F.col("o_totalprice") * 100).cast("bigint") / 1000).cast("bigint")
    return rows.select(
        F.concat(F.lit("stmt_"), F.year("o_orderdate").cast("string")).alias("statement"),
        key.alias("line_no"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("date_raw"),
        text.alias("description"),
        (cents.cast("decimal(16,0)") / 100).cast("decimal(18,2)").alias("amount"),
    )


LINES_PER_PAGE = 40


def statement_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement lines as page texts of at most ``LINES_PER_PAGE`` lines.

    Order keys are unique, so a page can hold no more lines than that. Every third
    line shows a running balance; every fifth page is a tax form as well.
    """
    rows = statement_rows(spark, sf_dir)
    page = F.floor(F.col("line_no") / LINES_PER_PAGE)
    line = F.concat_ws(
        " ", "date_raw", "description", F.format_number("amount", 2),
        F.when(F.col("line_no") % 3 == 0, F.format_number(F.col("amount") + 5000, 2)),
    )
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", line.alias("t")))), lambda s: s["t"]), "\n")
    form = F.when(F.col("page_no") % 5 == 0, "\nForm 1099-NEC\nNonemployee compensation $ 1,500.00").otherwise("")
    pages = rows.withColumn("page_no", page).groupBy("page_no").agg(lines.alias("lines"))
    return pages.select(
        F.concat(F.lit("doc_"), F.col("page_no").cast("string")).alias("document"), F.lit(1).alias("page"),
        F.concat(F.lit("Date Description Amount\n\n"), F.col("lines"), form, F.lit("\nTotal for page\nPage 1")).alias("text"),
    )


def statement_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page of lines as a table of cells; income stands in the deposit column."""
    rows = statement_rows(spark, sf_dir).withColumn("page_no", F.floor(F.col("line_no") / LINES_PER_PAGE))
    paid = F.format_number("amount", 2)
    income = F.col("description").rlike("^(PAYROLL|INTEREST|OPENING|MONTHLY)")
    doc = F.concat(F.lit("doc_"), F.col("page_no").cast("string")).alias("document")
    odd = F.col("page_no") % 2 == 1
    body = rows.select(
        doc, F.lit(1).alias("page"), F.lit(1).alias("table_no"), (F.col("line_no") % LINES_PER_PAGE + 1).cast("int").alias("row_no"),
        F.when(odd, F.array("date_raw", "description", F.when(~income, paid).otherwise(""), F.when(income, paid).otherwise("")))
        .otherwise(F.array("description", "date_raw", F.when(~income, paid).otherwise(""), F.when(income, paid).otherwise(""))).alias("cells"),
    )
    heads = rows.select("page_no").distinct().select(
        doc, F.lit(1).alias("page"), F.lit(1).alias("table_no"), F.lit(0).alias("row_no"),
        F.when(odd, F.array(*[F.lit(h) for h in ("Date", "Description", "Withdrawal", "Deposit")]))
        .otherwise(F.array(*[F.lit(h) for h in ("Payee", "Post Date", "Debit", "Credit")])).alias("cells"),
    )
    return heads.unionByName(body)


def tax_form_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One short document per customer; six kinds of tax form, a card and a bank statement."""
    figure = F.format_number(F.abs("c_acctbal"), 2)
    kind = F.col("c_custkey") % 8
    texts = [
        ["Form 1099-NEC\nNonemployee compensation $ ", figure],
        ["Form 1099-MISC\nRents $ ", figure, "\nOther income: ", figure],
        ["Form 1099-INT\nInterest income ", figure],
        ["Form W-2\nWages, tips: ", figure],
        ["Schedule C\nGross receipts $", figure],
        ["Schedule E\nLine 1 ", figure],
        ["Credit card ending 1234\nNew charges ", figure],
        ["Checking account\nDeposits ", figure],
    ]
    text = F.lit("")
    for k, parts in enumerate(texts):
        text = F.when(kind == k, F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])).otherwise(text)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document"), text.alias("text"))


def typed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transcribed statement rows, one statement per customer."""
    kinds = ["deposit", "interest", "reimbursement", "vendor_payment", "check_payment", "transfer", "owner_draw", "bank_fee", "unknown"]
    cents = F.floor(F.round(F.col("o_totalprice") * 100).cast("bigint") / 1000).cast("bigint")
    return dealt_orders(spark, sf_dir, "o_custkey", "o_orderdate", "o_totalprice").select(
        F.concat(F.lit("cust_"), F.col("o_custkey").cast("string")).alias("statement"), F.col("o_custkey").alias("_cust"),
        F.col("o_orderkey").alias("line_no"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("date_raw"),
        F.get(F.array(*[F.lit(k) for k in kinds]), (F.col("o_orderkey") % 9).cast("int")).alias("transaction_type"),
        (cents.cast("decimal(16,0)") / 100).cast("decimal(18,2)").alias("amount"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated figures per customer statement: some lump all debits, some lack a figure, some are off by 1.00."""
    t = typed_rows(spark, sf_dir)
    kind = F.col("transaction_type")

    def total(*kinds: str):
        return F.coalesce(F.sum(F.when(kind.isin(*kinds), F.col("amount"))), F.lit(0)).cast("decimal(18,2)")

    s = t.groupBy("statement", "_cust").agg(
        total("deposit", "interest", "reimbursement").alias("dep"), total("vendor_payment").alias("wd"),
        total("check_payment").alias("ck"), total("transfer", "owner_draw").alias("tr"), total("bank_fee").alias("fee"),
    )
    c, start = F.col("_cust"), F.lit(1000).cast("decimal(18,2)")
    lump = c % 3 == 0
    debits = F.col("wd") + F.col("ck") + F.col("tr") + F.col("fee")
    money = lambda x: x.cast("decimal(18,2)")
    return s.select(
        "statement", start.alias("beginning_balance"),
        money(F.col("dep") + F.when(c % 4 == 0, 1).otherwise(0)).alias("total_deposits"),
        money(F.when(lump, debits).otherwise(F.col("wd"))).alias("total_withdrawals"),
        F.when(~lump, F.col("ck")).alias("checks"), F.when(~lump, F.col("tr")).alias("transfers"), F.when(~lump, F.col("fee")).alias("fees"),
        money(F.when(c % 11 != 0, start + F.col("dep") - debits)).alias("reported_ending_balance"),
    )


DOC_ROWS = 50


def statement_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcribed documents of at most ``DOC_ROWS`` rows as JSON, bare, fenced or inside prose.

    Every seventh document could not be read; every sixth row lacks a core field.
    """
    t = typed_rows(spark, sf_dir)
    row = F.when(
        F.col("line_no") % 6 != 0,
        F.to_json(F.struct(F.col("date_raw").alias("date"), F.concat(F.lit("Order "), F.col("line_no").cast("string")).alias("description"),
                           F.col("amount").cast("double").alias("amount"), "transaction_type",
                           (F.col("line_no") % 2 == 0).alias("include_for_1099"), F.lit(0.9).alias("confidence"))),
    ).otherwise(F.to_json(F.struct(F.col("date_raw").alias("date"), "transaction_type")))
    doc = F.floor(F.col("line_no") / DOC_ROWS)
    d = t.groupBy(doc.alias("n")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", row.alias("j")))), lambda s: s["j"]), ", ").alias("rows"))
    body = F.concat(
        F.lit('{"document_metadata": {"detected_type": "'), F.when(F.col("n") % 7 == 0, "unknown").otherwise("bank_statement"),
        F.lit('", "page_count": 2}, "reconciliation_snapshot": {"beginning_balance": 100.5, "total_deposits": '), F.col("n").cast("string"),
        F.lit(', "fees": null}, "transactions": ['), F.col("rows"), F.lit("]}"),
    )
    wrapped = (
        F.when(F.col("n") % 3 == 0, body)
        .when(F.col("n") % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .otherwise(F.concat(F.lit("Here is the result: "), body, F.lit(" Done.")))
    )
    return d.select(F.concat(F.lit("doc_"), F.col("n").cast("string")).alias("statement"), wrapped.alias("text"))


PAGE_LINES = 20


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut at every twentieth line: (doc_id, page, text); whole texts."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("_l"))
    starts = F.sequence(F.lit(1), F.size("_l"), F.lit(PAGE_LINES))
    pages = F.transform(starts, lambda i: F.array_join(F.slice(F.col("_l"), i, PAGE_LINES), "\n"))
    return lines.select("doc_id", F.posexplode(pages).alias("page", "text")).withColumn("page", F.col("page") + 1)
