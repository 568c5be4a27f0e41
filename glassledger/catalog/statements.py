"""Statement reading and reconciliation queries over the benchmark tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reconcile as A
from ..operators import statement_lines as L
from ..plans.adapters import (LINES_PER_PAGE, snapshots, statement_cells, statement_json, statement_pages, statement_rows,
                              tax_form_texts, typed_rows)
from ..rules import statements as S
from ..sources import cells as T
from ..sources import statements as J
from .sql import TXN, q, with_

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def doubles(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


# --- lines ------------------------------------------------------------------------

_FMT = "format('{:,.2f}', CAST(amount AS DOUBLE))"
_LINE = f"date_raw || ' ' || description || ' ' || {_FMT} || CASE WHEN line_no % 3 = 0 THEN ' ' || format('{{:,.2f}}', CAST(amount + 5000 AS DOUBLE)) ELSE '' END"
_DOC = f"'doc_' || CAST(line_no // {LINES_PER_PAGE} AS VARCHAR)"
_TAX = f"(line_no // {LINES_PER_PAGE}) % 5 = 0"


@query("statement_text_lines", with_(TXN, body=f"""
SELECT {_DOC} AS document, {_LINE} AS line FROM tx
UNION ALL SELECT DISTINCT {_DOC}, unnest(['Form 1099-NEC', 'Nonemployee compensation $ 1,500.00']) FROM tx WHERE {_TAX}"""))
def statement_text_lines(spark, sf):
    return L.text_lines(statement_pages(spark, sf), ["document"]).select("document", "line")


@query("skipped_lines", with_(TXN, body=f"SELECT DISTINCT {_DOC} AS document, unnest(['Date Description Amount', 'Total for page', 'Page 1']) AS line FROM tx"))
def skipped_lines(spark, sf):
    lines = L.text_lines(statement_pages(spark, sf), ["document"], skip=False)
    return lines.where(L.skip_line(F.col("line"))).select("document", "line")


def line_rows(spark: SparkSession, sf: str) -> DataFrame:
    return L.extract_rows(L.text_lines(statement_pages(spark, sf), ["document"]))


@query("rows_from_lines", with_(TXN, body=f"SELECT {_DOC} AS document, date_raw, description, CAST(amount AS DOUBLE) AS amount, 'bank' AS source FROM tx WHERE amount <> 0"))
def rows_from_lines(spark, sf):
    return doubles(line_rows(spark, sf).drop("line_no"), "amount")


@query("worksheet_rows_from_lines", with_(TXN, body=f"""
SELECT {_DOC} AS document, date_raw, CASE WHEN line_no % 3 = 0 THEN description || ' ' || {_FMT} ELSE description END AS description,
  CAST(CASE WHEN line_no % 3 = 0 THEN amount + 5000 ELSE amount END AS DOUBLE) AS amount FROM tx"""))
def worksheet_rows_from_lines(spark, sf):
    """The worksheet's three shapes take a running balance for the amount."""
    lines = L.text_lines(statement_pages(spark, sf), ["document"], skip=False)
    return doubles(L.extract_rows(lines, profile="worksheet").drop("line_no", "source"), "amount")


@query("deposit_like_rows", with_(TXN, body="SELECT line_no, " + " OR ".join(f"contains(lower(description), {q(w)})" for w in S.DEPOSIT_LIKE) + " AS deposit_like FROM tx"))
def deposit_like_rows(spark, sf):
    return statement_rows(spark, sf).select("line_no", L.looks_like_deposit(F.col("description")).alias("deposit_like"))


@query("parsed_amounts", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN -1 WHEN 2 THEN 1 END * CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS DOUBLE) / 100 AS amount FROM orders""")
def parsed_amounts(spark, sf):
    """``1,200.00``, ``(1,200.00)``, ``$1,200.00`` and ``1,200.00 CR``."""
    from ..functions.text import parse_amount
    from ..plans.adapters import table

    s = F.format_number("o_totalprice", 2)
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, s).when(k == 1, F.concat(F.lit("("), s, F.lit(")"))).when(k == 2, F.concat(F.lit(" $"), s)).otherwise(F.concat(s, F.lit(" CR")))
    return table(spark, sf, "orders").select("o_orderkey", parse_amount(raw).cast("double").alias("amount"))


# --- tax forms ----------------------------------------------------------------------

_TAXTEXT = """
tf AS (SELECT c_custkey AS document, format('{:,.2f}', abs(c_acctbal)) AS f, c_custkey % 8 AS k FROM customer),
tt AS (SELECT document, CASE k WHEN 0 THEN 'Form 1099-NEC' || chr(10) || 'Nonemployee compensation $ ' || f
  WHEN 1 THEN 'Form 1099-MISC' || chr(10) || 'Rents $ ' || f || chr(10) || 'Other income: ' || f
  WHEN 2 THEN 'Form 1099-INT' || chr(10) || 'Interest income ' || f WHEN 3 THEN 'Form W-2' || chr(10) || 'Wages, tips: ' || f
  WHEN 4 THEN 'Schedule C' || chr(10) || 'Gross receipts $' || f WHEN 5 THEN 'Schedule E' || chr(10) || 'Line 1 ' || f
  WHEN 6 THEN 'Credit card ending 1234' || chr(10) || 'New charges ' || f ELSE 'Checking account' || chr(10) || 'Deposits ' || f END AS text FROM tf)
"""
_TYPE_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), {q(w)})" for w in words) + f" THEN {q(k)}" for k, words in S.DOCUMENT_TYPES) + " ELSE 'bank' END"


@query("document_types", with_(_TAXTEXT, body=f"SELECT document, {_TYPE_SQL} AS document_type FROM tt"))
def document_types(spark, sf):
    return tax_form_texts(spark, sf).select("document", L.document_type(F.col("text")).alias("document_type"))


_BOX_UNION = " UNION ALL ".join(
    f"SELECT document, {q(kind)} AS source, '[{L.title(box.replace('_', ' '))}] ' AS lab, "
    f"unnest(regexp_extract_all(text, {q('(?i)' + S.TAX_BOXES[box])}, 0)) AS whole, unnest(regexp_extract_all(text, {q('(?i)' + S.TAX_BOXES[box])}, 1)) AS fig FROM td WHERE document_type = {q(kind)}"
    for kind, boxes in S.TAX_BOXES_OF.items() for box in boxes)


@query("tax_form_amounts", with_(_TAXTEXT, f"td AS (SELECT *, {_TYPE_SQL} AS document_type FROM tt)", f"tb AS ({_BOX_UNION})", body="""
SELECT document, source, '' AS date_raw, lab || trim(substr(whole, 1, 60)) AS description, TRY_CAST(replace(fig, ',', '') AS DOUBLE) AS amount
FROM tb WHERE TRY_CAST(replace(fig, ',', '') AS DOUBLE) > 0"""))
def tax_form_amounts(spark, sf):
    docs = tax_form_texts(spark, sf).withColumn("document_type", L.document_type(F.col("text")))
    return doubles(L.tax_form_amounts(docs, ["document"]).drop("line_no"), "amount")


# --- tables of cells ----------------------------------------------------------------

_INCOME = "regexp_matches(description, '^(PAYROLL|INTEREST|OPENING|MONTHLY)')"


@query("rows_from_cells", with_(TXN, body=f"""SELECT {_DOC} AS document, date_raw, description, CAST(amount AS DOUBLE) AS amount FROM tx
  WHERE amount <> 0 AND NOT (description LIKE 'PAYROLL%' OR description LIKE 'INTEREST%' OR description LIKE 'OPENING%' OR description LIKE 'Debit%')"""))
def rows_from_cells(spark, sf):
    return doubles(L.rows_from_cells(statement_cells(spark, sf), ["document"]).select("document", "date_raw", "description", "amount"), "amount")


@query("concatenated_tables", with_(TXN, body=f"""
SELECT CASE WHEN odd THEN date_raw END AS "Date", CASE WHEN odd THEN description END AS "Description",
  CASE WHEN odd THEN CASE WHEN inc THEN '' ELSE f END END AS "Withdrawal", CASE WHEN odd THEN CASE WHEN inc THEN f ELSE '' END END AS "Deposit",
  CASE WHEN NOT odd THEN description END AS "Payee", CASE WHEN NOT odd THEN date_raw END AS "Post Date",
  CASE WHEN NOT odd THEN CASE WHEN inc THEN '' ELSE f END END AS "Debit", CASE WHEN NOT odd THEN CASE WHEN inc THEN f ELSE '' END END AS "Credit"
FROM (SELECT *, (line_no // {LINES_PER_PAGE}) % 2 = 1 AS odd, {_INCOME} AS inc, {_FMT} AS f FROM tx)"""))
def concatenated_tables(spark, sf):
    return T.concat_tables(statement_cells(spark, sf), statement_pages(spark, sf))


@query("page_tables", with_(TXN, body=f"""
SELECT {_DOC} || CASE WHEN (line_no // {LINES_PER_PAGE}) % 2 = 1 THEN '_transactions' ELSE '_t1' END AS table_name,
  CASE WHEN (line_no // {LINES_PER_PAGE}) % 2 = 1 THEN 'Date, Description, Withdrawal, Deposit' ELSE 'Payee, Post_Date, Debit, Credit' END AS columns,
  CASE WHEN (line_no // {LINES_PER_PAGE}) % 2 = 1 THEN date_raw ELSE description END AS first_value, 1 AS source_page FROM tx"""))
def page_tables(spark, sf):
    cells = statement_cells(spark, sf).withColumn("label", F.lit(None).cast("string"))
    rows = T.page_tables(cells)
    return rows.select("table_name", F.array_join("columns", ", ").alias("columns"), F.col("values")[0].alias("first_value"), "source_page")


@query("extraction_tiers", with_(TXN, body=f"""
SELECT document, CASE WHEN d % 5 = 0 THEN '1099_nec' ELSE 'bank' END AS document_type,
  CASE WHEN d % 5 = 0 THEN 'irs_form' WHEN d % 3 = 0 AND t >= n THEN 'table' ELSE 'regex' END AS extraction_method,
  CASE WHEN d % 5 = 0 THEN 0.85 WHEN n >= 20 THEN 0.9 WHEN n >= 10 THEN 0.75 WHEN n >= 3 THEN 0.5 ELSE 0.2 END::DOUBLE AS confidence
FROM (SELECT {_DOC} AS document, line_no // {LINES_PER_PAGE} AS d, count(*) FILTER (WHERE amount <> 0) AS n,
  count(*) FILTER (WHERE amount <> 0 AND NOT (description LIKE 'PAYROLL%' OR description LIKE 'INTEREST%' OR description LIKE 'OPENING%' OR description LIKE 'Debit%')) AS t FROM tx GROUP BY 1, 2)"""))
def extraction_tiers(spark, sf):
    return chosen(spark, sf)[0].select("document", "document_type", "extraction_method", "confidence")


def chosen(spark: SparkSession, sf: str):
    docs = statement_pages(spark, sf).withColumn("document_type", L.document_type(F.col("text")))
    tax = L.tax_form_amounts(docs, ["document"])
    # documents whose number divides by three came with their tables; the others are text alone
    tabled = statement_cells(spark, sf).where(F.regexp_extract("document", r"\d+$", 0).cast("long") % 3 == 0)
    table = L.rows_from_cells(tabled, ["document"])
    lines = line_rows(spark, sf)
    return L.choose_tier(docs.select("document", "document_type"), "document", tax, table, lines), tax, table, lines


@query("rows_of_chosen_tier", with_(TXN, f"""ch AS (SELECT *, {_DOC} AS document, line_no // {LINES_PER_PAGE} AS d,
    NOT (description LIKE 'PAYROLL%' OR description LIKE 'INTEREST%' OR description LIKE 'OPENING%' OR description LIKE 'Debit%') AS tb FROM tx WHERE amount <> 0)""",
    "us AS (SELECT document, d, count(*) AS n, count(*) FILTER (WHERE tb) AS t FROM ch GROUP BY 1, 2)", body="""
SELECT document, date_raw, description, CAST(amount AS DOUBLE) AS amount, CASE WHEN us.d % 3 = 0 AND t >= n THEN 'table' ELSE 'regex' END AS extraction_method
  FROM ch JOIN us USING (document) WHERE us.d % 5 <> 0 AND (tb OR NOT (us.d % 3 = 0 AND t >= n))
UNION ALL SELECT document, '', '[1099 Nec] Nonemployee compensation $ 1,500.00', 1500.0::DOUBLE, 'irs_form' FROM us WHERE d % 5 = 0"""))
def rows_of_chosen_tier(spark, sf):
    choice, tax, table, lines = chosen(spark, sf)
    rows = L.rows_of_chosen_tier(choice, "document", tax, table, lines)
    return doubles(rows.drop("line_no", "source"), "amount")


# --- transcribed documents -----------------------------------------------------------

_TYPED = """
ty AS (SELECT 'cust_' || CAST(o_custkey AS VARCHAR) AS statement, o_custkey AS cust, o_orderkey AS line_no, strftime(o_orderdate, '%m/%d/%Y') AS date_raw,
  (['deposit', 'interest', 'reimbursement', 'vendor_payment', 'check_payment', 'transfer', 'owner_draw', 'bank_fee', 'unknown'])[CAST(o_orderkey % 9 + 1 AS INTEGER)] AS transaction_type,
  CAST(CAST(CAST(round(o_totalprice * 100) AS BIGINT) // 1000 AS DECIMAL(18,2)) / 100 AS DECIMAL(18,2)) AS amount FROM orders)
"""


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return J.parse_documents(statement_json(spark, sf).select("statement", J.json_in_text(F.col("text")).alias("json")))


@query("document_status", with_(_TYPED, body="""SELECT DISTINCT 'doc_' || CAST(line_no // 50 AS VARCHAR) AS statement,
  CASE WHEN (line_no // 50) % 7 = 0 THEN 'failed_unknown_type' ELSE 'success' END AS status,
  CASE WHEN (line_no // 50) % 7 = 0 THEN 'Could not interpret document (detected_type=''unknown'', page_count=2)' END AS error_message FROM ty"""))
def document_status(spark, sf):
    return documents(spark, sf).select("statement", "status", "error_message")


@query("document_rows", with_(_TYPED, body="""SELECT 'doc_' || CAST(line_no // 50 AS VARCHAR) AS statement, date_raw, 'Order ' || CAST(line_no AS VARCHAR) AS description,
  CAST(amount AS DOUBLE) AS amount, transaction_type, line_no % 2 = 0 AS include_for_1099, '' AS exclusion_reason, false AS review_required,
  0.9::DOUBLE AS confidence, 0 AS source_page FROM ty WHERE (line_no // 50) % 7 <> 0 AND line_no % 6 <> 0"""))
def document_rows(spark, sf):
    return doubles(J.document_rows(documents(spark, sf)).drop("line_no", "review_reason", "source_text"), "amount")


@query("document_snapshots", with_(_TYPED, body="""SELECT DISTINCT 'doc_' || CAST(line_no // 50 AS VARCHAR) AS statement, '100.5' AS beginning_balance,
  CAST(line_no // 50 AS VARCHAR) AS total_deposits, CAST(NULL AS VARCHAR) AS fees FROM ty WHERE (line_no // 50) % 7 <> 0"""))
def document_snapshots(spark, sf):
    return J.document_snapshots(documents(spark, sf)).select("statement", "beginning_balance", "total_deposits", "fees")


# --- reconciliation -------------------------------------------------------------------

_SNAP = _TYPED.strip() + """,
sm AS (SELECT statement, cust, coalesce(sum(amount) FILTER (WHERE transaction_type IN ('deposit', 'interest', 'reimbursement')), 0) AS dep,
  coalesce(sum(amount) FILTER (WHERE transaction_type = 'vendor_payment'), 0) AS wd, coalesce(sum(amount) FILTER (WHERE transaction_type = 'check_payment'), 0) AS ck,
  coalesce(sum(amount) FILTER (WHERE transaction_type IN ('transfer', 'owner_draw')), 0) AS tr, coalesce(sum(amount) FILTER (WHERE transaction_type = 'bank_fee'), 0) AS fee
  FROM ty GROUP BY 1, 2),
sn AS (SELECT *, cust % 3 = 0 AS lump, wd + ck + tr + fee AS debits, dep + CASE WHEN cust % 4 = 0 THEN 1 ELSE 0 END AS sdep, cust % 11 <> 0 AS available FROM sm),
sx AS (SELECT *, CASE WHEN lump THEN debits ELSE wd END AS swd,
  CASE WHEN available THEN sdep - dep END AS difference FROM sn),
lp AS (SELECT *, available AND (lump OR (ck <= 0.01 AND tr <= 0.01 AND fee <= 0.01)) AS lumped FROM sx)
"""


@query("statement_reconciliation", "WITH " + _SNAP + """
SELECT statement, available, CAST(CASE WHEN available THEN 1000 + sdep - debits END AS DOUBLE) AS calculated_ending, CAST(difference AS DOUBLE) AS difference,
  CASE WHEN NOT available THEN 'unavailable' WHEN abs(difference) <= 0.01 THEN 'balanced' ELSE 'needs_review' END AS reconciliation_status FROM sx""")
def statement_reconciliation(spark, sf):
    r = A.reconcile(snapshots(spark, sf))
    status = A.reconciliation_status(F.col("available"), F.col("balanced")).alias("reconciliation_status")
    return r.select("statement", "available", F.col("calculated_ending").cast("double"), F.col("difference").cast("double"), status)


@query("bucket_sums", "WITH " + _SNAP + """SELECT statement, CAST(dep AS DOUBLE) AS deposits_row_sum, CAST(wd AS DOUBLE) AS withdrawals_row_sum,
  CAST(ck AS DOUBLE) AS checks_row_sum, CAST(tr AS DOUBLE) AS transfers_row_sum, CAST(fee AS DOUBLE) AS fees_row_sum FROM sm""")
def bucket_sums(spark, sf):
    return doubles(A.bucket_sums(typed_rows(spark, sf), ["statement"]), *[f"{b}_row_sum" for b in S.BUCKET_NAMES])


def checked(spark: SparkSession, sf: str) -> DataFrame:
    sums = A.bucket_sums(typed_rows(spark, sf), ["statement"])
    c = A.extraction_check(A.reconcile(snapshots(spark, sf)), sums, ["statement"])
    return c.withColumn("reconciliation_status", A.reconciliation_status(F.col("available"), F.col("balanced")))


_CHECK = """ck2 AS (SELECT *, CASE WHEN available THEN dep - sdep END AS dd, CASE WHEN lumped THEN debits - swd WHEN available THEN wd - swd END AS wdelta,
  CASE WHEN NOT available THEN 'unavailable' WHEN abs(dep - sdep) > 0.01 OR abs(CASE WHEN lumped THEN debits - swd ELSE wd - swd END) > 0.01
    OR (NOT lumped AND lump AND (ck > 0.01 OR tr > 0.01 OR fee > 0.01)) THEN 'incomplete' ELSE 'complete' END AS extraction_status FROM lp)"""


@query("extraction_completeness", "WITH " + _SNAP + "," + _CHECK + """
SELECT statement, extraction_status, lumped AS lumped_debits, CAST(dd AS DOUBLE) AS deposits_delta, CAST(wdelta AS DOUBLE) AS withdrawals_delta,
  CAST(CASE WHEN lumped THEN debits ELSE wd END AS DOUBLE) AS withdrawals_row_sum, CAST(CASE WHEN available AND NOT lumped THEN ck END AS DOUBLE) AS checks_stated FROM ck2""")
def extraction_completeness(spark, sf):
    c = checked(spark, sf).select("statement", "extraction_status", "lumped_debits", "deposits_delta", "withdrawals_delta", "withdrawals_row_sum", "checks_stated")
    return doubles(c, "deposits_delta", "withdrawals_delta", "withdrawals_row_sum", "checks_stated")


@query("reconciliation_tally", "WITH " + _SNAP + "," + _CHECK + """
SELECT count(*) AS statements, count(*) FILTER (WHERE available AND abs(difference) <= 0.01) AS balanced, count(*) FILTER (WHERE available AND abs(difference) > 0.01) AS needs_review,
  count(*) FILTER (WHERE NOT available) AS unavailable, count(*) FILTER (WHERE extraction_status = 'complete') AS complete,
  count(*) FILTER (WHERE extraction_status = 'incomplete') AS incomplete, count(*) FILTER (WHERE extraction_status = 'unavailable') AS not_assessed FROM ck2""")
def reconciliation_tally(spark, sf):
    return A.status_tally(checked(spark, sf))
