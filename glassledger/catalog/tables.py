"""Table loading, repair, export and archive queries over the benchmark tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import ledger_export as X
from ..operators import questions as Q
from ..operators import table_repair as R
from ..plans.adapters import ledger_rows, table
from ..session import scratch_path
from ..sources import tables as S
from .sql import GL, q, with_

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


# --- repair ------------------------------------------------------------------------


def raw_invoices(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as an all-text upload: money text, day-first dates, some cells bad or blank."""
    k = F.col("o_orderkey")
    price = F.format_number("o_totalprice", 2)
    return table(spark, sf, "orders").select(
        k.cast("string").alias("Invoice No."),
        F.when(k % 10 == 0, "pending").when(k % 3 == 0, F.concat(F.lit("("), price, F.lit(")")))
        .when(k % 3 == 1, F.concat(F.lit("$"), price)).otherwise(price).alias("Amount ($)"),
        F.when(k % 17 == 0, "").otherwise(F.date_format("o_orderdate", "d/M/yyyy")).alias("Due Date"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Posted"),
        F.when(k % 20 != 0, F.col("o_orderpriority")).alias("Priority"),
    )


_REPAIRED = """
iv AS (SELECT CAST(o_orderkey AS DOUBLE) AS Invoice_No,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END * CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS DOUBLE) / 100 END AS Amount,
  CASE WHEN o_orderkey % 17 <> 0 THEN strftime(o_orderdate, '%-d/%-m/%Y') END AS Due_Date, strftime(o_orderdate, '%Y-%m-%d') AS Posted,
  CASE WHEN o_orderkey % 20 <> 0 THEN o_orderpriority END AS Priority,
  CASE WHEN o_orderkey % 17 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS Due_Date_iso, strftime(o_orderdate, '%Y-%m-%d') AS Posted_iso FROM orders)
"""


@query("repaired_table", with_(_REPAIRED, body="SELECT Invoice_No, Amount, coalesce(Due_Date, '') AS Due_Date, Posted, Priority, Due_Date_iso, Posted_iso FROM iv"))
def repaired_table(spark, sf):
    from ..sources.names import unique_names

    raw = raw_invoices(spark, sf)
    return R.repair_table(raw.toDF(*unique_names(raw.columns)))


@query("scanned_csv_table", with_(_REPAIRED, body="SELECT * FROM iv"))
def scanned_csv_table(spark, sf):
    """Written as CSV to the shared folder, then scanned, named and repaired."""
    path = scratch_path(spark, "invoices")
    S.write_table(raw_invoices(spark, sf), path, "csv")
    return S.scan_table(spark, path)


@query("scanned_ledger", with_(GL, body="SELECT journal_ref, account_name, vendor, description, strftime(date, '%Y-%m-%d') AS date, amount FROM gl"))
def scanned_ledger(spark, sf):
    from ..operators.ledger import clean_ledger

    path = scratch_path(spark, "ledger")
    S.write_table(ledger_rows(spark, sf).withColumn("date", F.date_format("date", "yyyy-MM-dd")), path, "csv")
    df = clean_ledger(S.scan_ledger(spark, path))
    return df.select("journal_ref", "account_name", "vendor", "description", F.date_format("date", "yyyy-MM-dd").alias("date"), "amount")


@query("scanned_vendor_list", "SELECT DISTINCT p_name AS name FROM part")
def scanned_vendor_list(spark, sf):
    path = scratch_path(spark, "vendors")
    names = table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    S.write_table(names.orderBy("k").select(F.col("p_name").alias("Vendor Name"), "k"), path, "csv")
    return S.scan_vendor_list(spark, path).select("name")


@query("written_queue", with_(GL, body="SELECT count(*) AS rows, count(DISTINCT journal_ref) AS refs, round(sum(amount), 2) AS amount FROM gl WHERE amount >= 100000"))
def written_queue(spark, sf):
    """Flagged rows written out and read back."""
    from ..operators.ledger import clean_ledger

    path = scratch_path(spark, "queue")
    flagged = F.when(F.col("amount") >= 100000, "Flagged").otherwise("Not flagged")
    S.write_queue(clean_ledger(ledger_rows(spark, sf)).withColumn("flagged_status", flagged), path, "parquet")
    back = spark.read.parquet(path)
    return back.agg(F.count("*").alias("rows"), F.count_distinct("journal_ref").alias("refs"), F.round(F.sum("amount"), 2).alias("amount"))


@query("preview_rows", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders ORDER BY orders.o_orderkey LIMIT 50")
def preview_rows(spark, sf):
    return S.preview(table(spark, sf, "orders").orderBy("o_orderkey")).select("o_orderkey", "o_orderdate", "o_orderpriority")


def _sample_sql(col: str) -> str:
    return f"(SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT CAST({col} AS VARCHAR) AS v FROM orders WHERE trim(CAST({col} AS VARCHAR)) <> '' ORDER BY v LIMIT 3))"


@query("schema_profile", " UNION ALL ".join(
    f"SELECT 'orders' AS table_name, {i} AS position, {q(c)} AS column_name, (SELECT count(*) FROM orders) AS rows, {_sample_sql(c)} AS samples"
    for i, c in enumerate(["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], 1)))
def schema_profile(spark, sf):
    p = R.schema_profile(table(spark, sf, "orders"), "orders")
    return p.select("table_name", "position", "column_name", "rows", F.array_join("samples", ", ").alias("samples"))


@query("headers_that_are_data", r"""SELECT o_orderkey, o_orderkey % 4 IN (1, 2) AS is_data FROM orders""")
def headers_that_are_data(spark, sf):
    """Would-be header rows: words, a balance, a date, words with an empty cell."""
    k = F.col("o_orderkey") % 4
    cells = (
        F.when(k == 0, F.array(F.lit("Date"), F.lit("Amount")))
        .when(k == 1, F.array(F.lit("Beginning Balance"), F.concat(F.lit("$"), F.format_number("o_totalprice", 2))))
        .when(k == 2, F.array(F.date_format("o_orderdate", "M/d/yy"), F.lit("x")))
        .otherwise(F.array(F.lit("Payee"), F.lit("")))
    )
    return table(spark, sf, "orders").select("o_orderkey", R.looks_like_data(cells).alias("is_data"))


# --- ad-hoc SQL ----------------------------------------------------------------------

_SQL = "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority"


@query("ad_hoc_sql", _SQL)
def ad_hoc_sql(spark, sf):
    Q.register_tables({"orders": table(spark, sf, "orders")})
    return Q.ask_tables(spark, _SQL)


# --- accounting exports ---------------------------------------------------------------


def export_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as an accounting-package export: section headers, totals, spacer columns."""
    li = table(spark, sf, "lineitem")
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    is_head = F.col("l_linenumber") == 1
    return li.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        (k * 1000 + F.col("l_suppkey") % 1000).alias("row_no"),
        F.when((F.col("l_linenumber") == 2) & (F.col("l_returnflag") == "R"), "TOTAL").when(F.col("l_linenumber") == 3, "x")
        .when(F.col("l_linenumber") == 4, "y").alias("Unnamed: 0"),
        F.when(is_head, F.when(F.col("l_returnflag") == "R", F.concat(F.lit("Total "), F.col("p_type"))).otherwise(F.col("p_type"))).alias("Unnamed: 1"),
        F.when(F.col("l_returnflag") == "X", "z").alias("Unnamed: 2"),
        F.when(~is_head, F.when(F.col("l_returnflag") == "A", "Check").otherwise("Bill")).alias("Type"),
        F.date_format("l_shipdate", "MM/dd/yyyy").alias("Date"),
        F.when(F.col("l_linenumber") == 5, "ACH").when(F.col("l_linenumber") == 6, F.col("l_orderkey").cast("string")).alias("Num"),
        F.when(F.col("l_linenumber") != 7, F.when(F.col("l_tax") > 0.04, F.initcap("p_name")).otherwise(F.replace("p_name", F.lit(" "), F.lit(", ")))).alias("Name"),
        F.col("l_extendedprice").cast("string").alias("Amount"),
    )


_EXPORT = """
ex0 AS (SELECT (l_orderkey * 10 + l_linenumber) * 1000 + l_suppkey % 1000 AS row_no, l_linenumber AS ln, l_returnflag AS rf, p_type, p_name, l_tax,
  l_shipdate, l_orderkey, l_extendedprice AS amount FROM lineitem JOIN part ON l_partkey = p_partkey),
ex1 AS (SELECT *, last_value(CASE WHEN ln = 1 AND rf <> 'R' THEN p_type END IGNORE NULLS) OVER (ORDER BY row_no, CASE WHEN ln = 1 AND rf <> 'R' THEN p_type END
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS account_category FROM ex0),
ex AS (SELECT row_no, CASE WHEN rf = 'A' THEN 'Check' ELSE 'Bill' END AS type, strftime(l_shipdate, '%Y-%m-%d') AS date,
  CASE WHEN ln = 5 THEN 'ACH' WHEN ln = 6 THEN CAST(l_orderkey AS VARCHAR) ELSE '' END AS check_num,
  CASE WHEN ln = 7 THEN '' WHEN l_tax > 0.04 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ')
    ELSE replace(p_name, ' ', ', ') END AS name, amount, account_category FROM ex1 WHERE ln <> 1 AND NOT (ln = 2 AND rf = 'R'))
"""


def exported(spark: SparkSession, sf: str) -> DataFrame:
    return X.clean_export(export_rows(spark, sf))


@query("export_cleaned", with_(_EXPORT, body="SELECT row_no, type, date, check_num, name, amount FROM ex"))
def export_cleaned(spark, sf):
    return exported(spark, sf).select("row_no", "type", F.date_format("date", "yyyy-MM-dd").alias("date"), "check_num", "name", "amount")


@query("section_forward_fill", """WITH o AS (SELECT o_orderkey, o_custkey % 5 AS file_no, CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority END AS head FROM orders)
  SELECT o_orderkey, file_no, last_value(head IGNORE NULLS) OVER (PARTITION BY file_no ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM o""")
def section_forward_fill(spark, sf):
    """In chunks of 500 rows, so that the carry between chunks is used."""
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("file_no"), "o_orderpriority")
    head = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderpriority"))
    return X.forward_fill(o, head, "section", ["file_no"], "o_orderkey", chunk=500).select("o_orderkey", "file_no", "section")


@query("export_totals", with_(_EXPORT, body="SELECT count(*) AS total_transactions, min(date) AS start, max(date) AS end FROM ex"))
def export_totals(spark, sf):
    return X.file_totals(exported(spark, sf))


@query("export_type_counts", with_(_EXPORT, body="SELECT type, count(*) AS rows FROM ex GROUP BY 1"))
def export_type_counts(spark, sf):
    return X.type_counts(exported(spark, sf))


@query("export_top_names", with_(_EXPORT, body="SELECT name, count(*) AS transaction_count FROM ex WHERE name <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"))
def export_top_names(spark, sf):
    return X.top_names(exported(spark, sf))


@query("ledger_account_breakdown", with_(GL, body="SELECT account_name AS account, round(sum(amount), 2) AS total_amount, count(amount) AS count FROM gl GROUP BY 1"))
def ledger_account_breakdown(spark, sf):
    df = ledger_rows(spark, sf).withColumnRenamed("account_name", "split_account")
    return X.account_breakdown(df).withColumn("total_amount", F.round("total_amount", 2))


@query("amount_outliers", """WITH o AS (SELECT o_orderkey, o_totalprice * CASE WHEN o_orderkey % 50 = 0 THEN 4 ELSE 1 END AS amount FROM orders),
  s AS (SELECT avg(amount) AS m, stddev_samp(amount) AS d FROM o)
  SELECT o_orderkey, round(amount, 2) AS amount, 'Amount ' || '$' || format('{:,.2f}', amount) || ' is more than 2.5 std deviations from mean ($' || format('{:,.2f}', m) || ')' AS reason
  FROM o, s WHERE abs(amount - m) > 2.5 * d""")
def amount_outliers(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") * F.when(F.col("o_orderkey") % 50 == 0, 4).otherwise(1)).alias("amount"))
    return X.outliers(o).withColumn("amount", F.round("amount", 2))


@query("duplicate_names", with_(_EXPORT, body="""SELECT name_1, name AS name_2 FROM (
  SELECT name, arg_min(name, (seen, name)) OVER (PARTITION BY regexp_replace(lower(name), '[ ,.]', '', 'g')) AS name_1
  FROM (SELECT name, min(row_no) AS seen FROM ex WHERE name <> '' GROUP BY 1)) WHERE name <> name_1"""))
def duplicate_names(spark, sf):
    return X.duplicate_names(exported(spark, sf)).select("name_1", "name_2")


# --- vendor-master and period questions --------------------------------------------------


def vendor_master(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    return c.select(
        F.col("c_name").alias("vendor_name"), F.when(k % 4 == 0, "Corporation").when(k % 4 == 1, "LLC").otherwise("Individual").alias("entity_type"),
        F.when(k % 3 == 0, "No").otherwise("Yes").alias("w9_on_file"), F.col("c_mktsegment").alias("category"),
        F.round(F.abs("c_acctbal") / 5, 2).alias("ytd_paid"), F.col("n_name").alias("state"),
    )


_VM = """vm AS (SELECT c_name AS vendor_name, CASE c_custkey % 4 WHEN 0 THEN 'Corporation' WHEN 1 THEN 'LLC' ELSE 'Individual' END AS entity_type,
  CASE WHEN c_custkey % 3 = 0 THEN 'No' ELSE 'Yes' END AS w9, c_mktsegment AS category, round(abs(c_acctbal) / 5, 2) AS ytd_paid, n_name AS state
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query("vendor_master_answers", with_(_VM, body="""SELECT count(*) AS vendors, round(sum(ytd_paid), 2) AS total_paid, count(*) FILTER (WHERE ytd_paid >= 600) AS over_600,
  count(*) FILTER (WHERE w9 = 'No') AS no_w9, count(*) FILTER (WHERE w9 = 'No' AND ytd_paid >= 600) AS no_w9_over_600,
  count(*) FILTER (WHERE entity_type <> 'Corporation' AND ytd_paid >= 600) AS non_corporate_over_600,
  arg_max(vendor_name, (ytd_paid, vendor_name)) AS highest_paid, max(ytd_paid) AS highest_paid_amount, count(DISTINCT category) AS categories FROM vm"""))
def vendor_master_answers(spark, sf):
    return Q.vendor_master_answers(vendor_master(spark, sf))


@query("vendors_by_state", with_(_VM, body="SELECT state, count(*) AS vendors, round(sum(ytd_paid), 2) AS total_paid FROM vm GROUP BY 1"))
def vendors_by_state(spark, sf):
    return Q.vendors_by(vendor_master(spark, sf), "state")


@query("top_categories", with_(_VM, body="SELECT category, count(*) AS vendors, round(sum(ytd_paid), 2) AS total_paid FROM vm GROUP BY 1 ORDER BY total_paid DESC, category LIMIT 5"))
def top_categories(spark, sf):
    return Q.top_categories(vendor_master(spark, sf))


def period_rows(spark: SparkSession, sf: str) -> DataFrame:
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    inflow = F.col("o_orderkey") % 5 == 0
    zero = F.lit(0).cast("decimal(18,2)")
    return table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.col("o_orderpriority").alias("description"),
        F.when(inflow, amount).otherwise(zero).alias("deposit"), F.when(~inflow, amount).otherwise(zero).alias("withdrawal"),
        "o_orderkey",
    )


_PR = """pr AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, o_orderpriority AS description, o_orderkey,
  CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END AS deposit,
  CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END AS withdrawal FROM orders)"""


@query("period_answers", with_(_PR, "pp AS (SELECT period, sum(deposit) AS d, sum(withdrawal) AS w, count(*) AS rows FROM pr GROUP BY 1)", body="""
SELECT period, CAST(24800 + coalesce(sum(d - w) OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS beginning_balance,
  CAST(d AS DOUBLE) AS deposits, CAST(w AS DOUBLE) AS withdrawals,
  CAST(24800 + sum(d - w) OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS ending_balance, rows FROM pp"""))
def period_answers(spark, sf):
    p = Q.period_answers(period_rows(spark, sf), 24800.0)
    return p.withColumns({c: F.col(c).cast("double") for c in ("beginning_balance", "deposits", "withdrawals", "ending_balance")})


@query("statement_totals", with_(_PR, body="""SELECT CAST(sum(deposit) AS DOUBLE) AS deposits, CAST(sum(withdrawal) AS DOUBLE) AS withdrawals, count(*) AS rows,
  CAST(max(withdrawal) AS DOUBLE) AS largest_withdrawal, arg_max(description, (withdrawal, description)) AS largest_withdrawal_to FROM pr"""))
def statement_totals(spark, sf):
    t = Q.statement_totals(period_rows(spark, sf))
    return t.withColumns({c: F.col(c).cast("double") for c in ("deposits", "withdrawals", "largest_withdrawal")})


@query("paid_to_payee", with_(_PR, body="SELECT CAST(sum(withdrawal) AS DOUBLE) AS paid, count(*) AS rows FROM pr WHERE contains(lower(description), 'urgent')"))
def paid_to_payee(spark, sf):
    return Q.paid_to(period_rows(spark, sf), "URGENT").withColumn("paid", F.col("paid").cast("double"))


# --- archive -------------------------------------------------------------------------


def archive(spark: SparkSession, sf: str) -> DataFrame:
    return H.archive_entries(table(spark, sf, "events").select(
        F.col("event_type").alias("tool_name"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), F.repeat("props", 40).alias("output_content")))


_EV = "SELECT event_type AS tool_name, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at, lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, substr(repeat(props, 40), 1, 240) AS output_preview FROM events"


@query("archive_entries", f"SELECT *, 'markdown' AS output_format, false AS is_sensitive FROM ({_EV})")
def archive_entries(spark, sf):
    return archive(spark, sf).select("tool_name", "created_at", "id", "output_preview", "output_format", "is_sensitive")


@query("archive_of_tool", f"SELECT * FROM ({_EV}) WHERE tool_name = 'click'")
def archive_of_tool(spark, sf):
    """Appended to a partitioned table, then listed for one tool."""
    path = scratch_path(spark, "history")
    H.append_history(archive(spark, sf), path)
    return H.list_history(H.read_history(spark, path), "click").select("tool_name", "created_at", "id", "output_preview")


@query("archive_tools", "SELECT DISTINCT event_type AS tool_name FROM events")
def archive_tools(spark, sf):
    return H.list_tools(archive(spark, sf))
