"""Repair, exports, chunks, retrieval, questions and the archive."""
import pytest
from pyspark.sql import functions as F

from glassledger.operators import chunks as C
from glassledger.operators import history as H
from glassledger.operators import ledger_export as X
from glassledger.operators import questions as Q
from glassledger.operators import table_repair as R
from glassledger.sources import cells as T
from glassledger.sources import tables as S
from glassledger.sources.names import safe_name, unique_names


def test_names():
    assert unique_names(["Amount ($)", "Amount", "", None, "2024 total"]) == ["Amount", "Amount_1", "col3", "col4", "t_2024_total"]
    assert safe_name("", "data") == "data"


def test_repair(spark):
    rows = [("$1,850.00", "25/12/2024", "x"), ("(25.00)", "1/2/69", "5"), ("n/a", "3/4/70", "6"), ("7", "2024-13-40", "7"), ("8", "9.9.2024", "8")]
    df = R.repair_table(spark.createDataFrame(rows, "paid string, due string, note string"))
    assert df.columns == ["paid", "due", "note", "due_iso"]
    assert [r["paid"] for r in df.collect()] == [1850.0, -25.0, None, 7.0, 8.0]
    assert [r["due_iso"] for r in df.collect()] == ["2024-12-25", "2069-02-01", "1970-04-03", "2024-13-40", "2024-09-09"]


def test_csv_scan(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Vendor,Vendor,YTD Paid\nA,NA,\"1,000.50\"\nB,x,$5\n")
    df = S.scan_table(spark, str(tmp_path / "t.csv"))
    assert df.columns == ["Vendor", "Vendor_1", "YTD_Paid"]
    assert [(r[0], r[1], r[2]) for r in df.orderBy("Vendor").collect()] == [("A", None, 1000.5), ("B", "x", 5.0)]


def test_vendor_list(spark, tmp_path):
    (tmp_path / "v.csv").write_text("Vendor Name,x\nAcme,1\n ,2\nZeta,3\n")
    assert [r["name"] for r in S.scan_vendor_list(spark, str(tmp_path / "v.csv")).orderBy("pos").collect()] == ["Acme", "Zeta"]


GL = """Date,Type,Num,Name,Memo,Account,Amount
2025-06-02,Deposit,,Brightleaf Customer,Invoice 1042,Checking,4200.0
2025-06-03,Bill Pmt,ACH,Greenleaf Nursery,Plants,Cost of Goods Sold,-1850.0
2025-06-15,Check,1022,"Greenleaf Nursery LLC",Plants,Cost of Goods Sold,-640.0
2025-06-16,Check,1025,"Greenleaf, Nursery",Plants,Cost of Goods Sold,-10.0
2025-06-21,Check,1024,Pacific Equipment Co,Skid steer,Equipment,-45000.0
""" + "".join(f"2025-06-22,Expense,,Shell Oil,Fuel,Auto,-{70 + i}.5\n" for i in range(9))


def test_export(spark, tmp_path):
    (tmp_path / "gl.csv").write_text(GL)
    df = X.clean_export(S.scan_ledger_export(spark, str(tmp_path / "gl.csv")))
    assert {r["check_num"] for r in df.collect()} == {"", "ACH", "1022", "1024", "1025"}
    assert [r["name"] for r in X.outliers(df).collect()] == ["Pacific Equipment Co"]
    assert [(r["name_1"], r["name_2"]) for r in X.duplicate_names(df).collect()] == [("Greenleaf Nursery", "Greenleaf, Nursery")]
    t = X.file_totals(df).first()
    assert (t["total_transactions"], t["start"], t["end"]) == (14, "2025-06-02", "2025-06-22")


def test_section_headers(spark):
    rows = [(0, None, "Rent", None), (1, None, None, "Bill"), (2, None, "Total Rent", None), (3, "x", "Fees", None), (4, "y", None, "Bill"), (5, "TOTAL", None, "Bill"), (6, None, "Late", None)]
    df = spark.createDataFrame(rows, "row_no long, `Unnamed: 0` string, `Unnamed: 1` string, Type string")
    got = {r["row_no"]: r["account_category"] for r in X.clean_export(df).collect()}
    assert got == {1: "Rent", 4: "Fees"}


def test_splitter(spark):
    def chunks(text, size=C.CHUNK_SIZE, overlap=C.OVERLAP):
        return spark.createDataFrame([(text,)], "t string").select(C.chunks_of(F.col("t"), size, overlap)).first()[0]

    text = "para one. " * 30 + "\n\n" + "word " * 500 + "\n\n" + "x" * 2500
    out = chunks(text)
    assert all(len(c) <= C.CHUNK_SIZE + C.OVERLAP + 1 for c in out)
    assert all(b.startswith(a[-C.OVERLAP:].strip()[:50]) for a, b in zip(out, out[1:]))
    assert [len(c) for c in chunks(text, overlap=0)] == [299, 999, 999, 499, 1000, 1000, 500]
    whole = "".join(chunks(text, overlap=0))
    assert whole.replace(" ", "").replace("\n", "") == text.replace(" ", "").replace("\n", "")
    assert chunks("") == [] and chunks(None) == [] and chunks(" \n ") == [] and chunks("short") == ["short"]
    # a part that is too long ends what was being filled, and its own parts stay apart from what follows
    assert chunks("a b\n\nc. dd ee ff gg\n\nh", 8, 0) == ["a b", "c.", "dd ee", "ff gg", "h"]
    assert chunks("ab\n\ncd\n\nef", 8, 0) == ["ab\n\ncd", "ef"]
    assert chunks("é" * 5, 2, 1) == ["éé", "é éé", "é é"]
    assert chunks("aa bb cc", 3, 2) == ["aa", "aa bb", "bb cc"]


def test_context_chunks(spark):
    page = "Northvale Bank\nJuly 2025\n\nDate Description Amount\n07/01 Acme 5.00"
    pages = spark.createDataFrame([(1, 1, page), (1, 2, ("long text. " * 300).strip()), (1, 3, "  ")], "doc_id int, page int, text string")
    got = C.context_chunks(pages).orderBy("page", "chunk_no").collect()
    assert got[0]["prefix"] == "Northvale Bank | July 2025 | Date Description Amount || Date Description Amount"
    assert got[0]["text"] == f"[{got[0]['prefix']}]\n{page}"
    assert len(got) > 3 and all(r["text"].startswith("[Northvale") for r in got) and {r["page"] for r in got} == {1, 2}


def test_page_tables(spark):
    rows = [("d", 1, 1, 0, ["Date", "Amount"]), ("d", 1, 1, 1, ["1/1/24", "5"]), ("d", 2, 2, 0, ["Date", "Amount"]), ("d", 2, 2, 1, ["1/2/24", "6"]),
            ("d", 2, 3, 0, ["Beginning Balance", "$5.00"]), ("d", 3, 4, 0, ["Date", "Description", "Amount"]), ("d", 3, 4, 1, ["1/3/24", "x", "7"])]
    cells = spark.createDataFrame(rows, "document string, page int, table_no int, row_no int, cells array<string>").withColumn("label", F.lit("July 2025"))
    out = T.page_tables(cells)
    assert {(r["table_name"], tuple(r["values"])) for r in out.collect()} == {
        ("d_transactions", ("1/1/24", "5")), ("d_transactions", ("1/2/24", "6")), ("d_summary", ("Beginning Balance", "$5.00")),
        ("d_transactions_2", ("1/3/24", "x", "7"))}
    t = T.page_table(out, "d_transactions")
    assert t.columns == ["Date", "Amount", "source_page", "source_label", "Date_iso"] and sum(r["Amount"] for r in t.collect()) == 11


@pytest.mark.parametrize("question,table,doc,want", [
    ("what is in the PDF", True, True, "rag"), ("in the table, from the document?", True, True, "sql_then_rag"),
    ("엑셀에서 합계", True, True, "sql"), ("total?", True, False, "sql"), ("total?", False, True, "rag"), ("total?", False, False, "general"),
    ("in the pdf", True, False, "sql"),
])
def test_routes(spark, question, table, doc, want):
    assert spark.range(1).select(Q.route(F.lit(question), F.lit(table), F.lit(doc)).alias("r")).first()["r"] == want


def test_no_answer(spark):
    Q.register_tables({"t": spark.range(3)})
    assert Q.ask_tables(spark, "SELECT sum(id) FROM t WHERE id > 5") is None
    assert Q.ask_tables(spark, "SELECT id FROM t WHERE id > 5") is None
    assert Q.ask_tables(spark, "SELECT count(*) AS n FROM t WHERE id > 5").first()["n"] == 0


Q3 = [("07", 8400.00, 0), ("07", 0, 3250.00), ("07", 0, 1450.00), ("07", 0, 385.20), ("07", 0, 9800.00), ("07", 6120.50, 0), ("07", 0, 2100.00),
      ("07", 0, 142.85), ("07", 0, 4200.00), ("07", 0, 875.00), ("07", 5250.00, 0), ("07", 0, 268.40), ("07", 0, 35.00), ("07", 0, 3000.00), ("07", 4.85, 0)]


def test_period_answers(spark):
    rows = spark.createDataFrame([(p, str(d), str(w)) for p, d, w in Q3], "period string, deposit string, withdrawal string")
    rows = rows.withColumns({c: F.col(c).cast("decimal(18,2)") for c in ("deposit", "withdrawal")})
    r = Q.period_answers(rows, 24800.00).first()
    assert [str(r[c]) for c in ("beginning_balance", "deposits", "withdrawals", "ending_balance")] == ["24800.00", "19775.35", "25506.45", "19068.90"]
    assert r["rows"] == 15


def test_history(spark, tmp_path):
    rows = spark.createDataFrame([("memo", "x" * 500, "2024-01-01 00:00:00"), ("gl", "short", "2024-01-02 00:00:00"), ("gl", "later", "2024-01-03 00:00:00")],
                                 "tool_name string, output_content string, created_at string")
    path = str(tmp_path / "h")
    H.append_history(rows, path)
    H.append_history(rows.where("tool_name = 'memo'"), path)
    h = H.read_history(spark, path)
    assert h.count() == 4 and len(h.where("tool_name = 'memo'").first()["output_preview"]) == 240
    assert [r["output_content"] for r in H.list_history(h, "gl").collect()] == ["later", "short"]
    assert [r["tool_name"] for r in H.list_tools(h).collect()] == ["gl", "memo"]


def test_quoted_cells_and_several_vendor_lists(spark, tmp_path):
    from glassledger.sources import tables as S

    (tmp_path / "t.csv").write_text('Name,Note\n"Bob ""Big"" Smith, LLC","line one"\nC:\\dir\\,"a,b"\n')
    rows = [tuple(r) for r in S.read_text_columns(spark, str(tmp_path / "t.csv"), ["n", "m"]).collect()]
    assert rows == [('Bob "Big" Smith, LLC', "line one"), ("C:\\dir\\", "a,b")]
    S.write_table(spark.createDataFrame(rows, "n string, m string"), str(tmp_path / "again"), "csv")
    assert sorted(tuple(r) for r in S.read_text_columns(spark, str(tmp_path / "again"), ["n", "m"]).collect()) == sorted(rows)
    (tmp_path / "lists").mkdir()
    for file, names in (("a.csv", ["Vendor Name", "Zed", "Abe"]), ("b.csv", ["Vendor Name", "Moe", "Vendor Name"])):
        (tmp_path / "lists" / file).write_text("\n".join(names) + "\n")
    got = [r.name for r in S.scan_vendor_list(spark, str(tmp_path / "lists")).orderBy("pos").collect()]
    assert got == ["Zed", "Abe", "Moe", "Vendor Name"]


def test_retrieval_only_without_an_answer(spark):
    """No row, one row of nulls, and answers of one and of several rows; nothing of the other side comes along."""
    from glassledger.operators import questions as Q

    chunks = spark.createDataFrame([(1, "near"), (2, "far")], "rank int, text string")
    ask = lambda rows, kind="a int, b string": sorted((r.source, r.rank, r.text) for r in Q.answer_or_retrieve(spark.createDataFrame(rows, kind), chunks).collect())
    found = [("documents", 1, "near"), ("documents", 2, "far")]
    assert ask([]) == found and ask([(None, None)]) == found
    assert ask([(1, None)]) == [("tables", None, "1 | ")]
    assert ask([(None, None), (None, None)]) == [("tables", None, " | ")] * 2


def test_profile_of_all_columns_in_one_pass(spark):
    from glassledger.operators.table_repair import schema_profile

    rows = [(i, f" v{i % 7} ", None, "" if i % 2 else "x", [i]) for i in range(100)]
    df = spark.createDataFrame(rows, "n int, `a b` string, none string, half string, list array<int>").repartition(9)
    got = {r.column_name: (r.position, r.column_type, r.rows, r.samples) for r in schema_profile(df, "t").collect()}
    assert got == {"n": (1, "int", 100, ["0", "1", "10"]), "a b": (2, "string", 100, ["v0", "v1", "v2"]), "none": (3, "string", 100, []),
                   "half": (4, "string", 100, ["x"]), "list": (5, "array<int>", 100, ["[0]", "[10]", "[11]"])}
    assert [(r.rows, r.samples) for r in schema_profile(df.limit(0), "t").collect()] == [(0, [])] * 5
