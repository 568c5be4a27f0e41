"""Row rules, line shapes, reconciliation and transcribed documents."""
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from glassledger.operators import reconcile as A
from glassledger.operators import statement_lines as L
from glassledger.operators.classify_rows import classify_rows
from glassledger.sources import statements as J


@pytest.mark.parametrize("desc,amount,kind", [
    ("", 5, "unknown"), ("Opening Balance", 5, "balance"), ("New Balance", 5, "metadata"), ("ADP PAYROLL", 5, "payroll"),
    ("Transfer to Savings *8842", 5, "transfer"), ("Interest Credit", 5, "interest"), ("MOBILE DEPOSIT", 5, "deposit"),
    ("Monthly Fee", 5, "fee"), ("Monthly Service Fee", 25, "vendor_payment"), ("CHECK #1234", 5, "check_unverified"),
    ("CHECK #1234 250.00", 5, "check_unverified"), ("CHECK #1234 ACME LLC", 5, "check"), ("CHECK PAID TO JOHN SMITH", 5, "check"),
    ("Check 1021 - Maria Sanchez", 5, "check"), ("Acme", 5, "vendor_payment"), ("Acme", 0, "unknown"),
])
def test_row_types(spark, desc, amount, kind):
    df = spark.createDataFrame([(desc, Decimal(amount))], "description string, amount decimal(18,2)")
    r = classify_rows(df).first()
    assert r["transaction_type"] == kind
    assert r["include_for_1099"] == (kind in ("check", "vendor_payment"))
    assert (r["exclusion_reason"] == "") == r["include_for_1099"]


LINES = {
    "01/05/24 JOHN SMITH LLC 1,200.00 11,250.00": ("01/05/24", "JOHN SMITH LLC", "1200.00"),
    "01/05 Acme Co $45.10": ("01/05", "Acme Co", "45.10"),
    "2024-01-05 Acme 45.10 90.00": ("2024-01-05", "Acme", "45.10"),
    "Jan 15, 2024 Staples -12.00": ("Jan 15, 2024", "Staples", "12.00"),
    "15 Jan 2024 Staples 12.00": ("15 Jan 2024", "Staples", "12.00"),
    "01/05/2024 $88.00 OFFICE DEPOT": ("01/05/2024", "OFFICE DEPOT", "88.00"),
    "01/05/2024 Acme 0.00 100.00": ("01/05/2024", "Acme 0.00", "100.00"),
    "Beginning balance 100.00": None, "Total 5.00": None, "no amount here": None, "Page 3": None, "-----": None,
}


def test_line_shapes(spark):
    pages = spark.createDataFrame([("\n".join(LINES),)], "text string").withColumn("document", F.lit("d"))
    got = {(r["date_raw"], r["description"], str(r["amount"])) for r in L.extract_rows(L.text_lines(pages, ["document"])).collect()}
    assert got == {v for v in LINES.values() if v}


def snap(spark, **kw):
    base = {"beginning_balance": "12450.00", "total_deposits": "7952.15", "total_withdrawals": "12555.87",
            "checks": None, "transfers": None, "fees": None, "reported_ending_balance": "7846.28"} | kw
    return spark.createDataFrame([("s", *base.values())], "statement string, " + ", ".join(f"{k} string" for k in base))


def test_source_a(spark):
    r = A.reconcile(snap(spark)).first()
    assert r["available"] and r["balanced"] and r["calculated_ending"] == Decimal("7846.28")
    assert not A.reconcile(snap(spark, reported_ending_balance="7846.30")).first()["balanced"]
    r = A.reconcile(snap(spark, total_deposits=None)).first()
    assert not r["available"] and r["difference"] is None


def rows(spark, *pairs):
    return spark.createDataFrame([("s", t, Decimal(a)) for t, a in pairs], "statement string, transaction_type string, amount decimal(18,2)")


def test_source_b(spark):
    def check(s, *pairs):
        return A.extraction_check(A.reconcile(s), A.bucket_sums(rows(spark, *pairs), ["statement"]), ["statement"]).first()

    ok = check(snap(spark), ("deposit", "7950.00"), ("interest", "2.15"), ("vendor_payment", "10000.00"), ("bank_fee", "55.87"), ("transfer", "2500.00"))
    assert ok["lumped_debits"] and ok["extraction_status"] == "complete" and ok["withdrawals_row_sum"] == Decimal("12555.87")
    apart = check(snap(spark, fees="55.87", total_withdrawals="12500.00"), ("deposit", "7952.15"), ("vendor_payment", "12500.00"), ("bank_fee", "50.00"))
    assert not apart["lumped_debits"] and apart["extraction_status"] == "incomplete" and apart["fees_delta"] == Decimal("-5.87")
    assert check(snap(spark, beginning_balance=None), ("deposit", "1.00"))["extraction_status"] == "unavailable"


DOC = {"document_metadata": {"detected_type": "bank_statement", "page_count": 1},
       "transactions": [{"date": "1/2", "description": "Acme", "amount": 5.5, "transaction_type": "vendor_payment", "include_for_1099": True},
                        {"date": "1/3", "amount": 7, "transaction_type": "deposit", "include_for_1099": False}]}


@pytest.mark.parametrize("text", [json.dumps(DOC), f"```json\n{json.dumps(DOC)}\n```", f"Result: {json.dumps(DOC)} end"])
def test_documents_in_text(spark, text):
    df = spark.createDataFrame([("s", text)], "statement string, text string")
    parsed = J.parse_documents(df.select("statement", J.json_in_text(F.col("text")).alias("json")))
    assert parsed.first()["status"] == "success"
    got = J.document_rows(parsed).collect()
    assert len(got) == 1 and got[0]["amount"] == Decimal("5.50") and got[0]["confidence"] == 0.0


@pytest.mark.parametrize("text,status", [("no json", "failed_json"), (json.dumps(DOC | {"document_metadata": {"detected_type": "unknown", "page_count": 3}}), "failed_unknown_type"),
                                         (json.dumps(DOC | {"document_metadata": {"detected_type": "x", "page_count": 0}}), "failed_unknown_type")])
def test_unreadable_documents(spark, text, status):
    df = spark.createDataFrame([("s", text)], "statement string, text string")
    assert J.parse_documents(df.select("statement", J.json_in_text(F.col("text")).alias("json"))).first()["status"] == status
