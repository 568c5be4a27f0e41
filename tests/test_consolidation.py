"""Rollup, eligibility, flags and cross-statement findings on small known cases."""
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from glassledger.operators import cross_check as X
from glassledger.operators import review_flags as flags
from glassledger.operators import vendor_rollup as V
from glassledger.operators.classify_rows import classify_rows, fill_defaults
from glassledger.plans.consolidation import consolidate, normalised_rows

FORMS = [
    ("John Smith", None, 3950.00, 0.82, "REVIEW"), ("Mary Johnson Consulting", "LLC", 3950.00, 1.0, "1099-NEC"),
    ("David Lee Contractor", None, 3350.00, 1.0, "REVIEW"), ("Robert Kim", "LLC", 1850.00, 1.0, "1099-NEC"),
    ("Comcast Business", None, 499.98, 1.0, "EXEMPT"), ("PG&E Electric", None, 900.54, 1.0, "EXEMPT"),
    ("Amazon", None, 475.25, 0.80, "EXEMPT"), ("Home Depot", None, 735.04, 0.95, "EXEMPT"),
    ("Staples", "INC", 392.14, 1.0, "EXEMPT"), ("Office Depot", "CORP", 78.22, 1.0, "EXEMPT"),
    ("Smith & Jones Law LLP", "LLP", 8500.00, 1.0, "1099-NEC"), ("City Medical Center", "INC", 12000.0, 1.0, "1099-MISC"),
    ("Check", None, 375.00, 1.0, "EXEMPT"), ("Verizon Wireless", None, 378.00, 1.0, "EXEMPT"),
    ("Amzn US", None, 415.70, 1.0, "EXEMPT"), ("City of Portland", None, 900.0, 1.0, "EXEMPT"),
    ("Chase Bank", "NA", 900.0, 1.0, "EXEMPT"), ("Adobe", "INC", 900.0, 1.0, "EXEMPT"), ("Adobe", "LLC", 900.0, 1.0, "1099-NEC"),
    ("Acme Widgets", "CORP", 900.0, 1.0, "EXEMPT"), ("Kelly Services", "LLC", 900.0, 1.0, "1099-NEC"),
]
SUMMARY = "canonical_name string, entity_type string, total_amount decimal(18,2), match_confidence double"


def test_eligibility(spark):
    df = spark.createDataFrame([(i, n, e, Decimal(str(t)), c) for i, (n, e, t, c, _) in enumerate(FORMS)], "i int, " + SUMMARY)
    got = V.classify_1099(df).orderBy("i").collect()
    assert [r["form_type"] for r in got] == [f[4] for f in FORMS]
    assert got[4]["exemption_reason"] == "Total $499.98 below $600 threshold"
    assert "IRS §6045(f)" in got[10]["exception_reason"]
    assert got[0]["notes"].startswith("Likely requires 1099-NEC for $3,950.00 but needs human review: entity type unknown")


@pytest.mark.parametrize("name,entity,total,conf,reasons", [
    ("John Smith", None, 3950.00, 0.82, 1), ("Mary", "LLC", 3950.00, 1.0, 0), ("PG&E", None, 650.00, 1.0, 2),
    ("Adobe Systems", "INC", 599.88, 1.0, 1), ("Stripe", None, 720.00, 0.65, 2), ("Comcast", None, 499.98, 1.0, 0),
    ("Verizon", None, 810.00, 1.0, 1),
])
def test_review_reasons(spark, name, entity, total, conf, reasons):
    df = spark.createDataFrame([("s", name, entity, Decimal(str(total)), conf, False, [])],
                               "statement string, " + SUMMARY + ", needs_review boolean, review_reasons array<string>")
    assert flags.statement_reasons(df).count() == reasons


TXN = "statement string, line_no long, date_raw string, description string, amount decimal(18,2)"
SMITHS = [
    ("a", 1, "01/15/2024", "JOHN SMITH LLC", Decimal("1200.00")), ("a", 2, "03/22/2024", "John Smith Consulting", Decimal("800.00")),
    ("a", 3, "06/10/2024", "J Smith LLC", Decimal("500.00")), ("a", 4, "02/03/2024", "AMZN Mktp US*2X4YT", Decimal("45.99")),
    ("a", 5, "05/17/2024", "Amazon.com", Decimal("127.50")), ("a", 6, "08/29/2024", "HOMEDEPOT.COM 6547", Decimal("234.88")),
    ("a", 7, "09/04/2024", "Home Depot #4411", Decimal("189.22")),
]


def test_rollup_with_known_vendors(spark):
    known = spark.createDataFrame([(0, "John Smith"), (1, "Amazon"), (2, "Home Depot")], "pos long, name string")
    rows = fill_defaults(spark.createDataFrame(SMITHS, TXN))
    one = {r["canonical_name"]: r for r in V.roll_up_vendors(normalised_rows(rows, known)).collect()}
    two = {r["canonical_name"]: r for r in V.roll_up_descriptions(rows, vendor_list=known).collect()}
    assert one == two
    assert one["John Smith"]["total_amount"] == Decimal("1700.00")  # "J SMITH" reaches 0.82
    assert one["John Smith"]["entity_type"] == "LLC" and one["John Smith"]["variant_count"] == 2
    assert one["Home Depot"]["total_amount"] == Decimal("424.10")
    assert one["John Smith"]["needs_review"]


def vendors(spark, rows):
    df = spark.createDataFrame(
        [(s, n, e, Decimal(str(t)), c, i) for i, (s, n, e, t, c) in enumerate(rows)],
        "statement string, canonical_name string, entity_type string, total_amount decimal(18,2), transaction_count long, line_no long")
    df = df.withColumns({"statement_key": F.col("statement"), "first_seen": F.struct("statement", "line_no")})
    return X.rank_vendors(df)


TWO = [
    ("boa", "Comcast Business", None, 104108.94, 2), ("boa", "John Smith LLC", "LLC", 400.00, 1),
    ("boa", "Mary Johnson Consulting", "LLC", 3500.00, 4), ("boa", "Adobe", None, 580.00, 1),
    ("sample", "Comcast Business", None, 499.98, 2), ("sample", "J Smith", None, 250.00, 1), ("sample", "Mary Johnson", None, 1000.00, 2),
]


def test_cross_statement_findings(spark):
    v = vendors(spark, TWO)
    m = X.cross_matches(v)
    assert [(r["canonical_name"], r["combined_total"]) for r in m.collect()] == [("Comcast Business", Decimal("104608.92"))]
    mm = X.amount_mismatches(v).collect()
    assert len(mm) == 1 and mm[0]["statement_a"] == "boa" and round(mm[0]["ratio"], 1) == 208.2
    near = X.near_threshold_vendors(v, m).collect()
    assert [(r["canonical_name"], r["distance_to_threshold"]) for r in near] == [("Adobe", Decimal("20.00"))]
    got = {(r["name_a"], r["name_b"]) for r in X.name_variants(v, X.similar_names(v)).collect()}
    assert got == {("J Smith", "John Smith LLC"), ("Mary Johnson", "Mary Johnson Consulting")}


def test_combined_only_crossing(spark):
    v = vendors(spark, [("a", "Acme", None, 350.0, 1), ("b", "Acme", None, 300.0, 1), ("a", "Zeta", None, 10.0, 1)])
    m = X.cross_matches(v)
    assert [r["crosses_threshold_combined_only"] for r in m.collect()] == [True]
    assert {r["statement"] for r in X.crossing_reasons(v, m).collect()} == {"a", "b"}


def test_one_statement_gives_no_findings(spark):
    assert X.enough_statements(vendors(spark, [("a", "Acme", None, 550.0, 1)])).count() == 0


def test_mismatches_of_a_hot_vendor_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(X, "PART_ROWS", 3)
    amounts = [round(0.5 * 1.37 ** k, 2) for k in range(34)]
    v = vendors(spark, [(f"s{i:02d}", "Hot", None, a, 1) for i, a in enumerate(amounts)])
    got = {(r["statement_a"], r["statement_b"]) for r in X.amount_mismatches(v).collect()}
    want = {(f"s{i:02d}", f"s{j:02d}") for i, a in enumerate(amounts) for j, b in enumerate(amounts)
            if i < j and max(a, b) / min(a, b) > 5 and abs(a - b) > 500}
    assert got == want and want


JUNE = [
    ("06/02", "Customer Deposit - Invoice 1042", 4200.00), ("06/03", "ACH Payment - Greenleaf Nursery", 1850.00),
    ("06/07", "Check 1021 - Maria Sanchez", 900.00), ("06/10", "Debit Card - Home Depot", 412.37),
    ("06/15", "Check 1022 - Greenleaf Nursery LLC", 640.00), ("06/22", "Debit Card - Shell Oil", 78.50),
    ("06/28", "Check 1023 - City of Portland", 150.00),
]


def test_spellings_merge_across_descriptors(spark):
    rows = classify_rows(spark.createDataFrame([("june", i, d, t, Decimal(str(a))) for i, (d, t, a) in enumerate(JUNE[1:])], TXN))
    got = {r["canonical_name"]: r["total_amount"] for r in consolidate(rows, with_variants=False).pooled.collect()}
    assert got == {"Greenleaf Nursery": Decimal("2490.00"), "Maria Sanchez": Decimal("900.00"), "Home Depot": Decimal("412.37"),
                   "Shell Oil": Decimal("78.50"), "City Of Portland": Decimal("150.00")}
    assert sum(got.values()) == Decimal("4030.87")
    assert sum(v >= 600 for v in got.values()) == 2


def test_rows_are_written_once(spark):
    """The rollups read the written rows; a column without a type comes back as it was."""
    rows = classify_rows(spark.createDataFrame([("june", i, d, t, Decimal(str(a))) for i, (d, t, a) in enumerate(JUNE[1:])], TXN)).withColumn("memo", F.lit(None))
    statements = rows.select("statement").distinct().select("statement", F.lit("success").alias("status"), F.lit(0.9).alias("confidence"), F.lit("").alias("error_message"))
    for c in (consolidate(rows, with_variants=False), consolidate(rows, with_variants=False, statements=statements)):
        assert c.rows.inputFiles() and c.pooled.inputFiles()
        assert c.rows.schema["memo"].dataType.typeName() == "void" and c.rows.count() == rows.count()
        c.close()
    rollup = V.roll_up_descriptions(fill_defaults(rows), ["statement"], spark.createDataFrame([(1, "Greenleaf Nursery")], "pos long, name string"))
    assert rollup.inputFiles() and rollup.where("canonical_name = 'Greenleaf Nursery'").count() == 1
