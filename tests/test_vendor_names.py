"""Vendor names: exclusions, noise, suffixes, matching and its exactness."""
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from glassledger.functions.similarity import common_character_bound, ratio
from glassledger.operators import cross_check as X
from glassledger.operators import vendor_names as N

CASES = [  # description, is it a vendor
    ("AMZN Mktp US*2X4YT", True), ("JOHN SMITH LLC", True), ("John Smith Consulting", True),
    ("HOMEDEPOT.COM 6547", True), ("CHECK #1847", True), ("PAYPAL *UBER EATS", True), ("Staples Inc.", True),
    ("Office Depot Corp", True), ("ATT UVERSE AUTOPAY", True), ("VERIZON WIRELESS AUTOPAY", True),
    ("PAYROLL DIRECT DEP", False), ("TRANSFER FROM SAVINGS", False), ("OPENING BALANCE", False),
    ("ENDING BALANCE", False), ("PAYMENT - THANK YOU", False), ("MOBILE DEPOSIT", False), ("INTEREST EARNED", False),
    ("ZELLE FROM JAMES", False), ("8,500.00", False), ("DIRECT DEP PAYROLL", False),
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "line_no long, description string")


def named(spark, texts, known=None):
    lst = None if known is None else spark.createDataFrame(list(enumerate(known)), "pos long, name string")
    out = N.normalise_vendors(frame(spark, texts), lst, preclean_first=False)
    return {r["description"]: r for r in out.collect()}


def test_exclusions(spark):
    got = named(spark, [t for t, _ in CASES])
    assert {t: not got[t]["norm_excluded"] for t, _ in CASES} == dict(CASES)
    assert got["8,500.00"]["norm_reason"] == "embedded_amount"
    assert got["PAYROLL DIRECT DEP"]["norm_reason"] == "deposit/transfer: PAYROLL"
    assert got["OPENING BALANCE"]["canonical_name"] == "[EXCLUDED] OPENING BALANCE"


def test_names_with_list(spark):
    got = named(spark, [t for t, _ in CASES], ["Amazon", "John Smith", "Home Depot", "Staples"])
    assert got["AMZN Mktp US*2X4YT"]["canonical_name"] == "Amzn US"  # 0.62 to AMAZON stays below the threshold
    assert got["AMZN Mktp US*2X4YT"]["match_confidence"] == 0.62
    assert got["JOHN SMITH LLC"]["canonical_name"] == "John Smith"
    assert got["JOHN SMITH LLC"]["entity_type"] == "LLC"
    assert got["John Smith Consulting"]["needs_review"]
    assert got["HOMEDEPOT.COM 6547"]["canonical_name"] == "Home Depot"
    assert got["Staples Inc."]["canonical_name"] == "Staples" and got["Staples Inc."]["entity_type"] == "INC"


def test_names_without_list(spark):
    got = named(spark, ["Office Depot Corp", "X 12", "Bank of Usa N.A.", "ACME, INC.", "4471"])
    assert got["Office Depot Corp"]["canonical_name"] == "Office Depot"
    assert got["Office Depot Corp"]["match_confidence"] == 1.0 and not got["Office Depot Corp"]["needs_review"]
    assert got["4471"]["canonical_name"] == "UNRESOLVED: 4471" and got["4471"]["needs_review"]
    assert got["Bank of Usa N.A."]["entity_type"] == "NA" and got["Bank of Usa N.A."]["canonical_name"] == "Bank Of USA"
    assert got["ACME, INC."]["canonical_name"] == "Acme"


def test_preclean(spark):
    texts = {
        "ACH Payment - Greenleaf Nursery": "Greenleaf Nursery",
        "Check 1022 - Greenleaf Nursery LLC": "Greenleaf Nursery LLC",
        "POS - Debit Card: Shell": "Shell",
        "Card Kingdom": "Card Kingdom", "Check Point Software": "Check Point Software",
        "Payment -": "Payment -", "": "",
    }
    got = frame(spark, list(texts)).select("description", N.preclean(F.col("description")).alias("p")).collect()
    assert {r["description"]: r["p"] for r in got} == texts


def test_worksheet_profile(spark):
    df = N.normalise_vendors(frame(spark, ["PAYROLL DIRECT DEP", "Chase NA"]), profile="worksheet", preclean_first=False)
    got = {r["description"]: r for r in df.collect()}
    assert not got["PAYROLL DIRECT DEP"]["norm_excluded"]
    assert got["Chase NA"]["entity_type"] is None


def test_bound_never_below_ratio():
    rng = random.Random(7)
    words = ["".join(rng.choice("ABCDE ") for _ in range(rng.randint(0, 14))) for _ in range(60)]
    bound = common_character_bound(words, words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert ratio(a, b) <= bound[i, j] + 1e-12


def test_nearest_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_NAMES", 7)  # many blocks
    rng = random.Random(3)
    make = lambda: "".join(rng.choice("ABCD") for _ in range(rng.randint(3, 8)))
    names, known = sorted({make() for _ in range(40)}), [make() for _ in range(30)]
    lst = spark.createDataFrame(list(enumerate(known)), "pos long, name string")
    got = {r["bare_name"]: (r["match"], r["score"]) for r in
           N.nearest_in_list(spark.createDataFrame([(n,) for n in names], "bare_name string"), lst).collect()}
    for n in names:
        best, score = None, 0.0
        for k in known:
            s = SequenceMatcher(None, n, k).ratio()
            if s > score:
                best, score = k, s
        assert got.get(n, (None, 0.0)) == (best, score)


def test_similar_names_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(X, "PAIR_BLOCK", 9)
    rng = random.Random(11)
    names = sorted({"".join(rng.choice("ABCDEF") for _ in range(rng.randint(1, 24))) for _ in range(70)})
    got = {(r["name_a"], r["name_b"]): r["similarity"] for r in
           X.similar_names(spark.createDataFrame([(n,) for n in names], "canonical_name string")).collect()}
    want = {(a, b): ratio(a, b) for a in names for b in names if a != b and ratio(a, b) >= 0.65}
    assert got == want
