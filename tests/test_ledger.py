"""Ledger signals, scoring, forest invariants and exact quantiles."""
import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glassledger.operators import forest, integrity, ledger
from glassledger.plans import joins
from glassledger.plans.ledger_review import review_ledger
from glassledger.plans.quantiles import interpolated_quantiles

SCHEMA = "date string, amount double, account_name string, vendor string, description string, journal_ref string"


def planted(seed=42):
    """430 plain rows, then the planted ones; the last four carry several signals each."""
    rng, rows = random.Random(seed), []
    for _ in range(430):
        day = datetime.date(2024, 1, 1) + datetime.timedelta(days=rng.randrange(0, 360))
        while day.weekday() >= 5:
            day += datetime.timedelta(days=1)
        rows.append([day.isoformat(), round(rng.gauss(900, 250), 2) + 0.01, rng.choice(["Rent", "Fees"]), rng.choice("ABCDE"), "ok"])
    rows += [["2024-03-05", 1000.0, "Rent", "A", "round"]] * 8
    rows += [["2024-03-09", 4850.0, "Equipment", "Apex", ""], ["2024-03-09", 9850.0, "Equipment", "Wexler", ""],
             ["2024-03-09", 24850.0, "Equipment", "Orion", None], ["2024-03-10", 4790.30, "Fees", "Crestline", "nan"]]
    return [(*r, f"JE{i}") for i, r in enumerate(rows)]


@pytest.fixture(scope="module")
def gl(spark):
    return spark.createDataFrame(planted(), SCHEMA)


def test_materiality():
    m = ledger.materiality_values("Private company", 150000.0)
    assert (m["fs_materiality"], m["performance_materiality"], m["transaction_materiality"]) == (6000.0, 3000.0, 4800.0)
    assert ledger.materiality_values("Public company", 100.0)["fs_pct"] == 0.05


def test_signals(gl):
    s = {r["journal_ref"]: r for r in ledger.add_signals(ledger.clean_ledger(gl)).collect()}
    assert sum(r["is_round_number"] for r in s.values()) == 8
    last = [s[f"JE{i}"] for i in range(438, 442)]
    assert all(r["is_near_approval_threshold"] and r["is_new_vendor"] and r["is_weekend_posting"] and r["missing_description"] for r in last)
    assert all(r["fraud_flag_count"] == 4 and r["control_gap_score"] == 2 for r in last)


def test_null_account_and_vendor(spark):
    rows = [("2024-01-02", 1.0, None, None, "x", "1"), ("bad", None, "A", None, "x", "2"), ("2024-01-02", 5.0, "A", None, "x", "3")]
    s = {r["journal_ref"]: r for r in ledger.add_signals(ledger.clean_ledger(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert s["1"]["amount_zscore_by_account"] is None and s["1"]["vendor_txn_count"] == 3
    assert s["2"]["date"] is None and s["2"]["is_round_number"] == 0


@pytest.mark.parametrize("raw,amount,flags,final,override", [
    ("High", 5000.0, 0, "High", 0), ("High", 3500.0, 0, "Medium", 0), ("High", 10.0, 0, "Monitor", 0),
    ("Low", 10.0, 2, "Medium", 1), ("Medium", 4790.3, 3, "High", 1), ("High", 5000.0, 2, "High", 0), ("Low", 4900.0, 2, "Medium", 1),
])
def test_cascade_and_override(spark, raw, amount, flags, final, override):
    cols = {c: F.lit(0) for c in ledger.R.FLAG_LABELS}
    df = spark.range(1).select(F.lit(raw).alias("raw_tier"), F.lit(amount).alias("abs_amount"), F.lit(0.0).alias(ledger.R.Z_COLUMN),
                               F.lit(flags).alias("fraud_flag_count"), F.lit(int(flags >= 2)).alias("fraud_risk_flag"),
                               *[v.alias(k) for k, v in cols.items()])
    r = ledger.score_ledger(df, 3000.0, 4800.0).first()
    assert (r["final_tier"], r["is_qualitative_override"]) == (final, override)
    assert (r["qualitative_override_note"] != "") == bool(override)
    assert r["active_flags"] == "Statistical anomaly only"


def test_review_end_to_end(gl):
    r = review_ledger(gl)
    cards = r.cards.first()
    assert cards["transactions_analyzed"] == 442
    stacked = r.scored.where(F.col("journal_ref").isin("JE438", "JE439", "JE440", "JE441")).collect()
    assert {x["final_tier"] for x in stacked} == {"High"}
    assert r.top.count() == 3 and r.findings.count() == 4
    assert r.overview.first()["flagged_for_follow_up"] == r.queue.count()


def test_missing_columns(gl):
    with pytest.raises(ValueError, match="vendor"):
        review_ledger(gl.drop("vendor"))


def test_forest_invariants(gl):
    sig = ledger.add_signals(ledger.clean_ledger(gl))
    one = {r["journal_ref"]: r for r in forest.score_with_forest(sig, "Balanced (0.05)").collect()}
    two = {r["journal_ref"]: r["anomaly_score"] for r in forest.score_with_forest(sig.repartition(13), "no such name").collect()}
    assert {k: r["anomaly_score"] for k, r in one.items()} == pytest.approx(two, abs=1e-12)
    scores = np.array([r["anomaly_score"] for r in one.values()])
    assert -1 < scores.min() < 0 < scores.max() < 1
    high = sum(r["raw_tier"] == "High" for r in one.values())
    assert 0.04 * 442 <= high <= 0.08 * 442
    assert all((r["anomaly_label"] == -1) == (r["anomaly_score"] < 0) for r in one.values())
    worst = sorted(one, key=lambda k: one[k]["anomaly_score"])[:4]
    assert set(worst) == {"JE438", "JE439", "JE440", "JE441"}


def test_step_functions_equal_tree_walks():
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=200).round(3), rng.integers(0, 2, (200, 5))]).astype(float)
    nodes = forest._grow(3, x, 8, 42)
    import pandas as pd

    steps = forest.sum_steps(pd.DataFrame(forest._tree_steps(nodes, 3), columns=["tree", "pattern", "bound", "jump"]))
    for row in x:
        at = 0
        while nodes[at][2] >= 0:
            at = nodes[at][4] if row[nodes[at][2]] <= nodes[at][3] else nodes[at][5]
        want = nodes[at][6] + float(forest.average_path(nodes[at][7]))
        bounds, level = steps[int(sum(int(b) << i for i, b in enumerate(row[1:])))]
        assert level[np.searchsorted(bounds, row[0], side="left")] == pytest.approx(want)


def test_hot_copies_keep_their_share(spark):
    counts = spark.createDataFrame([(0, 0.0, 900_000)] + [(1, float(i), 1) for i in range(1000)], "pattern int, z double, n long")
    rows = forest.draw_tree_rows(counts, 901_000, trees=20, sample=256)
    per_tree = rows.groupBy("tree").count().collect()
    share = 256 * 1.6 / 901_000
    hot = rows.where("pattern = 0").count()
    assert abs(hot - 900_000 * share * 20) <= 1 and rows.count() - hot < 40
    assert len(per_tree) == 20 and all(abs(r["count"] - 409) < 20 for r in per_tree)


def test_few_rows_stand_in_every_tree_once(spark):
    counts = spark.createDataFrame([(0, 0.0, 3), (1, 2.0, 1)], "pattern int, z double, n long")
    rows = forest.draw_tree_rows(counts, 4, trees=7, sample=256)
    got = {(r["tree"], r["pattern"]): r["count"] for r in rows.groupBy("tree", "pattern").count().collect()}
    assert got == {(t, p): n for t in range(7) for p, n in ((0, 3), (1, 1))}
    assert rows.select("tree", "u").distinct().count() == 28


@pytest.mark.parametrize("limit", [10, 10_000])
def test_quantiles(spark, limit):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=700).round(3), np.full(350, 0.25)])
    df = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(5)
    got = interpolated_quantiles(df, "v", [0.05, 0.2, 0.5, 0.95], direct_limit=limit)
    assert got == pytest.approx(list(np.quantile(v, [0.05, 0.2, 0.5, 0.95])), abs=1e-12)


def test_summary_join_beyond_the_bound(gl, monkeypatch):
    a = ledger.add_signals(ledger.clean_ledger(gl))
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    b = ledger.add_signals(ledger.clean_ledger(gl))
    assert sorted(a.select(*b.columns).collect(), key=str) == sorted(b.collect(), key=str)


def test_integrity_skips(gl):
    got = {r["name"]: r for r in integrity.integrity_checks(ledger.clean_ledger(gl)).collect()}
    assert all(r["status"] == "Pass" and "skipped" in r["summary"] for r in got.values())


def test_account_statistics_do_not_depend_on_partitioning(spark):
    """Same bits for any order and number of parts; a constant account has no spread."""
    import statistics

    draw = random.Random(3)
    rows = [(f"a{i % 3}", round(draw.uniform(0.01, 99_999), 2)) for i in range(999)] + [("same", 0.1)] * 7 + [("none", None), (None, 5.0)]
    seen = set()
    for parts in (1, 7, 16):
        draw.shuffle(rows)
        df = spark.createDataFrame(rows, "account_name string, abs_amount double").repartition(parts)
        seen.add(tuple(sorted((r["account_name"], r["_mean"], r["_std"]) for r in ledger.account_stats(df).collect() if r["account_name"] != "none")))
        total = df.agg(integrity._total(F.col("abs_amount")).alias("t")).first()["t"]
        seen.add(("total", total))
    assert len(seen) == 2
    stats = next(dict((a, (m, s)) for a, m, s in x) for x in seen if x[0] != "total")
    assert stats["same"] == (pytest.approx(0.1), 0.0)
    for a in ("a0", "a1", "a2"):
        values = [v for name, v in rows if name == a]
        assert stats[a] == pytest.approx((statistics.fmean(values), statistics.pstdev(values)), rel=1e-12)


def test_signals_are_worked_out_once(gl):
    """Summaries are written before the join and signals before the tiers: no later pass starts from the ledger again."""
    signals = ledger.add_signals(ledger.clean_ledger(gl))
    assert len(signals.inputFiles()) >= 2
    by_z = ledger.with_raw_tier(signals.withColumn("anomaly_score", -F.abs("amount_zscore_by_account")))
    for scored in (forest.score_with_forest(signals), by_z):
        assert scored.inputFiles() and "Join" not in scored._jdf.queryExecution().optimizedPlan().toString()
        assert scored.count() == gl.count()
