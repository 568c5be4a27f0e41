"""Ledger queries over the benchmark tables, each with its SQL where SQL can say it."""
from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import forest, integrity, ledger, packet
from ..plans.adapters import ledger_rows, table
from ..rules import ledger as R
from .sql import GL, SIG, dollars, q, scored_sql, with_

BENCHMARK = 1_250_000.0
M = ledger.materiality_values("Private company", BENCHMARK)
PERF, TRANS = M["performance_materiality"], M["transaction_materiality"]
PERIOD = (date(1995, 1, 1), date(2000, 12, 31))

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def clean(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.clean_ledger(ledger_rows(spark, sf))


def signals(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.add_signals(clean(spark, sf))


def scored_by_z(spark: SparkSession, sf: str) -> DataFrame:
    """The stand-in score -|z| takes the forest's place, so SQL can follow every step."""
    df = signals(spark, sf).withColumn("anomaly_score", F.round(F.lit(0.0) - F.abs(R.Z_COLUMN), 6))
    return ledger.score_ledger(ledger.with_raw_tier(df), PERF, TRANS)


def scored_by_forest(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.score_ledger(forest.score_with_forest(signals(spark, sf)), PERF, TRANS)


_DAY_SQL = "strftime(date, '%Y-%m-%d') AS date"


def _day():
    return F.date_format("date", "yyyy-MM-dd").alias("date")


def _z():
    return F.round(R.Z_COLUMN, 5).alias("z")


@query(
    "ledger_clean_types",
    """SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS journal_ref,
         CASE WHEN l_linenumber <> 6 THEN strftime(l_shipdate, '%Y-%m-%d') END AS date,
         CASE WHEN l_linenumber <> 5 THEN round(CAST(CAST(round(l_extendedprice) AS BIGINT) AS DOUBLE), 2) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END END AS amount,
         CASE WHEN l_linenumber <> 5 THEN round(CAST(CAST(round(l_extendedprice) AS BIGINT) AS DOUBLE), 2) END AS abs_amount,
         CASE WHEN l_linestatus = 'F' THEN CAST(CAST(round(l_quantity) AS BIGINT) AS DOUBLE) ELSE 0.0 END AS debit_amount
       FROM lineitem""",
)
def ledger_clean_types(spark, sf):
    """Text dates and amounts, some of them bad."""
    li = table(spark, sf, "lineitem")
    whole = F.round("l_extendedprice").cast("bigint").cast("string")
    raw = li.select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("journal_ref"),
        F.when(F.col("l_linenumber") == 6, "not a date").otherwise(F.date_format("l_shipdate", "MM/dd/yyyy")).alias("date"),
        F.when(F.col("l_linenumber") == 5, "n/a").when(F.col("l_returnflag") == "R", F.concat(F.lit("-"), whole)).otherwise(whole).alias("amount"),
        F.when(F.col("l_linestatus") == "F", F.round("l_quantity").cast("bigint").cast("string")).alias("debit_amount"),
    )
    return ledger.clean_ledger(raw).select("journal_ref", _day(), "amount", "abs_amount", "debit_amount")


_SIG_COLS = ["journal_ref", "account_name", "vendor", "abs_amount", "vendor_txn_count", *R.FLAG_LABELS,
             "control_gap_score", "fraud_flag_count"]


@query("ledger_signals", with_(GL, SIG, body=f"SELECT {', '.join(_SIG_COLS)}, round(z, 5) AS z, "
                               "CASE WHEN fraud_flag_count >= 2 THEN 1 ELSE 0 END AS fraud_risk_flag FROM sig"))
def ledger_signals(spark, sf):
    return signals(spark, sf).select(*_SIG_COLS, _z(), "fraud_risk_flag")


@query("account_stats", with_(GL, body="SELECT account_name, round(avg(abs(amount)), 4) AS mean_amount, "
                              "round(stddev_pop(abs(amount)), 4) AS std_amount FROM gl GROUP BY 1"))
def account_stats(spark, sf):
    s = ledger.account_stats(clean(spark, sf))
    return s.select("account_name", F.round("_mean", 4).alias("mean_amount"), F.round("_std", 4).alias("std_amount"))


@query("vendor_frequency", with_(GL, body="SELECT vendor, count(*) AS vendor_txn_count FROM gl GROUP BY 1"))
def vendor_frequency(spark, sf):
    return ledger.vendor_counts(clean(spark, sf)).select(F.col("_vendor_key").alias("vendor"), "vendor_txn_count")


@query(
    "entity_materiality",
    """WITH e AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Public company' ELSE 'Private company' END AS entity_type,
                   CAST(CAST(round(c_acctbal) AS BIGINT) * 100 AS DOUBLE) AS benchmark FROM customer)
       SELECT c_custkey, entity_type, benchmark, CASE WHEN entity_type = 'Public company' THEN 0.05 ELSE 0.04 END AS fs_pct,
         round(benchmark * CASE WHEN entity_type = 'Public company' THEN 0.05 ELSE 0.04 END, 2) AS fs_materiality,
         round(benchmark * CASE WHEN entity_type = 'Public company' THEN 0.05 ELSE 0.04 END * 0.5, 2) AS performance_materiality,
         round(benchmark * CASE WHEN entity_type = 'Public company' THEN 0.05 ELSE 0.04 END * 0.8, 2) AS transaction_materiality
       FROM e""",
)
def entity_materiality(spark, sf):
    """Customers as entities with their own benchmarks."""
    e = table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 3 == 0, "Public company").otherwise("Private company").alias("entity_type"),
        (F.round("c_acctbal").cast("bigint") * 100).cast("double").alias("benchmark"),
    )
    return ledger.with_materiality(e)


@query("ledger_tier_cuts", "WITH " + scored_sql(PERF, TRANS).strip().rstrip(",") + "\nSELECT round(hi, 5) AS high_cut, round(md, 5) AS medium_cut FROM cuts")
def ledger_tier_cuts(spark, sf):
    df = signals(spark, sf).withColumn("anomaly_score", F.round(F.lit(0.0) - F.abs(R.Z_COLUMN), 6))
    hi, md = ledger.tier_cuts(df, ledger.contamination(None))
    n = df.limit(1)
    return n.select(F.round(F.lit(hi), 5).alias("high_cut"), F.round(F.lit(md), 5).alias("medium_cut"))


_SCORED = ["journal_ref", "vendor", "abs_amount", "raw_tier", "final_tier", "materiality_annotation", "active_flags",
           "is_qualitative_override", "qualitative_override_note", "pcaob_label", "flagged_status"]
_SCORED_WITH = "WITH " + scored_sql(PERF, TRANS).strip().rstrip(",") + "\n"


@query("ledger_scored", _SCORED_WITH + f"SELECT {', '.join(_SCORED)} FROM scored")
def ledger_scored(spark, sf):
    return scored_by_z(spark, sf).select(*_SCORED)


@query("ledger_by_score", _SCORED_WITH + "SELECT journal_ref, final_tier, anomaly_score FROM scored")
def ledger_by_score(spark, sf):
    """The whole ledger as it is written out, most anomalous rows first."""
    return ledger.by_anomaly(scored_by_z(spark, sf)).select("journal_ref", "final_tier", "anomaly_score")


_QUEUE = ["journal_ref", "account_name", "vendor", "abs_amount", "final_tier", "active_flags"]


@query("ledger_review_queue", _SCORED_WITH + f"SELECT {_DAY_SQL}, {', '.join(_QUEUE)}, anomaly_score "
       "FROM scored WHERE flagged_status = 'Flagged'")
def ledger_review_queue(spark, sf):
    return ledger.review_queue(scored_by_z(spark, sf)).select(_day(), *_QUEUE, "anomaly_score")


@query("ledger_top_rows", _SCORED_WITH + f"""SELECT {_DAY_SQL}, account_name AS account, vendor, round(abs_amount, 2) AS amount,
  final_tier AS priority, pcaob_label, active_flags AS signals, is_qualitative_override = 1 AS override FROM scored
  WHERE flagged_status = 'Flagged' ORDER BY CASE ft WHEN 3 THEN 0 ELSE 1 END, anomaly_score, journal_ref, scored.date, account_name, vendor, amount LIMIT 5""")
def ledger_top_rows(spark, sf):
    return ledger.top_rows(scored_by_z(spark, sf), 5)


@query("ledger_queue_export", _SCORED_WITH + f"""SELECT {_DAY_SQL}, account_code, account_name, vendor, description, journal_ref,
  amount, abs_amount, final_tier, pcaob_label, active_flags, materiality_annotation, anomaly_score, raw_tier,
  fraud_flag_count, is_qualitative_override, qualitative_override_note FROM scored WHERE flagged_status = 'Flagged'""")
def ledger_queue_export(spark, sf):
    return ledger.queue_export(scored_by_z(spark, sf)).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("ledger_summary_cards", _SCORED_WITH + """SELECT count(*) AS transactions_analyzed,
  count(*) FILTER (WHERE flagged_status = 'Flagged') AS flagged_for_follow_up, count(*) FILTER (WHERE final_tier = 'High') AS high_priority,
  count(*) FILTER (WHERE final_tier = 'Medium') AS medium_priority,
  count(*) FILTER (WHERE is_qualitative_override = 1) AS escalated_by_override FROM scored""")
def ledger_summary_cards(spark, sf):
    return packet.summary_cards(scored_by_z(spark, sf))


@query("ledger_signal_counts", _SCORED_WITH + " UNION ALL ".join(
    [f"SELECT {q(t)} AS signal, count(*) FILTER (WHERE {c} = 1) AS population, "
     f"count(*) FILTER (WHERE {c} = 1 AND flagged_status = 'Flagged') AS in_queue FROM scored" for c, t in R.FLAG_LABELS.items()]
    + [f"SELECT {q(R.Z_LABEL)}, CAST(NULL AS BIGINT), count(*) FILTER (WHERE abs(z) >= 2 AND flagged_status = 'Flagged') FROM scored"]))
def ledger_signal_counts(spark, sf):
    return packet.signal_counts(scored_by_z(spark, sf))


def _hash_sql() -> str:
    a, b = "sum(abs(amount))", "(sum(debit_amount) + sum(credit_amount))"
    d, c = "sum(debit_amount)", "sum(credit_amount)"
    lo, hi = (f"TIMESTAMP '{x.isoformat()} 00:00:00'" for x in PERIOD)
    span = f"[{PERIOD[0]} .. {PERIOD[1]}]"
    def side(key, other):
        return f"SELECT {key} AS v FROM gl WHERE {key} IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {other}) > 1"
    def part(label, plural, cte):
        top = f"(SELECT string_agg(v, ''', ''' ORDER BY v) FROM (SELECT v FROM {cte} ORDER BY v LIMIT 3))"
        return (f"CASE WHEN (SELECT count(*) FROM {cte}) > 0 THEN CAST((SELECT count(*) FROM {cte}) AS VARCHAR) || "
                f"' {label}(s) map to multiple {plural} (e.g. [''' || {top} || '''])' END")
    text = f"concat_ws('; ', {part('account_code', 'names', 'bc')}, {part('account_name', 'codes', 'bn')})"
    return with_(GL, f"bc AS ({side('account_code', 'account_name')})", f"bn AS ({side('account_name', 'account_code')})", body=f"""
SELECT 1 AS position, 'Hash total' AS name, CASE WHEN abs({a} - {b}) <= 0.01 THEN 'Pass' ELSE 'Warning' END AS status,
  'Σ|amount| = ' || {dollars(a)} || '; Σ(debit+credit) = ' || {dollars(b)} || '; diff = ' || {dollars(f'abs({a} - {b})')} || '.' AS summary FROM gl
UNION ALL SELECT 2, 'Cross-footing', CASE WHEN abs({d} - {c}) <= 0.01 THEN 'Pass' ELSE 'Warning' END,
  'ΣDebit = ' || {dollars(d)} || '; ΣCredit = ' || {dollars(c)} || '; diff = ' || {dollars(f'abs({d} - {c})')} ||
  ' (' || format('{{:.2f}}', abs({d} - {c}) / greatest({d}, 1) * 100) || '%).' FROM gl
UNION ALL SELECT 3, 'Date in period', CASE WHEN count(*) FILTER (WHERE date < {lo} OR date > {hi}) = 0 THEN 'Pass' ELSE 'Warning' END,
  CAST(count(*) FILTER (WHERE date < {lo} OR date > {hi}) AS VARCHAR) || ' of ' || CAST(count(date) AS VARCHAR) || ' rows fall outside {span}.' FROM gl
UNION ALL SELECT 4, 'Account mapping', CASE WHEN {text} = '' THEN 'Pass' ELSE 'Warning' END,
  CASE WHEN {text} = '' THEN 'Account code ↔ name mapping is consistent.' ELSE {text} || '.' END""")


@query("ledger_integrity", _hash_sql())
def ledger_integrity(spark, sf):
    return integrity.integrity_checks(clean(spark, sf), *PERIOD).drop("detail")


@query("ledger_integrity_status", "WITH f AS (" + _hash_sql() + ") SELECT count(*) FILTER (WHERE status = 'Pass') AS pass, "
       "count(*) FILTER (WHERE status = 'Warning') AS warning, count(*) FILTER (WHERE status = 'Fail') AS fail FROM f")
def ledger_integrity_status(spark, sf):
    return integrity.findings_by_status(integrity.integrity_checks(clean(spark, sf), *PERIOD))


@query("account_mapping_offenders", with_(GL, body="""
SELECT 'account_code' AS kind, account_code AS value, count(DISTINCT account_name) AS partners FROM gl GROUP BY 2 HAVING count(DISTINCT account_name) > 1
UNION ALL SELECT 'account_name', account_name, count(DISTINCT account_code) FROM gl GROUP BY 2 HAVING count(DISTINCT account_code) > 1"""))
def account_mapping_offenders(spark, sf):
    return integrity.account_offenders(clean(spark, sf))


@query("ledger_top_vendors", with_(GL, body="SELECT vendor, count(*) AS rows FROM gl GROUP BY 1 ORDER BY rows DESC, vendor LIMIT 5"))
def ledger_top_vendors(spark, sf):
    return packet.most_frequent(clean(spark, sf), "vendor", 5)


@query("signal_anchors", with_(GL, SIG, body=" UNION ALL ".join(
    f"SELECT journal_ref, vendor, abs_amount, {q(k)} AS signal, {q(a[0])} AS source, {q(a[2])} AS evidence FROM sig WHERE "
    + ("abs(z) >= 2" if k == R.Z_COLUMN else f"{k} = 1") for k, a in R.ANCHORS.items())))
def signal_anchors(spark, sf):
    return packet.signal_anchors(signals(spark, sf)).select("journal_ref", "vendor", "abs_amount", "signal", "source", "evidence")


_ANCHOR_SQL = "array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN {'abs(z) >= 2' if k == R.Z_COLUMN else k + ' = 1'} THEN "
    + q(f"- {k}: designed around {a[0]} — {a[1]}. Evidence hint: {a[2]}.") + " END" for k, a in R.ANCHORS.items()) + "], lambda x: x IS NOT NULL), chr(10))"


@query("ledger_evidence", _SCORED_WITH + f"""SELECT journal_ref, {_DAY_SQL}, account_name AS account, vendor, abs_amount AS amount,
  final_tier AS priority_tier, pcaob_label, active_flags, materiality_annotation AS materiality,
  CASE WHEN is_qualitative_override = 1 THEN 'yes' ELSE 'no' END AS qualitative_override, qualitative_override_note AS override_note,
  coalesce(nullif({_ANCHOR_SQL}, ''), '- (no discrete flags; statistical anomaly only)') AS anchors
  FROM scored WHERE flagged_status = 'Flagged'""")
def ledger_evidence(spark, sf):
    facts = packet.evidence_facts(ledger.flagged_rows(scored_by_z(spark, sf)))
    return facts.select("journal_ref", "facts.*", "override_note", "anchors").withColumn("date", F.substring("date", 1, 10))


_TOP5 = "(SELECT string_agg({0}, ' / ' ORDER BY n DESC, {0}) FROM (SELECT {0}, count(*) AS n FROM gl GROUP BY 1 ORDER BY n DESC, {0} LIMIT 5))"


@query("packet_overview", _SCORED_WITH + f"""SELECT count(*) AS transactions, count(*) FILTER (WHERE flagged_status = 'Flagged') AS flagged,
  count(*) FILTER (WHERE final_tier = 'High') AS high, count(*) FILTER (WHERE final_tier = 'Medium') AS medium,
  count(*) FILTER (WHERE is_qualitative_override = 1) AS escalated, '{PERIOD[0]} .. {PERIOD[1]}' AS period,
  {_TOP5.format('account_name')} AS top_accounts, {_TOP5.format('vendor')} AS top_vendors,
  {M['fs_materiality']}::DOUBLE AS fs_materiality, 4 AS checks, 6 AS signals FROM scored""")
def packet_overview(spark, sf):
    scored = scored_by_z(spark, sf)
    found = integrity.integrity_checks(clean(spark, sf), *PERIOD)
    o = packet.packet_overview(scored, found, M, f"{PERIOD[0]} .. {PERIOD[1]}")
    return o.select(
        F.col("transactions_analyzed").alias("transactions"), F.col("flagged_for_follow_up").alias("flagged"),
        F.col("high_priority").alias("high"), F.col("medium_priority").alias("medium"),
        F.col("escalated_by_override").alias("escalated"), "period",
        F.array_join("top_accounts", " / ").alias("top_accounts"), F.array_join("top_vendors", " / ").alias("top_vendors"),
        "fs_materiality", F.size("integrity").alias("checks"), F.size("signals").alias("signals"),
    )


_PHRASES = "[" + ", ".join(q(p) for p in R.BANNED_PHRASES) + "]"


@query("memo_guardrail", f"""WITH m AS (SELECT conv_id, turn, text || ' ' || coalesce(upper(({_PHRASES})[CAST(conv_id % 24 + 1 AS INTEGER)]), '') AS memo
    FROM conversations WHERE role = 'assistant'),
  h AS (SELECT conv_id, turn, list_filter({_PHRASES}, lambda p: contains(lower(memo), p)) AS hits FROM m)
  SELECT conv_id, turn, array_to_string(hits, '; ') AS guardrail_hits, len(hits) = 0 AS guardrail_ok FROM h""")
def memo_guardrail(spark, sf):
    """Assistant turns as memos, three in four with a banned phrase put at the end."""
    phrase = F.get(F.array(*[F.lit(p) for p in R.BANNED_PHRASES]), (F.col("conv_id") % 24).cast("int"))
    memos = table(spark, sf, "conversations").where("role = 'assistant'").select(
        "conv_id", "turn", F.concat(F.col("text"), F.lit(" "), F.coalesce(F.upper(phrase), F.lit(""))).alias("memo")
    )
    return packet.scan_memos(memos).select("conv_id", "turn", F.array_join("guardrail_hits", "; ").alias("guardrail_hits"), "guardrail_ok")


@query("forest_features", with_(GL, SIG, body=f"SELECT journal_ref, vendor, abs_amount, round(z, 5) AS f0, {', '.join(f'CAST({c} AS DOUBLE) AS f{i}' for i, c in enumerate(R.FLAG_LABELS, 1))} FROM sig"))
def forest_features(spark, sf):
    f = forest.feature_array(signals(spark, sf))
    return f.select("journal_ref", "vendor", "abs_amount", F.round(F.col("features")[0], 5).alias("f0"),
                    *[F.col("features")[i].alias(f"f{i}") for i in range(1, 6)])


@query("forest_standardised", with_(GL, SIG, body="""SELECT journal_ref, vendor, abs_amount,
  round((z - (SELECT avg(z) FROM sig)) / (SELECT stddev_pop(z) FROM sig), 5) + 0.0 AS z_scaled,
  round((is_new_vendor - (SELECT avg(is_new_vendor) FROM sig)) / (SELECT stddev_pop(is_new_vendor) FROM sig), 5) AS new_vendor_scaled FROM sig"""))
def forest_standardised(spark, sf):
    s = forest.standardise(signals(spark, sf), [R.Z_COLUMN, "is_new_vendor"])
    return s.select("journal_ref", "vendor", "abs_amount", (F.round(f"{R.Z_COLUMN}_scaled", 5) + F.lit(0.0)).alias("z_scaled"),
                    F.round("is_new_vendor_scaled", 5).alias("new_vendor_scaled"))


@query("forest_scores")
def forest_scores(spark, sf):
    return scored_by_forest(spark, sf).select("journal_ref", "vendor", "abs_amount", "anomaly_score", "anomaly_label",
                                              "raw_tier", "final_tier", "active_flags")


@query("forest_review_queue")
def forest_review_queue(spark, sf):
    return ledger.queue_export(ledger.review_queue(scored_by_forest(spark, sf)))
