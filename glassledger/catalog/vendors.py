"""Vendor and consolidation queries over the benchmark tables."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import ratio_of
from ..functions.text import dollars as money_text
from ..operators import classify_rows as C
from ..operators import cross_check as X
from ..operators import reports as P
from ..operators import review_flags as flags
from ..operators import vendor_names as N
from ..operators import vendor_rollup as V
from ..plans.adapters import statement_rows, table
from ..plans.consolidation import consolidate, normalised_rows, statement_vendors
from ..rules import vendors as R
from ..session import scratch_path
from ..sources.tables import write_sheets
from .sql import (BASE, CLASSIFIED, CROSS, FLAGS, KNOWN_TYPES, MATCHED_BASE, PRECLEAN, POOLED, SIMILAR, STATEMENT_VENDORS, TXN, concat_nonempty, dollars,
                  eligibility, percent, q, ratios, rollup, with_, worksheet_norm)

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def classified(spark: SparkSession, sf: str) -> DataFrame:
    return C.classify_rows(statement_rows(spark, sf))


def normal(spark: SparkSession, sf: str) -> DataFrame:
    return normalised_rows(classified(spark, sf))


def rollup_of(spark: SparkSession, sf: str, *keys: str) -> DataFrame:
    return V.roll_up_descriptions(C.fill_defaults(classified(spark, sf)), list(keys))


def rolled(spark: SparkSession, sf: str) -> DataFrame:
    """Kept, as the findings read it several times."""
    return X.rank_vendors(rollup_of(spark, sf, "statement").withColumn("statement_key", F.col("statement"))).persist()


def money(*cols: str):
    """Decimals leave as doubles, so that both engines print them alike."""
    return [F.col(c).cast("double").alias(c) for c in cols]


def dbl(*cols: str) -> str:
    return ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)


# --- row rules --------------------------------------------------------------------


@query("statement_rows", with_(TXN, body=f"SELECT statement, line_no, date_raw, description, {dbl('amount')} FROM tx"))
def statement_rows_q(spark, sf):
    return statement_rows(spark, sf).select("statement", "line_no", "date_raw", "description", *money("amount"))


@query("row_classification", with_(TXN, CLASSIFIED, body="SELECT statement, line_no, transaction_type, include_for_1099, review_required, exclusion_reason FROM cl"))
def row_classification(spark, sf):
    return classified(spark, sf).select("statement", "line_no", "transaction_type", "include_for_1099", "review_required", "exclusion_reason")


@query("rows_for_1099", with_(TXN, CLASSIFIED, body=f"SELECT statement, line_no, description, {dbl('amount')} FROM cl WHERE include_for_1099"))
def rows_for_1099(spark, sf):
    return C.included_rows(classified(spark, sf)).select("statement", "line_no", "description", *money("amount"))


@query("type_breakdown", with_(TXN, CLASSIFIED, body="SELECT statement, transaction_type, count(*) AS rows FROM cl GROUP BY 1, 2"))
def type_breakdown(spark, sf):
    return C.type_breakdown(classified(spark, sf), ["statement"])


@query("inclusion_totals", with_(TXN, CLASSIFIED, body="""SELECT statement, count(*) FILTER (WHERE include_for_1099) AS included_count,
  count(*) FILTER (WHERE NOT include_for_1099) AS excluded_count,
  CAST(sum(CASE WHEN include_for_1099 THEN amount ELSE 0 END) AS DOUBLE) AS included_total FROM cl GROUP BY 1"""))
def inclusion_totals(spark, sf):
    t = C.inclusion_totals(classified(spark, sf), ["statement"])
    return t.select("statement", "included_count", "excluded_count", *money("included_total"))


# --- names ------------------------------------------------------------------------


@query("precleaned_descriptions", with_(TXN, body=f"SELECT statement, line_no, {PRECLEAN} AS precleaned FROM tx"))
def precleaned_descriptions(spark, sf):
    return statement_rows(spark, sf).select("statement", "line_no", N.preclean(F.col("description")).alias("precleaned"))


_NORM = ["statement", "line_no", "raw_name", "cleaned_name", "canonical_name", "entity_type", "match_confidence",
         "needs_review", "norm_excluded", "norm_reason"]


@query("vendor_names", "WITH " + BASE + f"\nSELECT {', '.join(_NORM)} FROM norm")
def vendor_names(spark, sf):
    return normal(spark, sf).select(*_NORM)


def vendor_master(spark: SparkSession, sf: str) -> DataFrame:
    """The list of known vendors: parts of three types. That it leaves names out is its point, as those must find the nearest entry."""
    name = F.initcap(F.concat("p_name", F.lit(" "), "p_type")).alias("name")
    return table(spark, sf, "part").where(F.col("p_type").isin(*KNOWN_TYPES)).groupBy(name).agg(F.min("p_partkey").alias("pos"))


@query("vendor_names_matched", "WITH RECURSIVE " + MATCHED_BASE + f"\nSELECT {', '.join(_NORM)} FROM norm")
def vendor_names_matched(spark, sf):
    """Names matched to the vendor list by similarity."""
    return normalised_rows(classified(spark, sf), vendor_master(spark, sf)).select(*_NORM)


@query("name_ratios", f"""WITH RECURSIVE
pn AS (SELECT p_partkey, upper(p_name || ' ' || p_type) AS n FROM part),
pp AS (SELECT x.p_partkey AS id, x.n AS a, y.n AS b FROM pn x JOIN pn y ON y.p_partkey = x.p_partkey + 1),
{ratios('pp').strip()}
SELECT id AS p_partkey, ratio AS similarity FROM ratio""")
def name_ratios(spark, sf):
    """The similarity of every part's name to the next part's."""
    part = table(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit(" "), "p_type").alias("n"))
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("n").alias("n_next"))
    return part.join(after, "p_partkey").select("p_partkey", ratio_of(F.col("n"), F.col("n_next")).alias("similarity"))


# --- rollups ----------------------------------------------------------------------

_ROLL = ["canonical_name", "entity_type", "transaction_count", "first_payment_date", "last_payment_date",
         "variant_count", "match_confidence", "needs_review"]
_DAYS_SQL = "strftime(first_paid_on, '%Y-%m-%d') AS first_paid_on, strftime(last_paid_on, '%Y-%m-%d') AS last_paid_on"


def _rolled_out(df: DataFrame, *keys: str) -> DataFrame:
    days = [F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("first_paid_on", "last_paid_on")]
    return df.select(*keys, *_ROLL, *days, *money("total_amount"), F.array_join("review_reasons", "; ").alias("review_reasons"))


def _rolled_sql(name: str, *keys: str) -> str:
    return f"SELECT {', '.join([*keys, *_ROLL])}, {_DAYS_SQL}, {dbl('total_amount')}, reasons_text AS review_reasons FROM {name}"


@query("vendor_rollup_by_statement", "WITH " + BASE + ",\n" + STATEMENT_VENDORS.strip() + "\n" + _rolled_sql("sv", "statement"))
def vendor_rollup_by_statement(spark, sf):
    return _rolled_out(rollup_of(spark, sf, "statement"), "statement")


@query("vendor_rollup_pooled", "WITH " + BASE + ",\n" + POOLED.strip() + "\n" + _rolled_sql("pv"))
def vendor_rollup_pooled(spark, sf):
    return _rolled_out(rollup_of(spark, sf).orderBy(*V.vendor_order()))


@query("vendor_rollup_of_named_rows", "WITH " + BASE + ",\n" + STATEMENT_VENDORS.strip() + "\n" + _rolled_sql("sv", "statement"))
def vendor_rollup_of_named_rows(spark, sf):
    return _rolled_out(V.roll_up_vendors(normal(spark, sf), ["statement"]), "statement")


@query("vendor_spellings", "WITH " + BASE + "\nSELECT DISTINCT canonical_name, raw_name FROM norm WHERE NOT norm_excluded AND include_for_1099")
def vendor_spellings(spark, sf):
    return V.vendor_variants(normal(spark, sf))


@query("vendor_sources", "WITH " + BASE + """
SELECT canonical_name, count(DISTINCT statement) AS statement_count, string_agg(DISTINCT statement, ', ' ORDER BY statement) AS sources
FROM norm WHERE NOT norm_excluded AND include_for_1099 GROUP BY 1""")
def vendor_sources(spark, sf):
    s = V.vendor_sources(normal(spark, sf))
    return s.select("canonical_name", "statement_count", F.array_join("source_statements", ", ").alias("sources"))


_ELIG = ["statement", "canonical_name", "form_type", "threshold_met", "notes"]


@query("eligibility_1099", "WITH " + BASE + ",\n" + STATEMENT_VENDORS.strip() + ",\n" + eligibility("ev", "sv").strip() +
       f"\nSELECT {', '.join(_ELIG)}, form_type <> 'EXEMPT' AS eligible, form_type <> 'EXEMPT' AS needs_w9, 600.0::DOUBLE AS threshold_amount, {dbl('total_amount')} FROM ev")
def eligibility_1099(spark, sf):
    return V.classify_1099(rollup_of(spark, sf, "statement")).select(
        *_ELIG, "eligible", "needs_w9", "threshold_amount", *money("total_amount"))


# --- worksheet ---------------------------------------------------------------------


def worksheet_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.fill_defaults(statement_rows(spark, sf))
    return N.normalise_vendors(rows, profile="worksheet", preclean_first=False)


def worksheet_rollup_of(spark: SparkSession, sf: str) -> DataFrame:
    return V.roll_up_vendors(worksheet_rows(spark, sf), profile="worksheet", with_variants=True)


_WS = "WITH " + TXN.strip() + ",\n" + worksheet_norm().strip() + ",\n" + rollup("wv", [], gated=False).strip() + "\n"
_CATEGORY = ("CASE WHEN " + " OR ".join(f"contains(upper(canonical_name), {q(w)})" for w in R.UTILITY_WORDS) + " THEN 'Utility' WHEN "
             + " OR ".join(f"contains(upper(canonical_name), {q(w)})" for w in R.RETAIL_WORDS)
             + " THEN 'Supplies/Retail' WHEN entity_type IN ('LLC', 'INC', 'CORP') THEN 'Contractor' ELSE 'Unclear' END")


@query("worksheet_rollup", _WS + _rolled_sql("wv"))
def worksheet_rollup(spark, sf):
    return _rolled_out(worksheet_rollup_of(spark, sf))


@query("worksheet_vendor_sheet", _WS + f"""
SELECT 1 AS section, canonical_name AS vendor, coalesce(entity_type, 'Individual?') AS entity_type, CAST(total_amount AS DOUBLE) AS total_paid,
  transaction_count AS payments, coalesce(first_payment_date, '') AS first_payment, coalesce(last_payment_date, '') AS last_payment,
  'TBD' AS eligible_1099, 'TBD' AS w9_on_file, {_CATEGORY} AS category, match_confidence AS confidence,
  CASE WHEN needs_review THEN 'YES' ELSE 'NO' END AS review_needed, reasons_text AS review_reason,
  array_to_string(variants, '; ') AS raw_name_variants FROM wv
UNION ALL SELECT 2, 'TOTAL', NULL, CAST(sum(total_amount) AS DOUBLE), CAST(sum(transaction_count) AS BIGINT), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM wv""")
def worksheet_vendor_sheet(spark, sf):
    return P.worksheet_vendors(worksheet_rollup_of(spark, sf)).withColumn("total_paid", F.col("total_paid").cast("double"))


@query("worksheet_detail", "WITH " + TXN.strip() + ",\n" + worksheet_norm().strip() + f"""
SELECT date_raw AS date, description AS raw_description, canonical_name, coalesce(entity_type, '') AS entity_type, {dbl('amount')},
  'bank' AS source, match_confidence AS confidence, CASE WHEN needs_review THEN 'YES' ELSE '' END AS review FROM norm""")
def worksheet_detail(spark, sf):
    return P.worksheet_detail(worksheet_rows(spark, sf)).withColumn("amount", F.col("amount").cast("double"))


@query("worksheet_stats", _WS + """
SELECT count(*) AS unique_vendors, CAST(sum(total_amount) AS DOUBLE) AS total_reconciled, count(*) FILTER (WHERE total_amount >= 600) AS over_600,
  count(*) FILTER (WHERE entity_type IN ('LLC', 'INC', 'CORP')) AS with_entity_suffix, count(*) FILTER (WHERE needs_review) AS needing_review,
  (SELECT count(*) FROM tx) AS transactions,
  format('{:.1f}', count(*) FILTER (WHERE needs_review) / greatest(count(*), 1) * 100) || '%' AS review_rate FROM wv""")
def worksheet_stats(spark, sf):
    s = P.worksheet_stats(worksheet_rows(spark, sf), worksheet_rollup_of(spark, sf))
    return s.withColumn("total_reconciled", F.col("total_reconciled").cast("double"))


# --- flags and cross-statement findings ---------------------------------------------

_SV = "WITH " + BASE + ",\n" + STATEMENT_VENDORS.strip() + ",\n"


@query("review_signals", _SV + FLAGS.strip() + "\nSELECT statement, canonical_name, r1 AS low_match, r2 AS near_threshold, r3 AS unknown_entity, r4 AS normalisation FROM fl2")
def review_signals(spark, sf):
    v = flags.with_signals(rollup_of(spark, sf, "statement"))
    return v.select("statement", "canonical_name", "low_match", "near_threshold", "unknown_entity", "normalisation")


@query("review_signals_matched", "WITH RECURSIVE " + MATCHED_BASE + ",\n" + STATEMENT_VENDORS.strip() + ",\n" + FLAGS.strip() +
       "\nSELECT statement, canonical_name, match_confidence, r1 AS low_match, r2 AS near_threshold, r3 AS unknown_entity, r4 AS normalisation FROM fl2")
def review_signals_matched(spark, sf):
    """The signals of vendors that were looked up in a list of known ones; many are only like an entry."""
    rows = C.fill_defaults(classified(spark, sf))
    v = flags.with_signals(V.roll_up_descriptions(rows, ["statement"], vendor_master(spark, sf)))
    return v.select("statement", "canonical_name", "match_confidence", "low_match", "near_threshold", "unknown_entity", "normalisation")


@query("cross_statement_matches", _SV + CROSS.strip() + f"\nSELECT canonical_name, statement_count, {dbl('combined_total')}, transaction_count, crosses AS crosses_threshold_combined_only FROM cm")
def cross_statement_matches(spark, sf):
    m = X.cross_matches(X.enough_statements(rolled(spark, sf)))
    return m.select("canonical_name", "statement_count", *money("combined_total"), "transaction_count", "crosses_threshold_combined_only")


@query("threshold_crossings", _SV + CROSS.strip() + f"\nSELECT canonical_name, statement_count, {dbl('combined_total')} FROM cm WHERE crosses")
def threshold_crossings(spark, sf):
    m = X.threshold_crossings(X.cross_matches(X.enough_statements(rolled(spark, sf))))
    return m.select("canonical_name", "statement_count", *money("combined_total"))


@query("amount_mismatches", _SV + CROSS.strip() + f"\nSELECT canonical_name, statement_a, statement_b, {dbl('amount_a', 'amount_b', 'abs_diff')}, round(ratio, 6) AS ratio FROM mm")
def amount_mismatches(spark, sf):
    m = X.amount_mismatches(X.enough_statements(rolled(spark, sf)))
    return m.select("canonical_name", "statement_a", "statement_b", *money("amount_a", "amount_b", "abs_diff"), F.round("ratio", 6).alias("ratio"))


@query("near_threshold_vendors", _SV + CROSS.strip() + f"\nSELECT canonical_name, statement, {dbl('total_amount')}, CAST(600 - total_amount AS DOUBLE) AS distance_to_threshold FROM nt")
def near_threshold_vendors(spark, sf):
    v = X.enough_statements(rolled(spark, sf))
    n = X.near_threshold_vendors(v, X.cross_matches(v))
    return n.select("canonical_name", "statement", *money("total_amount", "distance_to_threshold"))


_REASONS = f"""
rs AS (
  SELECT statement, canonical_name, 1 AS ph, '' AS pos, r1 AS reason FROM fl2 WHERE r1 IS NOT NULL
  UNION ALL SELECT statement, canonical_name, 2, '', r2 FROM fl2 WHERE r2 IS NOT NULL
  UNION ALL SELECT statement, canonical_name, 3, '', r3 FROM fl2 WHERE r3 IS NOT NULL
  UNION ALL SELECT statement, canonical_name, 4, '', r4 FROM fl2 WHERE r4 IS NOT NULL
  UNION ALL SELECT statement, canonical_name, 5, '', 'Combined total across statements (' || {dollars('combined_total')} || ') crosses $600 threshold'
    FROM sv JOIN cm USING (canonical_name) WHERE crosses
  UNION ALL SELECT unnest([statement_a, statement_b]), canonical_name, 6, statement_a || statement_b,
    'Possible extraction issue — ' || {dollars('amount_a')} || ' in ' || statement_a || ' vs ' || {dollars('amount_b')} || ' in ' || statement_b ||
    ' (' || format('{{:.1f}}', ratio) || 'x variance)' FROM mm),
rl AS (SELECT statement, canonical_name, string_agg(reason, '; ' ORDER BY ph, pos) AS reasons FROM rs GROUP BY 1, 2)
"""
_ALL = _SV + CROSS.strip() + ",\n" + FLAGS.strip() + ",\n" + _REASONS.strip()


@query("review_reasons", _ALL + "\nSELECT statement, canonical_name, reasons FROM rl")
def review_reasons(spark, sf):
    r = consolidate(classified(spark, sf), with_variants=False).reasons
    return r.select("statement", "canonical_name", F.array_join("reasons", "; ").alias("reasons"))


_VARIANT_REASONS = SIMILAR.strip() + f""",
rs7 AS (SELECT ph, pos, statement, canonical_name, reason FROM rs UNION ALL
  SELECT 7, statement_a || statement_b || lpad(CAST(rank_a AS VARCHAR), 9, '0') || lpad(CAST(rank_b AS VARCHAR), 9, '0'),
    unnest([statement_a, statement_b]), unnest([name_a, name_b]), 'Name variant detected — "' || name_a || '" in ' || statement_a || ' ~ "' || name_b ||
    '" in ' || statement_b || ' (' || {percent('similarity')} || ' similar)' FROM va),
rv AS (SELECT statement, canonical_name, string_agg(reason, '; ' ORDER BY ph, pos) AS reasons, bool_or(ph = 7) AS name_variant_detected,
  bool_or(ph = 6) AS cross_statement_mismatch, bool_or(ph = 2) AS near_threshold, bool_or(ph = 1) AS low_match_confidence,
  bool_or(ph = 3) AS unknown_entity_over_threshold FROM rs7 GROUP BY 1, 2)
"""
_ALL_VARIANTS = "WITH RECURSIVE" + _ALL.removeprefix("WITH") + ",\n" + _VARIANT_REASONS.strip()


@query("review_reasons_with_variants", _ALL_VARIANTS + """
SELECT statement, canonical_name, reasons, name_variant_detected, cross_statement_mismatch, near_threshold, low_match_confidence, unknown_entity_over_threshold FROM rv""")
def review_reasons_with_variants(spark, sf):
    r = consolidate(classified(spark, sf)).reasons
    return r.select("statement", "canonical_name", F.array_join("reasons", "; ").alias("reasons"), "name_variant_detected",
                    "cross_statement_mismatch", "near_threshold", "low_match_confidence", "unknown_entity_over_threshold")


_SIMILAR = "WITH RECURSIVE" + _SV.removeprefix("WITH") + SIMILAR.strip() + "\n"


@query("similar_vendor_names", _SIMILAR + "SELECT name_a, name_b, similarity FROM similar_names")
def similar_vendor_names(spark, sf):
    return X.similar_names(rollup_of(spark, sf, "statement"))


@query("name_variants", _SIMILAR.rstrip() + f""",
vf AS (SELECT *, upper(name_a) > upper(name_b) AS swap, row_number() OVER (PARTITION BY least(upper(name_a), upper(name_b)), greatest(upper(name_a), upper(name_b))
  ORDER BY statement_a, statement_b, rank_a, rank_b) AS k FROM va)
SELECT CASE WHEN swap THEN statement_b ELSE statement_a END AS statement_a, CASE WHEN swap THEN name_b ELSE name_a END AS name_a,
  CASE WHEN swap THEN statement_a ELSE statement_b END AS statement_b, CASE WHEN swap THEN name_a ELSE name_b END AS name_b,
  {percent('similarity')} AS similarity, CASE WHEN swap THEN {dollars('amount_b')} || ' / ' || {dollars('amount_a')}
  ELSE {dollars('amount_a')} || ' / ' || {dollars('amount_b')} END AS amounts FROM vf WHERE k = 1""")
def name_variants(spark, sf):
    v = X.enough_statements(rolled(spark, sf))
    return P.variant_sheet(X.name_variants(v, X.similar_names(v)))


_STATUS_SQL = """
sts AS (SELECT DISTINCT statement, CASE WHEN CAST(substr(statement, 6) AS INTEGER) % 4 = 0 THEN 'failed_other'
          WHEN CAST(substr(statement, 6) AS INTEGER) % 4 = 1 THEN 'partial' ELSE 'success' END AS status FROM tx),
"""


def statement_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Statements with a status derived from their year."""
    year = F.substring("statement", 6, 4).cast("int") % 4
    rows = statement_rows(spark, sf).select("statement").distinct()
    return rows.select("statement", F.when(year == 0, "failed_other").when(year == 1, "partial").otherwise("success").alias("status"),
                       F.lit(0.9).alias("confidence"), F.when(year == 0, "timed out").alias("error_message"))


@query("excluded_statements", "WITH " + TXN.strip() + "," + _STATUS_SQL.strip().rstrip(",") +
       "\nSELECT statement, status, 'timed out' AS reason FROM sts WHERE status = 'failed_other'")
def excluded_statements(spark, sf):
    n = statement_rows(spark, sf).groupBy("statement").agg(F.count("*").alias("vendor_count"))
    return X.split_statements(statement_frame(spark, sf).join(n, "statement"))[1]


# --- reports -----------------------------------------------------------------------


@query("transaction_sheet", "WITH " + BASE + f"""
SELECT statement, line_no, date_raw AS date, description AS raw_description,
  CASE WHEN norm_excluded OR NOT include_for_1099 THEN '' ELSE canonical_name END AS canonical_name, {dbl('amount')},
  CASE WHEN norm_excluded OR NOT include_for_1099 THEN 'YES' ELSE 'NO' END AS excluded,
  coalesce(nullif(exclusion_reason, ''), norm_reason) AS exclusion_reason FROM norm""")
def transaction_sheet(spark, sf):
    return P.transaction_sheet(normal(spark, sf)).withColumn("amount", F.col("amount").cast("double"))


def _master_sheet(everything: str, reasons: str) -> str:
    return everything + ",\n" + eligibility("ev", "sv").strip() + f""",
xr AS (SELECT a.statement, a.canonical_name, string_agg(b.statement || ': ' || {dollars('b.total_amount')}, '; ' ORDER BY b.statement) AS cross_reference
  FROM sv a JOIN sv b ON a.canonical_name = b.canonical_name AND a.statement <> b.statement GROUP BY 1, 2)
SELECT canonical_name AS vendor, statement, coalesce(entity_type, 'Individual?') AS entity_type, CAST(total_amount AS DOUBLE) AS total_paid,
  transaction_count AS payments, coalesce(first_payment_date, '') AS first_payment, coalesce(last_payment_date, '') AS last_payment,
  form_type AS form_1099, match_confidence, 1.0::DOUBLE AS extraction_confidence, CASE WHEN reasons IS NULL THEN 'NO' ELSE 'YES' END AS review_needed,
  coalesce(reasons, '') AS review_reasons, coalesce(cross_reference, '') AS cross_reference
FROM ev LEFT JOIN {reasons} USING (statement, canonical_name) LEFT JOIN xr USING (statement, canonical_name)"""


@query("master_vendor_sheet", _master_sheet(_ALL, "rl"))
def master_vendor_sheet(spark, sf):
    c = consolidate(classified(spark, sf), with_variants=False)
    return P.master_vendor_sheet(c.vendors, c.reasons).withColumn("total_paid", F.col("total_paid").cast("double"))


@query("master_vendor_sheet_with_variants", _master_sheet(_ALL_VARIANTS, "rv"))
def master_vendor_sheet_with_variants(spark, sf):
    c = consolidate(classified(spark, sf))
    return P.master_vendor_sheet(c.vendors, c.reasons).withColumn("total_paid", F.col("total_paid").cast("double"))


_POOL = "WITH " + BASE + ",\n" + POOLED.strip() + ",\n" + eligibility("pe", "pv").strip()


@query("pooled_vendor_table", _POOL + f""",
src AS (SELECT canonical_name, count(DISTINCT statement) AS statement_count, string_agg(DISTINCT statement, ', ' ORDER BY statement) AS sources
  FROM norm WHERE NOT norm_excluded AND include_for_1099 GROUP BY 1)
SELECT canonical_name, entity_type, {dbl('total_amount')}, transaction_count, statement_count, sources, form_type, threshold_met,
  needs_review OR form_type = 'REVIEW' AS needs_review, notes FROM pe JOIN src USING (canonical_name)""")
def pooled_vendor_table(spark, sf):
    rows = normal(spark, sf)
    t = P.pooled_vendor_table(V.classify_1099(rollup_of(spark, sf)), V.vendor_sources(rows))
    return t.select("canonical_name", "entity_type", *money("total_amount"), "transaction_count", "statement_count",
                    F.array_join("source_statements", ", ").alias("sources"), "form_type", "threshold_met", "needs_review", "notes")


@query("consolidated_totals", _SV + CROSS.strip() + ",\n" + POOLED.strip() + ",\n" + eligibility("pe", "pv").strip() + """
SELECT count(*) AS vendor_count, CAST(sum(total_amount) AS DOUBLE) AS total_reconciled, count(*) FILTER (WHERE threshold_met) AS over_threshold,
  count(*) FILTER (WHERE form_type <> 'EXEMPT') AS eligible_1099, count(*) FILTER (WHERE needs_review OR form_type = 'REVIEW') AS needs_review,
  (SELECT count(*) FROM cm) AS cross_statement_vendors, (SELECT count(*) FROM cm WHERE crosses) AS combined_only_crossings,
  (SELECT count(*) FROM mm) AS amount_mismatches, (SELECT count(*) FROM nt) AS near_threshold FROM pe""")
def consolidated_totals(spark, sf):
    c = consolidate(classified(spark, sf), with_variants=False)
    t = P.pooled_vendor_table(c.pooled, V.vendor_sources(c.rows))
    return P.consolidated_totals(t, c.matches, c.mismatches, c.near_threshold).withColumn("total_reconciled", F.col("total_reconciled").cast("double"))


@query("consolidated_totals_with_variants", "WITH RECURSIVE" + _SV.removeprefix("WITH") + CROSS.strip() + ",\n" + SIMILAR.strip() + ",\n" + POOLED.strip() + ",\n" + eligibility("pe", "pv").strip() + """
SELECT count(*) AS vendor_count, CAST(sum(total_amount) AS DOUBLE) AS total_reconciled, count(*) FILTER (WHERE threshold_met) AS over_threshold,
  count(*) FILTER (WHERE form_type <> 'EXEMPT') AS eligible_1099, count(*) FILTER (WHERE needs_review OR form_type = 'REVIEW') AS needs_review,
  (SELECT count(*) FROM cm) AS cross_statement_vendors, (SELECT count(*) FROM cm WHERE crosses) AS combined_only_crossings,
  (SELECT count(*) FROM mm) AS amount_mismatches, (SELECT count(*) FROM nt) AS near_threshold,
  (SELECT count(DISTINCT (least(upper(name_a), upper(name_b)), greatest(upper(name_a), upper(name_b)))) FROM va) AS name_variant_flags FROM pe""")
def consolidated_totals_with_variants(spark, sf):
    """All ten counters of a run."""
    c = consolidate(classified(spark, sf))
    t = P.pooled_vendor_table(c.pooled, V.vendor_sources(c.rows))
    totals = P.consolidated_totals(t, c.matches, c.mismatches, c.near_threshold, c.variants)
    return totals.withColumn("total_reconciled", F.col("total_reconciled").cast("double"))


_GOOD_SV = ("WITH " + BASE + "," + _STATUS_SQL.rstrip().rstrip(",") + ",\n" + rollup("sw", ["statement"]).strip() +
            ",\nsv AS (SELECT sw.* FROM sw JOIN sts USING (statement) WHERE status <> 'failed_other'),\n")
_GOOD = _GOOD_SV + CROSS.strip() + ",\n" + FLAGS.strip() + ",\n" + _REASONS.strip()


@query("master_sheet_of_good_statements", _master_sheet(_GOOD, "rl").replace("1.0::DOUBLE AS extraction_confidence", "0.9::DOUBLE AS extraction_confidence"))
def master_sheet_of_good_statements(spark, sf):
    """Failed statements take no part in any finding."""
    c = consolidate(classified(spark, sf), with_variants=False, statements=statement_frame(spark, sf))
    return P.master_vendor_sheet(c.vendors, c.reasons).withColumn("total_paid", F.col("total_paid").cast("double"))


@query("one_statement_findings", "WITH " + BASE + ",\n" + STATEMENT_VENDORS.strip() + """,
one AS (SELECT * FROM sv WHERE statement = (SELECT min(statement) FROM sv))
SELECT count(*) AS vendors, count(*) FILTER (WHERE total_amount BETWEEN 500 AND 700) * (count(DISTINCT statement) - 1) AS near_threshold,
  0::BIGINT AS matches, 0::BIGINT AS mismatches FROM one""")
def one_statement_findings(spark, sf):
    """A run of a single statement: vendors, but nothing to compare, near-threshold totals included."""
    rows = classified(spark, sf)
    c = consolidate(rows.where(F.col("statement") == rows.agg(F.min("statement")).scalar()), with_variants=False)
    n = lambda df, name: df.agg(F.count("*").alias(name)).scalar().alias(name)
    return c.vendors.agg(F.count("*").alias("vendors")).select("vendors", n(c.near_threshold, "near_threshold"), n(c.matches, "matches"), n(c.mismatches, "mismatches"))


@query("written_sheets", _ALL + """
SELECT 'executive_summary' AS sheet, 1::BIGINT AS rows UNION ALL SELECT 'master_vendor_summary', count(*) FROM sv
UNION ALL SELECT 'all_transactions', count(*) FROM norm UNION ALL SELECT 'amount_mismatches', count(*) FROM mm
UNION ALL SELECT 'near_threshold', count(*) FROM nt""")
def written_sheets(spark, sf):
    """The sheets of a run written out, a folder each, and read back."""
    c = consolidate(classified(spark, sf), with_variants=False)
    sheets = {"executive_summary": P.executive_kpis(c.rows, c.vendors, c.reasons), "master_vendor_summary": P.master_vendor_sheet(c.vendors, c.reasons),
              "all_transactions": P.transaction_sheet(c.rows), "amount_mismatches": P.mismatch_sheet(c.mismatches), "near_threshold": P.near_threshold_sheet(c.near_threshold)}
    path = scratch_path(spark, "sheets")
    write_sheets(sheets, path)
    c.close()
    back = [spark.read.parquet(f"{path}/{name}").agg(F.count("*").alias("rows")).select(F.lit(name).alias("sheet"), "rows") for name in sheets]
    return reduce(DataFrame.unionByName, back)


@query("executive_kpis", _ALL + """
SELECT count(DISTINCT canonical_name) AS unique_vendors, CAST(sum(total_amount) AS DOUBLE) AS total_reconciled,
  count(*) FILTER (WHERE total_amount >= 600) AS over_600, (SELECT count(*) FROM norm WHERE NOT norm_excluded AND include_for_1099) AS included_payments,
  (SELECT count(*) FROM rl) AS review_needed FROM sv""")
def executive_kpis(spark, sf):
    c = consolidate(classified(spark, sf), with_variants=False)
    return P.executive_kpis(c.rows, c.vendors, c.reasons).withColumn("total_reconciled", F.col("total_reconciled").cast("double"))


@query("top_vendors", _ALL + ",\n" + eligibility("ev", "sv").strip() + f"""
SELECT canonical_name, coalesce(arg_min(entity_type, statement) FILTER (WHERE entity_type IS NOT NULL), 'Individual?') AS entity_type,
  CAST(sum(total_amount) AS DOUBLE) AS total_amount, CAST(sum(transaction_count) AS BIGINT) AS transaction_count,
  coalesce(arg_min(form_type, statement) FILTER (WHERE form_type <> 'EXEMPT'), 'EXEMPT') AS form_type,
  CASE WHEN count(reasons) > 0 THEN 'YES' ELSE 'NO' END AS review_needed, arg_min(match_confidence, statement) AS match_confidence
FROM ev LEFT JOIN rl USING (statement, canonical_name) GROUP BY 1 ORDER BY sum(total_amount) DESC, min(first_seen) LIMIT 10""")
def top_vendors(spark, sf):
    c = consolidate(classified(spark, sf), with_variants=False)
    return P.top_vendors(c.vendors, c.reasons).drop("first_seen").withColumn("total_amount", F.col("total_amount").cast("double"))


@query("statement_summary", _SV + _STATUS_SQL.strip().rstrip(",") + """,
ag AS (SELECT statement, CAST(sum(transaction_count) AS BIGINT) AS n, count(*) AS v, sum(total_amount) AS t, count(*) FILTER (WHERE total_amount >= 600) AS o,
  count(*) FILTER (WHERE needs_review) AS r FROM sv GROUP BY 1)
SELECT statement, upper(replace(status, '_', ' ')) AS status, CASE WHEN status <> 'failed_other' THEN n ELSE 0 END AS transactions,
  CASE WHEN status <> 'failed_other' THEN v ELSE 0 END AS vendors, CASE WHEN status <> 'failed_other' THEN CAST(t AS DOUBLE) ELSE 0.0 END AS total_reconciled,
  CASE WHEN status <> 'failed_other' THEN o ELSE 0 END AS over_600, CASE WHEN status <> 'failed_other' THEN r ELSE 0 END AS review_needed,
  CASE WHEN status <> 'failed_other' THEN 0.9 ELSE 0.0 END::DOUBLE AS extraction_confidence,
  CASE WHEN status = 'failed_other' THEN 'timed out' ELSE '' END AS notes FROM sts JOIN ag USING (statement)""")
def statement_summary(spark, sf):
    v = rollup_of(spark, sf, "statement")
    return P.statement_summary(statement_frame(spark, sf), v).withColumn("total_reconciled", F.col("total_reconciled").cast("double"))


@query("validation_match_sheet", _SV + CROSS.strip() + f"""
SELECT canonical_name AS vendor, string_agg(statement, ', ' ORDER BY statement) AS statements, CAST(any_value(combined_total) AS DOUBLE) AS combined_total,
  CASE WHEN any_value(crosses) THEN 'YES — flag for filing' ELSE 'no' END AS crosses_600_combined_only,
  string_agg(statement || ': ' || {dollars('total_amount')}, '; ' ORDER BY statement) AS breakdown FROM cm JOIN sv USING (canonical_name) GROUP BY 1""")
def validation_match_sheet(spark, sf):
    v = X.enough_statements(rolled(spark, sf))
    m = X.cross_matches(v)
    return P.match_sheet(m, X.appearances(v, m)).withColumn("combined_total", F.col("combined_total").cast("double"))


@query("validation_mismatch_sheet", _SV + CROSS.strip() + f"\nSELECT canonical_name AS vendor, statement_a, {dbl('amount_a')}, statement_b, {dbl('amount_b')}, format('{{:.1f}}', ratio) || 'x' AS variance FROM mm")
def validation_mismatch_sheet(spark, sf):
    s = P.mismatch_sheet(X.amount_mismatches(X.enough_statements(rolled(spark, sf))))
    return s.withColumns({c: F.col(c).cast("double") for c in ("amount_a", "amount_b")})


@query("validation_near_threshold_sheet", _SV + CROSS.strip() + f"""
SELECT canonical_name AS vendor, statement AS source, CAST(total_amount AS DOUBLE) AS total,
  CASE WHEN 600 - total_amount < 0 THEN '+' ELSE '-' END || {dollars('abs(600 - total_amount)')} AS distance_to_600 FROM nt""")
def validation_near_threshold_sheet(spark, sf):
    v = X.enough_statements(rolled(spark, sf))
    return P.near_threshold_sheet(X.near_threshold_vendors(v, X.cross_matches(v))).withColumn("total", F.col("total").cast("double"))


@query("resolved_labels", "WITH " + TXN.strip() + """
SELECT line_no, CASE WHEN CAST(substr(statement, 6) AS INTEGER) % 2 = 0 THEN statement || '_bank.pdf' ELSE md5(statement) || '.pdf' END AS label,
  'see ' || CASE WHEN CAST(substr(statement, 6) AS INTEGER) % 2 = 0 THEN statement || '_bank.pdf' ELSE md5(statement) || '.pdf' END || ' and ' ||
  CASE WHEN CAST(substr(statement, 6) AS INTEGER) % 2 = 0 THEN statement || '_bank.pdf' ELSE md5(statement) END || '.' AS note FROM tx""")
def resolved_labels(spark, sf):
    """Statement ids in a column and inside text; half of the ids have a known file name."""
    rows = statement_rows(spark, sf)
    even = F.substring("statement", 6, 4).cast("int") % 2 == 0
    names = rows.select("statement").distinct().where(even).select(
        F.md5("statement").alias("id"), F.concat(F.col("statement"), F.lit("_bank.pdf")).alias("file_name"))
    raw = rows.select("line_no", F.concat(F.md5("statement"), F.lit(".pdf")).alias("label"),
                      F.concat(F.lit("see "), F.md5("statement"), F.lit(".pdf and "), F.md5("statement"), F.lit(".")).alias("note"))
    return P.resolve_in_text(P.resolve_labels(raw, "label", names), ["line_no"], "note", names)
