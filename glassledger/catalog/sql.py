"""SQL texts that restate the derived frames for the side-by-side check."""
from __future__ import annotations

import re

from ..functions.text import one_of, title
from ..operators.vendor_names import LEADING_REGEX, reason_of, suffix_regex
from ..rules import eligibility as E
from ..rules import ledger as L
from ..rules import statements as S
from ..rules import vendors as V


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def with_(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes) + "\n" + body


def dollars(x: str) -> str:
    return f"('$' || format('{{:,.2f}}', CAST({x} AS DOUBLE)))"


def percent(x: str) -> str:
    return f"(CAST(CAST(round_even({x} * 100, 0) AS INTEGER) AS VARCHAR) || '%')"


def concat_nonempty(sep: str, parts: list[str]) -> str:
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), {q(sep)})"


# --- ledger ---------------------------------------------------------------------

GL = """
gl AS (
  SELECT l_shipdate AS date,
         CASE WHEN l_linenumber = 7 THEN round(l_extendedprice, -2) ELSE l_extendedprice END AS amount,
         p_type AS account_name, p_brand AS account_code,
         s_name || '-' || CAST(l_partkey % 200 AS VARCHAR) AS vendor,
         CASE WHEN NOT (l_returnflag = 'R' AND l_linenumber = 1) THEN p_name END AS description,
         CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS journal_ref,
         CASE WHEN l_linestatus = 'F' THEN l_extendedprice ELSE 0.0 END AS debit_amount,
         CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE 0.0 END AS credit_amount
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)
"""

SIG = """
acct AS (SELECT account_name, avg(abs(amount)) AS m, stddev_pop(abs(amount)) AS s FROM gl GROUP BY 1),
vend AS (SELECT vendor, count(*) AS vendor_txn_count FROM gl GROUP BY 1),
sig0 AS (
  SELECT gl.*, abs(amount) AS abs_amount, vendor_txn_count,
         CASE WHEN coalesce(s, 0) = 0 THEN 0.0 ELSE (abs(amount) - m) / s END AS z,
         CASE WHEN abs(amount) % 100 = 0 THEN 1 ELSE 0 END AS is_round_number,
         CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend_posting,
         CASE WHEN description IS NULL OR trim(description) = '' OR lower(trim(description)) = 'nan' THEN 1 ELSE 0 END AS missing_description,
         CASE WHEN vendor_txn_count < 3 THEN 1 ELSE 0 END AS is_new_vendor,
         CASE WHEN (abs(amount) >= 4750 AND abs(amount) < 5000) OR (abs(amount) >= 9500 AND abs(amount) < 10000)
                OR (abs(amount) >= 23750 AND abs(amount) < 25000) THEN 1 ELSE 0 END AS is_near_approval_threshold
  FROM gl LEFT JOIN acct USING (account_name) LEFT JOIN vend USING (vendor)),
sig AS (
  SELECT *, missing_description + is_weekend_posting AS control_gap_score,
         is_round_number + is_weekend_posting + missing_description + is_new_vendor + is_near_approval_threshold AS fraud_flag_count
  FROM sig0)
"""

_FLAG_TEXT = concat_nonempty(
    "; ",
    [f"CASE WHEN abs(z) >= 2 THEN {q(L.Z_LABEL)} END"]
    + [f"CASE WHEN {c} = 1 THEN {q(t)} END" for c, t in L.FLAG_LABELS.items()],
)


def scored_sql(performance: float, transaction: float, share: float = 0.05) -> str:
    """Signals, the stand-in score -|z|, tiers, cascade and override."""
    return f"""
{GL.strip()},
{SIG.strip()},
sc AS (SELECT *, round(0.0 - abs(z), 6) AS anomaly_score FROM sig),
cuts AS (SELECT quantile_cont(anomaly_score, {share}) AS hi, quantile_cont(anomaly_score, {min(share * 4, 0.95)}) AS md FROM sc),
tiered AS (
  SELECT sc.*, CASE WHEN anomaly_score <= hi THEN 3 WHEN anomaly_score <= md THEN 2 ELSE 1 END AS rt FROM sc, cuts),
casc AS (
  SELECT *, CASE WHEN abs_amount >= {transaction} THEN rt WHEN abs_amount >= {performance} THEN rt - 1 ELSE 0 END AS ct,
         least(rt + 1, 3) AS up FROM tiered),
fin AS (
  SELECT *, CASE WHEN fraud_flag_count >= 2 AND up > ct THEN 1 ELSE 0 END AS is_qualitative_override,
         CASE WHEN fraud_flag_count >= 2 AND up > ct THEN up ELSE ct END AS ft FROM casc),
nm AS (SELECT ['Monitor', 'Low', 'Medium', 'High'] AS t),
scored AS (
  SELECT fin.*, t[rt + 1] AS raw_tier, t[ft + 1] AS final_tier,
         CASE WHEN fraud_flag_count >= 2 THEN 1 ELSE 0 END AS fraud_risk_flag,
         CASE WHEN abs_amount >= {transaction} THEN 'Exceeds Transaction Materiality'
              WHEN abs_amount >= {performance} THEN 'Below Transaction Materiality'
              ELSE 'Below Performance Materiality' END AS materiality_annotation,
         coalesce(nullif({_FLAG_TEXT}, ''), {q(L.NO_FLAG_LABEL)}) AS active_flags,
         CASE WHEN is_qualitative_override = 1 THEN 'Escalated to ' || t[up + 1] || ': ' || CAST(fraud_flag_count AS VARCHAR) ||
              ' indicators co-occur (qualitative materiality). Raw tier ' || t[rt + 1] || '; materiality alone would assign ' || t[ct + 1] || '.'
              ELSE '' END AS qualitative_override_note,
         CASE ft WHEN 3 THEN {q(L.TIER_LABELS['High'])} WHEN 2 THEN {q(L.TIER_LABELS['Medium'])} ELSE {q(L.TIER_LABELS['Low'])} END AS pcaob_label,
         CASE WHEN ft >= 2 THEN 'Flagged' ELSE 'Not flagged' END AS flagged_status
  FROM fin, nm)
"""


# --- statements -------------------------------------------------------------------

TXN = """
named AS (SELECT p_partkey, upper(p_name || ' ' || p_type) AS nm FROM part),
txn AS (
  SELECT 'stmt_' || CAST(year(o_orderdate) AS VARCHAR) AS statement, o_orderkey AS line_no,
         strftime(o_orderdate, '%m/%d/%Y') AS date_raw, CAST(o_orderdate AS DATE) AS paid_on,
         CASE (o_orderkey // 7) % 10
           WHEN 0 THEN 'ACH Payment - ' || nm || ' LLC'
           WHEN 1 THEN 'Check ' || CAST(o_orderkey AS VARCHAR) || ' - ' || nm
           WHEN 2 THEN 'Check #' || CAST(o_orderkey AS VARCHAR)
           WHEN 3 THEN 'PAYROLL DIRECT DEP'
           WHEN 4 THEN 'TRANSFER TO SAVINGS'
           WHEN 5 THEN 'OPENING BALANCE'
           WHEN 6 THEN 'Debit Card - ' || nm || ' INC'
           WHEN 7 THEN 'MONTHLY FEE'
           WHEN 8 THEN 'INTEREST EARNED'
           ELSE nm || ' LAW GROUP' END AS description,
         CAST(CAST(round(o_totalprice * 100) AS BIGINT) // 1000 AS DECIMAL(18,2)) / 100 AS amount_x
  FROM orders JOIN named ON p_partkey = o_orderkey % (SELECT count(*) FROM part)),
tx AS (SELECT * EXCLUDE (amount_x), CAST(amount_x AS DECIMAL(18,2)) AS amount FROM txn)
"""


def _any(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(w)})" for w in words) + ")"


def _first_title(col: str, words: list[str], text: str) -> str:
    whens = " ".join(f"WHEN contains({col}, {q(w)}) THEN {q(text.format(title(w)))}" for w in words)
    return f"CASE {whens} END"


_FAM = [("balance", S.BALANCE), ("metadata", S.METADATA), ("payroll", S.PAYROLL), ("transfer", S.TRANSFER),
        ("interest", S.INTEREST), ("deposit", S.DEPOSIT), ("fee", S.FEE)]
_D = "upper(trim(description))"
_CHECK = "(" + " OR ".join(f"starts_with({_D}, {q(p)})" for p in S.CHECK_STARTS) + rf" OR regexp_matches({_D}, '^\s*CHECK\s+\d+\b'))"
_REST = f"trim(regexp_replace(trim(regexp_replace({_D}, {q(S.CHECK_NUMBER)}, '')), '[\\d,$.]+\\s*$', ''))"

CLASSIFIED = f"""
c0 AS (
  SELECT tx.*, CASE WHEN description = '' THEN 'unknown'
    {" ".join(f"WHEN {_any(_D, w)} THEN '{k}'" for k, w in _FAM)}
    WHEN {_CHECK} THEN CASE WHEN regexp_matches({_REST}, '[A-Za-z]{{3,}}') THEN 'check' ELSE 'check_unverified' END
    WHEN amount > 0 THEN 'vendor_payment' ELSE 'unknown' END AS transaction_type FROM tx),
cl AS (
  SELECT *, transaction_type IN ('check', 'vendor_payment') AS include_for_1099,
         transaction_type IN ('check', 'check_unverified', 'unknown') AS review_required,
         CASE transaction_type
           {" ".join(f"WHEN '{k}' THEN " + (_first_title(_D, w, S.REASONS[k]) if '{}' in S.REASONS[k] else q(S.REASONS[k])) for k, w in _FAM)}
           WHEN 'check_unverified' THEN {q(S.REASONS['check_unverified'])}
           WHEN 'unknown' THEN {q(S.REASONS['unknown'])} ELSE '' END AS exclusion_reason
  FROM c0)
"""


def _noise(col: str, patterns) -> str:
    for p in patterns:
        col = f"regexp_replace({col}, {q(p)}, ' ', 'g')"
    return col


def title_case(col: str, keep) -> str:
    words = ", ".join(q(w) for w in keep)
    return (
        f"array_to_string(list_transform(list_filter(regexp_split_to_array({col}, '\\s+'), lambda w: w <> ''), "
        f"lambda w: CASE WHEN upper(w) IN ({words}) THEN upper(w) ELSE upper(w[1:1]) || lower(w[2:]) END), ' ')"
    )


def _normal(src: str, raw: str, noise, suffixes: str, keep, exclude: bool, listed: str = "") -> str:
    reasons = " ".join(f"WHEN regexp_matches(raw_name, {q('(?i)' + p)}) THEN {q(reason_of(p))}" for p in V.NON_VENDOR)
    reason = f"CASE WHEN regexp_matches(trim(raw_name), {q(V.EMBEDDED_AMOUNT)}) THEN 'embedded_amount' {reasons} ELSE '' END" if exclude else "''"
    return f"""
n0 AS (SELECT *, {raw} AS raw_name FROM {src}),
n1 AS (SELECT *, {reason} AS norm_reason,
         trim(regexp_replace({_noise('upper(trim(raw_name))', noise)}, '\\s+', ' ', 'g')) AS cleaned0 FROM n0),
n2 AS (SELECT *, nullif(replace(regexp_extract(cleaned0, {q(suffixes)}, 1), '.', ''), '') AS ent0,
         CASE WHEN regexp_matches(cleaned0, {q(suffixes)})
              THEN trim(regexp_replace(trim(regexp_replace(cleaned0, {q(suffixes)}, '')), ',+$', '')) ELSE cleaned0 END AS bare FROM n1),
{listed.strip() or "n3 AS (SELECT *, NULL AS found, 1.0 AS score, 1.0 AS shown FROM n2)"},
norm AS (
  SELECT *, norm_reason <> '' AS norm_excluded,
    CASE WHEN norm_reason <> '' THEN raw_name ELSE cleaned0 END AS cleaned_name,
    CASE WHEN norm_reason <> '' THEN '[EXCLUDED] ' || substr(raw_name, 1, 50)
         WHEN length(bare) < 3 OR regexp_matches(bare, '^\\d+$') THEN 'UNRESOLVED: ' || raw_name
         ELSE coalesce(found, {title_case('bare', keep)}) END AS canonical_name,
    CASE WHEN norm_reason = '' THEN ent0 END AS entity_type,
    CASE WHEN norm_reason <> '' THEN 0.0 ELSE shown END AS match_confidence,
    norm_reason = '' AND (length(bare) < 3 OR regexp_matches(bare, '^\\d+$') OR score < {V.REVIEW_THRESHOLD}) AS needs_review
  FROM n3)
"""


_PRE = f"trim(regexp_replace(trim(description), {q(LEADING_REGEX)}, ''))"
PRECLEAN = f"CASE WHEN {_PRE} = '' THEN description ELSE {_PRE} END"
NORM = _normal("cl", PRECLEAN, V.NOISE, suffix_regex(), V.KEEP_UPPER, True)


def worksheet_norm() -> str:
    from ..operators.vendor_names import WORKSHEET

    return _normal("tx", "description", V.WORKSHEET_NOISE, suffix_regex(WORKSHEET), V.WORKSHEET_KEEP_UPPER, False)


def rollup(name: str, keys: list[str], gated: bool = True, src: str = "norm") -> str:
    k = "".join(f"{c}, " for c in keys)
    where = "WHERE NOT norm_excluded AND include_for_1099" if gated else ""
    row_review = "bool_or(review_required)" if gated else "false"
    return f"""
{name}0 AS (
  SELECT {k}canonical_name, arg_min(entity_type, (statement, line_no)) FILTER (WHERE entity_type IS NOT NULL) AS entity_type,
    CAST(sum(amount) AS DECIMAL(18,2)) AS total_amount, count(*) AS transaction_count,
    min(date_raw) AS first_payment_date, max(date_raw) AS last_payment_date,
    min(paid_on) AS first_paid_on, max(paid_on) AS last_paid_on, count(DISTINCT raw_name) AS variant_count,
    list_sort(list(DISTINCT raw_name)) AS variants,
    min(match_confidence) AS match_confidence, bool_or(needs_review) AS nr, {row_review} AS rr, min((statement, line_no)) AS first_seen
  FROM {src} {where} GROUP BY {k}canonical_name),
{name} AS (
  SELECT *, nr OR rr AS needs_review,
    {concat_nonempty('; ', ["CASE WHEN nr THEN 'Low vendor name match confidence' END",
      "CASE WHEN variant_count > 1 AND match_confidence < 0.9 THEN 'Multiple raw name variants grouped together (' || CAST(variant_count AS VARCHAR) || ')' END",
      "CASE WHEN rr THEN 'Contains transactions flagged for review by classifier (e.g. check payment with payee that should be verified)' END"])} AS reasons_text
  FROM {name}0)
"""


_ELIG = [("government", E.GOVERNMENT), ("financial", E.FINANCIAL), ("shipping", E.SHIPPING), ("attorney", E.ATTORNEY),
         ("medical", E.MEDICAL), ("cloud", E.CLOUD), ("meals", E.MEALS_AND_RIDES), ("merchandise", E.MERCHANDISE),
         ("utility", E.UTILITY), ("staffing", E.STAFFING)]


def eligibility(name: str, src: str) -> str:
    whens = []
    for fam, words in _ELIG:
        hit = f"regexp_matches(upper(canonical_name), {q(one_of(words))})"
        if fam in ("medical", "cloud", "staffing"):
            whens.append(f"WHEN {hit} AND corp THEN '{fam}_corp'")
        whens.append(f"WHEN {hit} THEN '{fam}'")
    paid = dollars("total_amount")
    note = {
        "below": f"'No 1099 required. Total paid ' || {paid} || ' < $600 threshold.'",
        "attorney": f"'File 1099-NEC for ' || {paid} || '. Attorney and legal fees require 1099 filing regardless of corporate status. Obtain W-9 if not on file.'",
        "corporation": "canonical_name || ' is incorporated (' || ent || '). Corporations are generally exempt from 1099-NEC reporting.'",
        "review": f"'Likely requires 1099-NEC for ' || {paid} || ' but needs human review: ' || "
                  "CASE WHEN ent = '' THEN 'entity type unknown — could not determine if individual or corporation' ELSE '' END || "
                  "'. Obtain W-9 and confirm entity type before filing.'",
        "known": f"'File 1099-NEC for ' || {paid} || '. ' || canonical_name || ' is a ' || "
                 f"CASE ent {' '.join(f'WHEN {q(k)} THEN {q(v)}' for k, v in E.ENTITY_WORDING.items())} ELSE ent END || "
                 "', subject to 1099-NEC for service payments. Obtain W-9 if not already on file.'",
        "utility": "canonical_name || ' is a utility or telephone provider. These are generally exempt from 1099-NEC reporting.'",
        "merchandise": "canonical_name || ' is a retail or merchandise vendor. 1099-NEC applies to services, not goods purchases.'",
    }
    return f"""
{name}0e AS (SELECT *, coalesce(entity_type, '') AS ent, coalesce(entity_type, '') IN ('INC', 'CORP', 'NA', 'FSB') AS corp FROM {src}),
{name}1e AS (
  SELECT *, CASE WHEN total_amount < 600 THEN 'below' {' '.join(whens)} WHEN corp THEN 'corporation'
    WHEN ent = '' OR match_confidence < 0.80 THEN 'review' ELSE 'known' END AS rule FROM {name}0e),
{name} AS (
  SELECT *, CASE WHEN rule IN ('attorney', 'medical', 'cloud', 'staffing', 'known') THEN '1099-NEC'
      WHEN rule = 'medical_corp' THEN '1099-MISC' WHEN rule = 'review' THEN 'REVIEW' ELSE 'EXEMPT' END AS form_type,
    rule <> 'below' AS threshold_met, CASE rule {' '.join(f"WHEN '{k}' THEN {v}" for k, v in note.items())} END AS notes
  FROM {name}1e)
"""


STATEMENT_VENDORS = rollup("sv", ["statement"])
POOLED = rollup("pv", [])
BASE = f"{TXN.strip()},\n{CLASSIFIED.strip()},\n{NORM.strip()}"

FLAGS = f"""
fl AS (
  SELECT statement, canonical_name, total_amount, entity_type, match_confidence, needs_review,
    CASE WHEN match_confidence < 0.80 THEN 'Low name-match confidence (' || {percent('match_confidence')} || ') — verify this is the correct payee' END AS r1,
    CASE WHEN total_amount BETWEEN 500 AND 700 THEN 'Near-threshold (' || {dollars('total_amount')} || ') — ' ||
      CASE WHEN total_amount < 600 THEN 'may cross $600 with one more payment' ELSE 'verify all payments captured before filing' END END AS r2,
    CASE WHEN total_amount >= 600 AND coalesce(entity_type, '') = '' THEN 'Entity type unknown — verify LLC/Corp/Individual via W-9 before filing decision' END AS r3,
    reasons_text FROM sv),
fl2 AS (SELECT *, CASE WHEN r1 IS NULL AND r2 IS NULL AND r3 IS NULL AND needs_review THEN
    CASE WHEN reasons_text <> '' THEN 'Flagged during normalization — ' || reasons_text ELSE 'Flagged during normalization' END END AS r4 FROM fl)
"""

CROSS = """
cm AS (
  SELECT canonical_name, count(*) AS statement_count, CAST(sum(total_amount) AS DECIMAL(18,2)) AS combined_total,
    CAST(sum(transaction_count) AS BIGINT) AS transaction_count,
    sum(total_amount) >= 600 AND max(total_amount) < 600 AS crosses FROM sv GROUP BY 1 HAVING count(*) > 1),
mm AS (
  SELECT a.canonical_name, a.statement AS statement_a, a.total_amount AS amount_a, b.statement AS statement_b, b.total_amount AS amount_b,
    CAST(greatest(a.total_amount, b.total_amount) AS DOUBLE) / CAST(least(a.total_amount, b.total_amount) AS DOUBLE) AS ratio,
    abs(a.total_amount - b.total_amount) AS abs_diff
  FROM sv a JOIN sv b ON a.canonical_name = b.canonical_name AND a.statement < b.statement
  WHERE a.total_amount > 0 AND b.total_amount > 0
    AND CAST(greatest(a.total_amount, b.total_amount) AS DOUBLE) / CAST(least(a.total_amount, b.total_amount) AS DOUBLE) > 5
    AND abs(a.total_amount - b.total_amount) > 500),
nt AS (
  SELECT canonical_name, combined_total AS total_amount, 'Combined' AS statement FROM cm WHERE combined_total BETWEEN 500 AND 700
  UNION ALL
  SELECT canonical_name, total_amount, statement FROM sv
  WHERE total_amount BETWEEN 500 AND 700 AND canonical_name NOT IN (SELECT canonical_name FROM cm))
"""


# --- similarity of names ------------------------------------------------------------

# the longest common block of a and b as length * 1000 + 999 - start in a; the earliest wins equal lengths
_BLOCK = """coalesce(list_max(list_transform(range(1, length(a) + 1), lambda i: list_max(list_transform(range(1, length(a) - i + 2),
    lambda l: CASE WHEN contains(b, substr(a, i, l)) THEN l * 1000 + 999 - i ELSE 0 END)))), 0)"""


def common_characters(a: str, b: str) -> str:
    """How many characters two texts share, each as often as both have it."""
    return (f"coalesce(list_sum(list_transform(list_distinct(string_split({a}, '')), "
            f"lambda c: least(length({a}) - length(replace({a}, c, '')), length({b}) - length(replace({b}, c, ''))))), 0)")


def ratios(pairs: str) -> str:
    """``ratio`` (id, ratio) of the rows (id, a, b) of ``pairs``: matching blocks, the longest first, then left and right of it. For WITH RECURSIVE."""
    return f"""
blocks(id, a, b, k) AS (
  SELECT id, a, b, {_BLOCK} FROM {pairs} UNION ALL
  SELECT id, a, b, {_BLOCK} FROM (
    SELECT id, unnest([substr(a, 1, i - 1), substr(a, i + l)]) AS a, unnest([substr(b, 1, j - 1), substr(b, j + l)]) AS b FROM (
      SELECT *, strpos(b, substr(a, i, l)) AS j FROM (SELECT *, k // 1000 AS l, 999 - k % 1000 AS i FROM blocks WHERE k > 0))) WHERE a <> '' AND b <> ''),
matched AS (SELECT id, sum(k // 1000) AS m FROM blocks GROUP BY id),
ratio AS (SELECT id, CASE WHEN length(a) + length(b) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * CAST(m AS DOUBLE) / (length(a) + length(b)) END AS ratio
  FROM {pairs} JOIN matched USING (id))
"""


SIMILAR = f"""
nm AS (SELECT DISTINCT canonical_name AS n FROM sv WHERE canonical_name <> ''),
np AS (SELECT row_number() OVER () AS id, * FROM (SELECT x.n AS name_a, y.n AS name_b, upper(x.n) AS a, upper(y.n) AS b FROM nm x JOIN nm y ON x.n <> y.n)
  WHERE 2 * {common_characters('a', 'b')} >= {V.VARIANT_THRESHOLD} * (length(a) + length(b)) - 1e-9),
{ratios('np').strip()},
similar_names AS (SELECT name_a, name_b, ratio AS similarity FROM np JOIN ratio USING (id) WHERE ratio >= {V.VARIANT_THRESHOLD}),
vr AS (SELECT *, row_number() OVER (PARTITION BY statement ORDER BY total_amount DESC, first_seen) AS rank_no FROM sv),
va AS (SELECT s.*, a.statement AS statement_a, b.statement AS statement_b, a.total_amount AS amount_a, b.total_amount AS amount_b, a.rank_no AS rank_a, b.rank_no AS rank_b
  FROM similar_names s JOIN vr a ON a.canonical_name = name_a JOIN vr b ON b.canonical_name = name_b WHERE a.statement < b.statement)
"""


# names matched to the vendor list ``vl`` (pos, name), an entry's name without a suffix; of entries that a bound leaves, the best
_PREFIX = "list_max(list_transform(range(0, least(length(a), length(b)) + 1), lambda k: CASE WHEN substr(a, 1, k) = substr(b, 1, k) THEN k ELSE 0 END))"
MATCHED_NORM = _normal("cl", PRECLEAN, V.NOISE, suffix_regex(), V.KEEP_UPPER, True, f"""
mb AS (SELECT DISTINCT bare AS a FROM n2 WHERE norm_reason = ''),
me AS (SELECT upper(name) AS b, min(pos) AS pos, arg_min(name, pos) AS name FROM vl GROUP BY 1),
mc AS (SELECT a, b, 2.0 * {common_characters('a', 'b')} / (length(a) + length(b)) AS most, 2.0 * {_PREFIX} / (length(a) + length(b)) AS least_ratio FROM mb, me),
mp AS (SELECT row_number() OVER () AS id, a, b FROM (SELECT *, max(least_ratio) OVER (PARTITION BY a) AS floor_ratio FROM mc) WHERE most >= floor_ratio - 1e-9),
{ratios('mp').strip()},
mr AS (SELECT a, name AS near, ratio AS near_score, row_number() OVER (PARTITION BY a ORDER BY ratio DESC, pos) AS k FROM mp JOIN ratio USING (id) JOIN me USING (b)),
n3 AS (SELECT n2.*, CASE WHEN near_score >= {V.MATCH_THRESHOLD} THEN near END AS found, coalesce(near_score, 0.0) AS score,
         CAST(format('{{:.2f}}', coalesce(near_score, 0.0)) AS DOUBLE) AS shown FROM n2 LEFT JOIN mr ON a = bare AND k = 1)
""")
KNOWN_TYPES = ("ECONOMY", "PROMO", "LARGE")
VENDOR_LIST = f"""
vl AS (SELECT min(p_partkey) AS pos, array_to_string(list_transform(string_split(p_name || ' ' || p_type, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS name
  FROM part WHERE p_type IN ({", ".join(q(t) for t in KNOWN_TYPES)}) GROUP BY 2)
"""
MATCHED_BASE = f"{TXN.strip()},\n{CLASSIFIED.strip()},\n{VENDOR_LIST.strip()},\n{MATCHED_NORM.strip()}"


# --- text splitter -------------------------------------------------------------------

_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def bare(x: str) -> str:
    return f"trim({x}, {_BLANKS})"


def _refined(src: str, dst: str, cut: str, size: int) -> str:
    """Atoms over ``size`` give way to their parts; ``cut`` makes a list of the text ``a.text``."""
    return f"""{dst} AS (SELECT doc_id, page, flatten(list_transform(atoms, lambda a, i: CASE WHEN length(a.text) > {size}
    THEN list_transform(list_filter({cut}, lambda p: p <> ''), lambda p: {{'run': a.run || '.' || CAST(i AS VARCHAR), 'text': p}}) ELSE [a] END)) AS atoms FROM {src})"""


def split_text(pages: str, separators, size: int, overlap: int) -> str:
    """``chunks`` (doc_id, page, chunk_no, text) of the rows (doc_id, page, text) of ``pages``. For WITH RECURSIVE.

    Atoms get prefix sums of their lengths; the next cut after an atom is then looked up, so that only cuts are walked through.
    """
    steps, src = [f"at0 AS (SELECT doc_id, page, [{{'run': '0', 'text': coalesce(text, '')}}] AS atoms FROM {pages})"], "at0"
    for k, separator in enumerate(separators, 1):
        pattern = "'(?s).*?(?:" + separator.replace(".", "[.]").replace("\n", "\\n") + "|\\z)'"
        steps.append(_refined(src, f"at{k}", f"regexp_extract_all(a.text, {pattern})", size))
        src = f"at{k}"
    steps.append(_refined(src, "atb", f"list_transform(range(1, length(a.text) + 1, {size}), lambda b: substr(a.text, b, {size}))", size))
    return ",\n".join(steps) + f""",
ua AS (SELECT doc_id, page, unnest(atoms, recursive := true), generate_subscripts(atoms, 1) AS k FROM atb),
ul AS (SELECT *, CASE WHEN run = lag(run) OVER w THEN 0 ELSE 1 END AS new_run, sum(length(text)) OVER w AS until FROM ua WINDOW w AS (PARTITION BY doc_id, page ORDER BY k)),
us AS (SELECT *, sum(new_run) OVER (PARTITION BY doc_id, page ORDER BY k) AS seg, until - length(text) AS since FROM ul),
nx AS (SELECT a.doc_id, a.page, a.k, max(b.k) + 1 AS after FROM us a JOIN us b
  ON a.doc_id = b.doc_id AND a.page = b.page AND a.seg = b.seg AND b.k >= a.k AND b.until <= a.since + {size} GROUP BY ALL),
starts AS (SELECT doc_id, page, k, after FROM nx WHERE k = 1 UNION ALL
  SELECT nx.doc_id, nx.page, nx.k, nx.after FROM starts JOIN nx ON nx.doc_id = starts.doc_id AND nx.page = starts.page AND nx.k = starts.after),
filled AS (SELECT s.doc_id, s.page, s.k, {bare("string_agg(text, '' ORDER BY us.k)")} AS text
  FROM starts s JOIN us ON us.doc_id = s.doc_id AND us.page = s.page AND us.k >= s.k AND us.k < s.after GROUP BY ALL),
numbered AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY k) AS chunk_no, text FROM filled WHERE text <> ''),
chunks AS (SELECT * FROM numbered WHERE chunk_no = 1 UNION ALL
  SELECT n.doc_id, n.page, n.chunk_no, {bare(f"right(c.text, {overlap}) || ' ' || n.text")}
  FROM chunks c JOIN numbered n ON n.doc_id = c.doc_id AND n.page = c.page AND n.chunk_no = c.chunk_no + 1)
"""
