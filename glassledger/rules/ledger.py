"""Fixed values of the ledger review: labels, limits and standards texts."""
from __future__ import annotations

REQUIRED_COLUMNS = ["date", "amount", "account_name", "vendor", "description", "journal_ref"]
OPTIONAL_COLUMNS = [
    "account_code", "debit_amount", "credit_amount", "dr_cr_pattern",
    "department", "location", "preparer", "approver",
]

APPROVAL_LIMITS = [5000, 10000, 25000]
NEAR_LIMIT_SHARE = 0.95
RARE_VENDOR_ROWS = 3
UNUSUAL_Z = 2.0

# fixed values: the five yes/no signals, in display order, with their labels
FLAG_LABELS = {
    "is_round_number": "Round number amount",
    "is_weekend_posting": "Weekend posting",
    "missing_description": "Missing description",
    "is_new_vendor": "New vendor",
    "is_near_approval_threshold": "Near approval threshold",
}
Z_COLUMN = "amount_zscore_by_account"
Z_LABEL = "Unusual amount for account"
NO_FLAG_LABEL = "Statistical anomaly only"
FEATURES = [Z_COLUMN, *FLAG_LABELS]

# fixed values: tiers from mildest to gravest
TIERS = ["Monitor", "Low", "Medium", "High"]

# fixed values: tier -> report label
TIER_LABELS = {
    "High": "Potential Material Weakness Indicator",
    "Medium": "Potential Significant Deficiency",
    "Low": "Monitor — Below Escalation Threshold",
    "Monitor": "Monitor — Below Escalation Threshold",
}

# fixed values: sensitivity name -> share of rows taken as anomalous
SENSITIVITY = {
    "Conservative (0.03)": 0.03,
    "Balanced (0.05)": 0.05,
    "Aggressive (0.10)": 0.10,
}
DEFAULT_SENSITIVITY = "Balanced (0.05)"
MEDIUM_BAND = 3.0
MEDIUM_CEILING = 0.95

# fixed values: signal -> (standard, rationale, evidence to ask for)
ANCHORS = {
    "amount_zscore_by_account": (
        "AU-C 315 (analytical review procedures)",
        "the amount is far from what is normal for this specific account — an analytical-review outlier",
        "the supporting documentation explaining why this account carries an amount of this size",
    ),
    "is_round_number": (
        "PCAOB AS 2401 (fraud risk factors)",
        "a clean, cents-free figure more often reflects a manual entry, estimate, or placeholder than an invoice-driven amount",
        "the underlying invoice or calculation that produced the exact figure",
    ),
    "is_weekend_posting": (
        "COSO — Control Activities",
        "a posting dated outside normal business days is an unusual-timing indicator",
        "confirmation of who posted it and why it was recorded on a non-business day",
    ),
    "missing_description": (
        "COSO — Information & Communication",
        "an entry with no memo is a documentation control gap",
        "the business purpose and supporting narrative for the entry",
    ),
    "is_new_vendor": (
        "PCAOB AS 2401 (fraud risk factors — misappropriation opportunity)",
        "a rare or first-time payee is where misappropriation opportunity tends to concentrate",
        "vendor onboarding records — W-9, approval, and validation of the payee",
    ),
    "is_near_approval_threshold": (
        "IT / limit controls (invoice-splitting tests)",
        "an amount sitting just under an approval limit can indicate structuring to avoid a higher approval tier",
        "the approval trail and any related transactions to the same payee near the same date",
    ),
}

# fixed values: phrases a memo must never hold
BANNED_PHRASES = [
    "fraud occurred", "this is fraudulent", "this is fraud", "this proves fraud",
    "proves fraud", "confirms fraud", "confirmed misstatement",
    "confirms a material weakness", "confirms a significant deficiency",
    "the vendor is suspicious", "the perpetrator", "management committed fraud",
    "employee committed fraud", "definitively", "the transaction is fake",
    "this is a pcaob violation", "the employee stole", "the manager stole",
]

# fixed values: columns of the exported queue, in order
QUEUE_COLUMNS = [
    "date", "account_code", "account_name", "vendor", "description",
    "journal_ref", "amount", "abs_amount", "final_tier", "pcaob_label",
    "active_flags", "materiality_annotation", "anomaly_score", "raw_tier",
    "fraud_flag_count", "is_qualitative_override", "qualitative_override_note",
]
