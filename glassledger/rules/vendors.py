"""Fixed values for turning statement descriptions into vendor names."""
from __future__ import annotations

# fixed value: leading descriptors, dropped only before a separator
LEADING_DESCRIPTORS = (
    r"ach\s+(?:payment|debit|credit|transfer)|"
    r"check\s*#?\s*\d*|"
    r"debit\s+card|"
    r"credit\s+card|"
    r"card|"
    r"customer\s+deposit(?:\s*-\s*invoice\s*\d*)?|"
    r"online\s+(?:bill\s+)?pay(?:ment)?|"
    r"bill\s*pay|"
    r"wire(?:\s+transfer)?|"
    r"eft|"
    r"pos|"
    r"electronic\s+payment|"
    r"payment|"
    r"deposit|"
    r"withdrawal"
)

# fixed values: descriptions that are no vendor, first match names the reason
NON_VENDOR = [
    r"\bPAYROLL\b",
    r"\bDIRECT\s+DEP(OSIT)?\b",
    r"\bDIR\s+DEP\b",
    r"\bDDP\b",
    r"\bTRANSFER\s+FROM\b",
    r"\bXFER\s+FROM\b",
    r"\bTRF\s+FROM\b",
    r"\bMOBILE\s+DEP(OSIT)?\b",
    r"\bATM\s+DEP(OSIT)?\b",
    r"\bOPENING\s+BALANCE\b",
    r"\bCLOSING\s+BALANCE\b",
    r"\bBEGINNING\s+BALANCE\b",
    r"\bENDING\s+BALANCE\b",
    r"\bCURRENT\s+BALANCE\b",
    r"^BALANCE$",
    r"\bPAYMENT\s*[-–]\s*THANK\s+YOU\b",
    r"\bAUTO\s*PAY\s+RECEIVED\b",
    r"\bONLINE\s+PAYMENT\b",
    r"\bPAYMENT\s+RECEIVED\b",
    r"\bREFUND\b",
    r"\bCASHBACK\b",
    r"\bREWARDS?\s+CREDIT\b",
    r"\bINTEREST\s+EARNED\b",
    r"\bINTEREST\s+PAID\b",
    r"\bDIVIDEND\b",
    r"\bZELLE\s+FROM\b",
    r"\bVENMO\s+FROM\b",
]
REASON_WIDTH = 40

# fixed value: an amount where a name should be
EMBEDDED_AMOUNT = r"^\$?[\d,]+\.\d{2}$|^.*\$[\d,]+\.\d{2}"

# fixed values: noise inside a name, in the order it is removed
NOISE = [
    r"\*[A-Z0-9]{4,}", r"#\d+", r"\d{4,}", r"\.COM\b", r"\bMKTP\b",
    r"\bPAYPAL\s*\*", r"\bSQ\s*\*", r"\bPOS\b", r"\bACH\b", r"\bDEBIT\b", r"\bCREDIT\b",
    r"\bAUTOPAY\b", r"\bONLINE\b", r"\bPURCHASE\b", r"\bPMT\b",
]
WORKSHEET_NOISE = [
    r"\*[A-Z0-9]{4,}", r"#\d+", r"\d{4,}", r"\.COM\b", r"\bMKTP\b", r"\bPAYPAL\s*\*", r"\bSQ\s*\*", r"\bPOS\b",
    r"\bACH\b", r"\bDEBIT\b", r"\bCREDIT\b",
]

# fixed values: entity suffixes
SUFFIXES = [
    "LLC", "L.L.C.", "L.L.C", "INC", "INC.", "INCORPORATED", "CORP", "CORP.", "CORPORATION",
    "CO", "CO.", "COMPANY", "LTD", "LTD.", "LIMITED", "LP", "L.P.", "LLP", "PC", "P.C.", "PLLC",
    "NA", "N.A.", "FSB",
]
WORKSHEET_SUFFIXES = [
    "LLC", "L.L.C.", "L.L.C", "INC", "INC.", "INCORPORATED", "CORP", "CORP.", "CORPORATION", "CO", "CO.", "COMPANY",
    "LTD", "LTD.", "LIMITED", "LP", "L.P.", "LLP", "PC", "P.C.", "PLLC",
]

# fixed values: words kept in capitals in a display name
KEEP_UPPER = ["LLC", "INC", "CORP", "CO", "LTD", "LP", "LLP", "PC", "PLLC", "USA", "US", "NA", "FSB", "ATM"]
WORKSHEET_KEEP_UPPER = ["LLC", "INC", "CORP", "CO", "LTD", "LP", "LLP", "PC", "PLLC", "USA", "US"]

MATCH_THRESHOLD = 0.75
REVIEW_THRESHOLD = 0.85
VARIANT_THRESHOLD = 0.65

# fixed values: first cells that mark the header of a vendor list
LIST_HEADERS = ["vendor", "name", "vendor name", "canonical", "canonical name"]
WORKSHEET_LIST_HEADERS = ["vendor", "vendor name", "name", "canonical name"]

# fixed values: review signals
NEAR_LOW, NEAR_HIGH, THRESHOLD = 500.00, 700.00, 600.00
MISMATCH_RATIO, MISMATCH_GAP = 5.0, 500.00

# fixed values: spend categories of the worksheet
UTILITY_WORDS = ["VERIZON", "COMCAST", "PG&E", "AT&T", "ELECTRIC", "GAS", "WATER"]
RETAIL_WORDS = ["AMAZON", "HOME DEPOT", "STAPLES", "OFFICE DEPOT", "WALMART", "TARGET", "COSTCO"]
CONTRACTOR_TYPES = ["LLC", "INC", "CORP"]
