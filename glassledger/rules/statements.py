"""Fixed values for reading and classifying statement lines."""
from __future__ import annotations

# fixed values: words in upper case, in the order they are tried
BALANCE = [
    "OPENING BALANCE", "ENDING BALANCE", "BEGINNING BALANCE", "BALANCE FORWARD",
    "PRIOR BALANCE", "STARTING BALANCE", "CLOSING BALANCE",
]
METADATA = [
    "TOTAL NEW CHARGES", "PREVIOUS BALANCE", "NEW BALANCE", "MINIMUM PAYMENT",
    "PAYMENT DUE", "STATEMENT TOTAL", "PAGE TOTAL", "SUBTOTAL",
]
PAYROLL = ["PAYROLL"]  # every longer payroll wording holds this word and gives the same reason
TRANSFER = ["TRANSFER FROM", "TRANSFER TO", "XFER FROM", "XFER TO", "INTERNAL TRANSFER", "BOOK TRANSFER"]
INTEREST = ["INTEREST EARNED", "INTEREST PAID", "INTEREST CREDIT"]
DEPOSIT = [
    "ATM DEPOSIT", "MOBILE DEPOSIT", "REMOTE DEPOSIT", "WIRE TRANSFER IN", "WIRE IN",
    "ACH CREDIT", "DEPOSIT REFUND",
]
FEE = [
    "MAINTENANCE FEE", "MONTHLY FEE", "SERVICE CHARGE", "OVERDRAFT FEE", "OVERDRAFT CHARGE",
    "NSF FEE", "NSF CHARGE", "WIRE FEE", "ATM FEE", "STOP PAYMENT FEE", "RETURNED ITEM FEE", "ANNUAL FEE",
]
CHECK_STARTS = [
    "CHECK #", "CHECK NO", "CHECK NUMBER", "CHK #", "CHK NO", "CHECK PAID", "CHECK WRITTEN", "CHECK CLEAR",
]
CHECK_NUMBER = (
    r"^\s*(CHECK\s*(?:#|NO\.?|NUMBER)?\s*\d+|CHK\s*(?:#|NO\.?)?\s*\d+"
    r"|CHECK\s+PAID|CHECK\s+WRITTEN|CHECK\s+CLEAR)\b"
)

# fixed values: reasons shown for excluded rows; {} takes the matched word
REASONS = {
    "empty": "No transaction description",
    "balance": "Statement balance line ({})",
    "metadata": "Statement summary metadata ({})",
    "payroll": "Payroll direct deposit (income, not a vendor payment)",
    "transfer": "Internal account transfer ({})",
    "interest": "Interest earned (income, not a vendor payment)",
    "deposit": "Incoming deposit ({})",
    "fee": "Bank fee ({}; excluded from 1099 by policy)",
    "check_unverified": "Check payee not visible in statement description; verify with check image "
                        "or client records before treating as a vendor payment",
    "unknown": "Could not determine transaction type from description and amount",
}

# fixed values: words that bar the credit column from standing in for the amount
DEPOSIT_LIKE = [
    "deposit", "payroll", "direct dep", "transfer from", "transfer to", "xfer", "refund",
    "interest earned", "interest paid", "wire in", "ach credit",
]


# fixed values: line shapes in the order they are tried;
# (regex, group of date, group of description, group of amount)
LINE_SHAPES = [
    (r"^\s*(\d{1,2}/\d{1,2}/\d{2,4})\s+(.+?)\s+\$?(-?[\d,]+\.\d{2})\s+\$?-?[\d,]+\.\d{2}\s*$", 1, 2, 3),
    (r"^\s*(\d{1,2}/\d{1,2})\s+(.+?)\s+\$?(-?[\d,]+\.\d{2})\s+\$?-?[\d,]+\.\d{2}\s*$", 1, 2, 3),
    (r"^\s*(\d{4}-\d{1,2}-\d{1,2})\s+(.+?)\s+\$?(-?[\d,]+\.\d{2})\s+\$?-?[\d,]+\.\d{2}\s*$", 1, 2, 3),
    (r"^\s*(\d{1,2}/\d{1,2}/\d{2,4})\s+(.+?)\s+\$?(-?[\d,]+\.\d{2})\s*$", 1, 2, 3),
    (r"^\s*(\d{1,2}/\d{1,2})\s+(.+?)\s+\$?(-?[\d,]+\.\d{2})\s*$", 1, 2, 3),
    (r"^\s*(\d{4}-\d{1,2}-\d{1,2})\s+(.+?)\s+\$?(-?[\d,]+\.\d{2})\s*$", 1, 2, 3),
    (r"^\s*(\d{1,2}/\d{1,2}/\d{2,4})\s+(.+?)\s{2,}\$?(-?[\d,]+\.\d{2})(?:\s+\$?-?[\d,]+\.\d{2})?\s*$", 1, 2, 3),
    (r"^\s*(\d{1,2}/\d{1,2})\s+(.+?)\s{2,}\$?(-?[\d,]+\.\d{2})(?:\s+\$?-?[\d,]+\.\d{2})?\s*$", 1, 2, 3),
    (r"(?i)^\s*((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}(?:,\s*\d{4})?)\s+(.+?)\s+\$?(-?[\d,]+\.\d{2})\s*$", 1, 2, 3),
    (r"(?i)^\s*(\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{2,4})\s+(.+?)\s+\$?(-?[\d,]+\.\d{2})\s*$", 1, 2, 3),
    (r"^\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\s+(.+?)\s{2,}([\d,]+\.\d{2})\s+(?:[\d,]+\.\d{2}\s+)?[\d,]+\.\d{2}\s*$", 1, 2, 3),
    (r"^\s*(\d{1,2}/\d{1,2}(?:/\d{2,4})?)\s+\$?([\d,]+\.\d{2})\s+([A-Z].+?)\s*$", 1, 3, 2),
]
WORKSHEET_LINE_SHAPES = [
    (r"^\s*(\d{1,2}/\d{1,2}/\d{2,4})\s+(.+?)\s+\$?(-?[\d,]+\.\d{2})\s*$", 1, 2, 3),
    (r"^\s*(\d{1,2}/\d{1,2})\s+(.+?)\s+\$?(-?[\d,]+\.\d{2})\s*$", 1, 2, 3),
    (r"^\s*(\d{4}-\d{1,2}-\d{1,2})\s+(.+?)\s+\$?(-?[\d,]+\.\d{2})\s*$", 1, 2, 3),
]

# fixed values: lines that are headers, totals, page numbers or rules
SKIP_LINES = [
    r"^\s*(?:beginning|ending|opening|closing)\s+balance",
    r"^\s*(?:total|subtotal|grand\s+total)",
    r"^\s*(?:date|description|amount|balance|debit|credit|transaction)",
    r"^\s*page\s+\d+",
    r"^\s*\d+\s*$",
    r"^\s*[-=]{3,}\s*$",
]

# fixed values: document type -> words that show it, tried in order; else "bank"
DOCUMENT_TYPES = [
    ("1099_nec", ["nonemployee compensation", "1099-nec", "1099 nec"]),
    ("1099_misc", ["1099-misc", "1099 misc", "miscellaneous"]),
    ("1099_int", ["1099-int", "interest income", "1099 int"]),
    ("w2", ["w-2", "w2", "wages, tips", "employer identification"]),
    ("schedule_c", ["schedule c", "profit or loss from business"]),
    ("schedule_e", ["schedule e", "supplemental income"]),
    ("credit_card", ["credit card", "card ending", "minimum payment due"]),
]
TAX_FORMS = ["1099_nec", "1099_misc", "1099_int", "w2", "schedule_c", "schedule_e"]

_BOX = r"\s*[\$:]?\s*([\d,]+\.?\d*)"
# fixed values: box label -> regex (group 1 is the amount)
TAX_BOXES = {
    "1099_nec": r"(?:nonemployee\s+compensation|box\s*1|nec)" + _BOX,
    "1099_misc_rents": r"(?:rents|box\s*1)" + _BOX,
    "1099_misc_other": r"(?:other\s+income|box\s*3)" + _BOX,
    "1099_int": r"(?:interest\s+income|box\s*1)" + _BOX,
    "w2_wages": r"(?:wages,?\s+tips|box\s*1)" + _BOX,
    "schedule_c": r"(?:gross\s+receipts|line\s*1|part\s+i)" + _BOX,
}
# fixed values: document type -> boxes read from it
TAX_BOXES_OF = {
    "1099_nec": ["1099_nec"],
    "1099_misc": ["1099_misc_rents", "1099_misc_other"],
    "1099_int": ["1099_int"],
    "w2": ["w2_wages"],
    "schedule_c": ["schedule_c"],
    "schedule_e": ["schedule_c"],
}

# fixed values: header words of table columns
CELL_HEADERS = {
    "date": ["date"],
    "description": ["description", "payee", "vendor", "merchant", "transaction", "memo", "details", "narrative"],
    "amount": ["amount", "debit", "withdrawal", "payment", "charge"],
    "credit": ["credit", "deposit"],
}
WORKSHEET_CELL_HEADERS = {
    "date": ["date"],
    "description": ["description", "payee", "vendor", "merchant", "transaction"],
    "amount": ["amount", "debit", "withdrawal", "payment"],
    "credit": [],
}

# fixed values: transaction type of transcribed statements -> activity bucket
BUCKETS = {
    "deposit": "deposits",
    "interest": "deposits",
    "reimbursement": "deposits",
    "vendor_payment": "withdrawals",
    "check_payment": "checks",
    "transfer": "transfers",
    "owner_draw": "transfers",
    "bank_fee": "fees",
}
# optional mapping for rows typed by our own classifier; off by default
CLASSIFIER_BUCKETS = BUCKETS | {"check": "checks", "check_unverified": "checks", "fee": "fees"}
BUCKET_NAMES = ["deposits", "withdrawals", "checks", "transfers", "fees"]
TOLERANCE = 0.01
