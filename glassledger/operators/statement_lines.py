"""Typed rows from statement text lines, tables of cells and tax-form text."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WHITESPACE, contains_any, parse_amount, strip, title
from ..plans.joins import where_computed
from ..rules import statements as R



def skip_line(line: Column) -> Column:
    """Headers, totals, balances, page numbers and rules."""
    return line.rlike("(?i)" + "|".join(R.SKIP_LINES))


def looks_like_deposit(description: Column) -> Column:
    return contains_any(F.lower(F.coalesce(description, F.lit(""))), R.DEPOSIT_LIKE)


def text_lines(pages: DataFrame, keys: list[str], text: str = "text", skip: bool = True) -> DataFrame:
    """One row per non-blank line, ``line_no`` from 1; header and footer lines go."""
    lines = pages.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line")).withColumns(
        {"line_no": F.col("line_no") + 1, "line": F.rtrim(F.col("line"), F.lit(WHITESPACE))}
    )
    lines = lines.where(strip(F.col("line")) != "")
    return lines.where(~skip_line(F.col("line"))) if skip else lines


_MARK = "\u0001"


def _fields(line: Column, shape: tuple) -> Column:
    """Date, description and amount text of a line known to fit a shape."""
    regex, d, t, a = shape
    return F.split(F.regexp_replace(line, regex, f"${d}{_MARK}${t}{_MARK}${a}"), _MARK)


def _row(fields: Column, shortest: int) -> Column:
    """A typed row, or null when the amount is zero or no number or the text too short."""
    amount, text = parse_amount(F.get(fields, F.lit(2))), strip(F.get(fields, F.lit(1)))
    return F.when(
        (amount != 0) & (F.length(text) >= shortest),
        F.struct(F.get(fields, F.lit(0)).alias("date_raw"), text.alias("description"),
                 F.abs(amount).cast("decimal(18,2)").alias("amount")),
    )


def extract_rows(lines: DataFrame, source: str = "bank", profile: str = "consolidated") -> DataFrame:
    """Date, description and amount by the first line shape that fits.

    A shape whose amount is zero or no number, or whose description is shorter
    than two characters, is passed over. Lines no shape fits are dropped. Nearly
    every line is settled by the first shape it fits; only the others go through
    all shapes again.
    """
    shapes, shortest = (R.LINE_SHAPES, 2) if profile == "consolidated" else (R.WORKSHEET_LINE_SHAPES, 0)
    line = F.col("line")
    first = None
    for s in shapes:
        first = F.when(line.rlike(s[0]), _fields(line, s)) if first is None else first.when(line.rlike(s[0]), _fields(line, s))
    every = F.coalesce(*[F.when(line.rlike(s[0]), _row(_fields(line, s), shortest)) for s in shapes])
    typed = lines.withColumn("_f", first).withColumn(
        "_t", F.when(F.col("_f").isNotNull(), F.coalesce(_row(F.col("_f"), shortest), every))
    )
    kept = where_computed(typed, F.col("_t").isNotNull())
    return kept.select(*[c for c in lines.columns if c != "line"], "_t.*", F.lit(source).alias("source"))


# --- documents -----------------------------------------------------------------


def document_type(text: Column) -> Column:
    low = F.lower(text)
    kind = None
    for name, words in R.DOCUMENT_TYPES:
        hit = contains_any(low, words)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    return kind.otherwise("bank")


def extraction_confidence(rows: Column, doc_type: Column) -> Column:
    base = F.when(rows >= 20, 0.9).when(rows >= 10, 0.75).when(rows >= 3, 0.5).otherwise(0.2)
    lifted = F.when(doc_type.isin(R.TAX_FORMS), F.least(base + 0.3, F.lit(1.0))).otherwise(base)
    return F.when(F.coalesce(rows, F.lit(0)) == 0, 0.0).otherwise(lifted)


def _box_hits(text: Column, box: str) -> Column:
    """All finds of one box: its label, the words read and the figure in them."""
    regex, label = F.lit("(?i)" + R.TAX_BOXES[box]), F.lit(title(box.replace("_", " ")))
    finds = F.arrays_zip(
        F.regexp_extract_all(text, regex, F.lit(0)).alias("whole"), F.regexp_extract_all(text, regex, F.lit(1)).alias("figure")
    )
    return F.transform(finds, lambda h: F.struct(label.alias("label"), h["whole"].alias("whole"), h["figure"].alias("figure")))


def tax_form_amounts(docs: DataFrame, keys: list[str], text: str = "text", doc_type: str = "document_type") -> DataFrame:
    """Every positive box amount of tax-form texts, with the words it was read from."""
    hits = F.coalesce(*[
        F.when(F.col(doc_type) == kind, F.concat(*[_box_hits(F.col(text), box) for box in boxes]))
        for kind, boxes in R.TAX_BOXES_OF.items()
    ])
    rows = docs.withColumn("_hits", hits).select(
        *keys, F.col(doc_type).alias("source"), F.posexplode("_hits").alias("line_no", "_h")
    )
    amount = parse_amount(F.col("_h")["figure"])
    return rows.withColumn("amount", amount).where("amount > 0").select(
        *keys, (F.col("line_no") + 1).alias("line_no"), F.lit("").alias("date_raw"),
        F.concat(F.lit("["), F.col("_h")["label"], F.lit("] "), strip(F.substring(F.col("_h")["whole"], 1, 60))).alias("description"),
        "amount", "source",
    )


# --- tables of cells --------------------------------------------------------------


def _first_with(header: Column, words: list[str]) -> Column:
    """0-based position of the first header cell holding one of the words; null if none."""
    if not words:
        return F.lit(None).cast("int")
    flags = F.transform(header, lambda h: contains_any(F.lower(strip(F.coalesce(h, F.lit("")))), words))
    return F.nullif(F.array_position(flags, F.lit(True)) - 1, F.lit(-1).cast("bigint")).cast("int")


def rows_from_cells(cells: DataFrame, keys: list[str], source: str = "bank", profile: str = "consolidated") -> DataFrame:
    """Typed rows of tables given as (keys, table_no, row_no, cells array); row 0 is the header.

    The amount column is read first; the credit column stands in only when the
    description does not look like a deposit or transfer.
    """
    words = R.CELL_HEADERS if profile == "consolidated" else R.WORKSHEET_CELL_HEADERS
    table = [*keys, "table_no"]
    header = cells.where("row_no = 0").select(
        *table, *[_first_with(F.col("cells"), w).alias(f"_{k}") for k, w in words.items()]
    )
    usable = header.where("_date IS NOT NULL AND _description IS NOT NULL AND (_amount IS NOT NULL OR _credit IS NOT NULL)")
    body = cells.where("row_no > 0").join(usable, table)
    last = F.greatest("_date", "_description", F.coalesce("_amount", F.lit(0)), F.coalesce("_credit", F.lit(0)))
    body = body.where(F.size("cells") > last)

    def cell(at: str) -> Column:
        return strip(F.coalesce(F.get("cells", F.col(at)), F.lit("")))

    amount = parse_amount(cell("_amount"))
    credit = F.when(~looks_like_deposit(cell("_description")), parse_amount(cell("_credit")))
    picked = F.when((F.coalesce(amount, F.lit(0)) == 0) & F.col("_credit").isNotNull(), F.coalesce(credit, amount)).otherwise(amount)
    rows = body.select(
        *table, F.col("row_no").alias("line_no"), cell("_date").alias("date_raw"), cell("_description").alias("description"),
        F.abs(picked).cast("decimal(18,2)").alias("amount"), F.lit(source).alias("source"),
    )
    rows = rows.where((F.col("date_raw") != "") & (F.col("description") != "") & (F.col("amount") != 0))
    return rows.where(~skip_line(F.col("description"))) if profile == "consolidated" else rows


# --- which tier to trust ----------------------------------------------------------


def choose_tier(docs: DataFrame, key: str, tax: DataFrame, table: DataFrame, lines: DataFrame) -> DataFrame:
    """Per document: tax form if it gave rows, else the table rows if they are not
    fewer than the line rows, else the line rows, else none; with its confidence."""
    counts = docs
    for name, rows in (("tax", tax), ("table", table), ("line", lines)):
        counts = counts.join(rows.groupBy(key).agg(F.count("*").alias(f"{name}_rows")), key, "left")
    n = {k: F.coalesce(F.col(f"{k}_rows"), F.lit(0)) for k in ("tax", "table", "line")}
    tier = (
        F.when(n["tax"] > 0, "irs_form")
        .when((n["table"] > 0) & (n["table"] >= n["line"]), "table")
        .when(n["line"] > 0, "regex")
        .otherwise("none")
    )
    picked = F.when(tier == "table", n["table"]).when(tier == "regex", n["line"]).otherwise(0)
    conf = F.when(tier == "irs_form", 0.85).otherwise(extraction_confidence(picked, F.col("document_type")))
    return counts.withColumns({"extraction_method": tier, "confidence": conf}).drop("tax_rows", "table_rows", "line_rows")


def rows_of_chosen_tier(chosen: DataFrame, key: str, tax: DataFrame, table: DataFrame, lines: DataFrame) -> DataFrame:
    cols = [key, "line_no", "date_raw", "description", "amount", "source"]
    parts = []
    for name, rows in (("irs_form", tax), ("table", table), ("regex", lines)):
        keep = chosen.where(F.col("extraction_method") == name).select(key)
        parts.append(rows.select(*cols).join(keep, key, "left_semi").withColumn("extraction_method", F.lit(name)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
