"""Report tables of a consolidation and of the single-statement worksheet."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dollars, percent, to_decimal
from ..rules import vendors as R
from .vendor_rollup import spend_category, vendor_order

INDIVIDUAL = "Individual?"
_CENTS = "decimal(18,2)"


def cents(c: Column) -> Column:
    """Two places; null or no number is 0."""
    return F.coalesce(to_decimal(c), F.lit(0).cast(_CENTS))


def yes_no(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), "YES").otherwise("NO")


# --- labels -------------------------------------------------------------------


def resolve_labels(df: DataFrame, column: str, file_names: DataFrame) -> DataFrame:
    """Statement ids in a column become file names; ``file_names`` is (id, file_name)."""
    stem = F.regexp_replace(F.col(column), r"\.pdf$", "")
    names = file_names.select(F.col("id").alias("_id"), F.col("file_name").alias("_name"))
    out = df.withColumn("_id", F.when(F.col(column) != "Combined", stem)).join(names, "_id", "left")
    return out.withColumn(column, F.coalesce("_name", F.col(column))).drop("_id", "_name")


ID_IN_TEXT = r"\b([0-9a-f]{32})(\.pdf)?\b"


def resolve_in_text(df: DataFrame, key: list[str], column: str, file_names: DataFrame) -> DataFrame:
    """32-hex ids inside free text become file names; unknown ids stay.

    The text is cut at its ids, the pieces are looked up as rows and put together
    again in order, so the name table is joined, never held in one place.
    """
    marked = F.regexp_replace(F.col(column), ID_IN_TEXT, "\u0001$1$2\u0001")
    pieces = df.select(*key, F.posexplode(F.split(marked, "\u0001")).alias("_at", "_piece")).withColumn(
        "_id", F.nullif(F.regexp_extract("_piece", "^([0-9a-f]{32})(\\.pdf)?$", 1), F.lit(""))
    )
    names = file_names.select(F.col("id").alias("_id"), F.col("file_name").alias("_name"))
    named = pieces.join(names, "_id", "left").withColumn("_piece", F.coalesce("_name", "_piece"))
    text = named.groupBy(*key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_piece"))), lambda p: p["_piece"]), "").alias("_text")
    )
    return df.join(text, key, "left").withColumn(column, F.coalesce("_text", F.col(column))).drop("_text")


# --- transactions ----------------------------------------------------------------


def transaction_sheet(rows: DataFrame) -> DataFrame:
    """All rows of all good statements; excluded ones have no vendor name."""
    excluded = F.col("norm_excluded") | ~F.coalesce(F.col("include_for_1099"), F.lit(True))
    reason = F.coalesce(F.nullif(F.col("exclusion_reason"), F.lit("")), F.col("norm_reason"), F.lit(""))
    return rows.select(
        "statement", "line_no", F.coalesce("date_raw", F.lit("")).alias("date"),
        F.col("description").alias("raw_description"),
        F.when(excluded, "").otherwise(F.col("canonical_name")).alias("canonical_name"),
        cents(F.col("amount")).alias("amount"), yes_no(excluded).alias("excluded"), reason.alias("exclusion_reason"),
    )


# --- vendors ------------------------------------------------------------------


def cross_reference(vendors: DataFrame) -> DataFrame:
    """The other statements a vendor is in, as text per vendor and statement.

    The list of a vendor is built once and each row takes its own entry out,
    rather than pairing all rows of a vendor with each other.
    """
    entry = F.concat(F.col("statement"), F.lit(": "), dollars(F.col("total_amount")))
    shared = vendors.groupBy("canonical_name").agg(
        F.array_sort(F.collect_list(F.struct("statement_key", "statement", entry.alias("text")))).alias("all")
    ).where(F.size("all") > 1)
    out = vendors.select("statement", "canonical_name").join(shared, "canonical_name", "left")
    others = F.filter("all", lambda e: e["statement"] != F.col("statement"))
    return out.select(
        "statement", "canonical_name",
        F.coalesce(F.array_join(F.transform(others, lambda e: e["text"]), "; "), F.lit("")).alias("cross_reference"),
    )


def master_vendor_sheet(vendors: DataFrame, reasons: DataFrame) -> DataFrame:
    """One row per vendor and statement with flags and cross-references."""
    keys = ["statement", "canonical_name"]
    df = vendors.join(reasons.select(*keys, "reasons", "flagged"), keys, "left").join(cross_reference(vendors), keys, "left")
    conf = F.col("extraction_confidence") if "extraction_confidence" in df.columns else F.lit(1.0)
    return df.select(
        F.col("canonical_name").alias("vendor"), "statement",
        F.coalesce("entity_type", F.lit(INDIVIDUAL)).alias("entity_type"),
        cents(F.col("total_amount")).alias("total_paid"), F.col("transaction_count").alias("payments"),
        F.coalesce("first_payment_date", F.lit("")).alias("first_payment"),
        F.coalesce("last_payment_date", F.lit("")).alias("last_payment"),
        F.coalesce("form_type", F.lit("TBD")).alias("form_1099"), "match_confidence",
        F.coalesce(conf, F.lit(1.0)).alias("extraction_confidence"),
        yes_no(F.col("flagged")).alias("review_needed"),
        F.coalesce(F.array_join("reasons", "; "), F.lit("")).alias("review_reasons"),
        "cross_reference",
    )


def pooled_vendor_table(pooled: DataFrame, sources: DataFrame) -> DataFrame:
    """Vendors over all statements, as shown on screen."""
    df = pooled.join(sources, "canonical_name", "left")
    return df.select(
        "canonical_name", "entity_type", "total_amount", "transaction_count",
        F.coalesce("statement_count", F.lit(0)).alias("statement_count"), "source_statements",
        "first_payment_date", "last_payment_date", "form_type", "eligible", "threshold_met",
        (F.col("needs_review") | (F.col("form_type") == "REVIEW")).alias("needs_review"), "notes", "first_seen",
    )


def consolidated_totals(table: DataFrame, matches: DataFrame, mismatches: DataFrame, near: DataFrame,
                        variants: DataFrame | None = None) -> DataFrame:
    """The ten counters of a run, one row."""
    base = table.agg(
        F.count("*").alias("vendor_count"),
        F.coalesce(F.sum("total_amount"), F.lit(0)).cast(_CENTS).alias("total_reconciled"),
        F.count_if("threshold_met").alias("over_threshold"),
        F.count_if("eligible").alias("eligible_1099"),
        F.count_if("needs_review").alias("needs_review"),
    )
    def count(df: DataFrame) -> Column:
        return df.agg(F.count("*").alias("n")).scalar()

    cols = {
        "cross_statement_vendors": count(matches),
        "combined_only_crossings": count(matches.where("crosses_threshold_combined_only")),
        "amount_mismatches": count(mismatches),
        "near_threshold": count(near),
    }
    if variants is not None:
        cols["name_variant_flags"] = count(variants)
    return base.withColumns(cols)


def executive_kpis(rows: DataFrame, vendors: DataFrame, reasons: DataFrame) -> DataFrame:
    """Included payments, distinct vendors, total, vendor-and-statement pairs at $600, flags to review."""
    sheet_in = ~(F.col("norm_excluded") | ~F.coalesce(F.col("include_for_1099"), F.lit(True)))
    k = vendors.agg(
        F.count_distinct("canonical_name").alias("unique_vendors"),
        F.coalesce(F.sum("total_amount"), F.lit(0)).cast(_CENTS).alias("total_reconciled"),
        F.count_if(F.col("total_amount") >= R.THRESHOLD).alias("over_600"),
    )
    return k.withColumns(
        {
            "included_payments": rows.agg(F.count_if(sheet_in).alias("n")).scalar(),
            "review_needed": reasons.agg(F.count_if("flagged").alias("n")).scalar(),
        }
    )


def top_vendors(vendors: DataFrame, reasons: DataFrame, n: int = 10) -> DataFrame:
    """Largest vendors over all statements. The entity is the first known one, the
    form the first that is neither undecided nor exempt, else the last one seen."""
    keys = ["statement", "canonical_name"]
    df = vendors.join(reasons.select(*keys, "flagged"), keys, "left")
    key = F.col("statement_key")
    first_entity = F.min_by("entity_type", F.when(F.col("entity_type").isNotNull(), key))
    decided = F.min_by("form_type", F.when(~F.col("form_type").isin("TBD", "EXEMPT"), key))
    return (
        df.groupBy("canonical_name")
        .agg(
            F.sum("total_amount").cast(_CENTS).alias("total_amount"),
            F.sum("transaction_count").alias("transaction_count"),
            first_entity.alias("entity_type"), decided.alias("_form"),
            F.count_if(F.col("form_type") == "EXEMPT").alias("_exempt"),
            F.min_by("match_confidence", key).alias("match_confidence"),
            F.bool_or(F.coalesce("flagged", F.lit(False))).alias("_review"),
            F.min("first_seen").alias("first_seen"),
        )
        .select(
            "canonical_name", F.coalesce("entity_type", F.lit(INDIVIDUAL)).alias("entity_type"), "total_amount",
            "transaction_count",
            F.coalesce("_form", F.when(F.col("_exempt") > 0, "EXEMPT"), F.lit("TBD")).alias("form_type"),
            yes_no(F.col("_review")).alias("review_needed"), "match_confidence", "first_seen",
        )
        .orderBy(*vendor_order())
        .limit(n)
    )


def statement_summary(statements: DataFrame, vendors: DataFrame) -> DataFrame:
    """Per statement: rows, vendors, total, over $600, review; zeros when it failed."""
    agg = vendors.groupBy("statement").agg(
        F.sum("transaction_count").alias("transactions"), F.count("*").alias("vendors"),
        F.sum("total_amount").cast(_CENTS).alias("total"), F.count_if(F.col("total_amount") >= R.THRESHOLD).alias("over_600"),
        F.count_if("needs_review").alias("review_needed"),
    )
    good = F.col("status").isin("success", "partial")
    zero = F.lit(0).cast("bigint")
    out = statements.join(agg, "statement", "left")
    count = lambda c: F.when(good, F.coalesce(F.col(c), zero)).otherwise(zero).alias(c)
    return out.select(
        "statement", F.upper(F.replace("status", F.lit("_"), F.lit(" "))).alias("status"),
        count("transactions"), count("vendors"),
        F.when(good, F.coalesce("total", F.lit(0).cast(_CENTS))).otherwise(F.lit(0).cast(_CENTS)).alias("total_reconciled"),
        count("over_600"), count("review_needed"),
        F.when(good, F.coalesce("confidence", F.lit(1.0))).otherwise(0.0).alias("extraction_confidence"),
        F.coalesce("error_message", F.lit("")).alias("notes"),
    )


# --- validation sheet ------------------------------------------------------------


def match_sheet(matches: DataFrame, appearances: DataFrame) -> DataFrame:
    entry = F.concat(F.col("statement"), F.lit(": "), dollars(F.col("total_amount")))
    lists = appearances.groupBy("canonical_name").agg(
        F.array_sort(F.collect_list(F.struct("statement_key", "statement", entry.alias("text")))).alias("a")
    )
    return matches.join(lists, "canonical_name").select(
        F.col("canonical_name").alias("vendor"),
        F.array_join(F.transform("a", lambda e: e["statement"]), ", ").alias("statements"),
        cents(F.col("combined_total")).alias("combined_total"),
        F.when(F.col("crosses_threshold_combined_only"), "YES — flag for filing").otherwise("no").alias("crosses_600_combined_only"),
        F.array_join(F.transform("a", lambda e: e["text"]), "; ").alias("breakdown"),
    )


def variant_sheet(variants: DataFrame) -> DataFrame:
    return variants.select(
        "statement_a", "name_a", "statement_b", "name_b", percent(F.col("similarity")).alias("similarity"),
        F.concat(dollars(F.col("amount_a")), F.lit(" / "), dollars(F.col("amount_b"))).alias("amounts"),
    )


def mismatch_sheet(mismatches: DataFrame) -> DataFrame:
    return mismatches.select(
        F.col("canonical_name").alias("vendor"), "statement_a", cents(F.col("amount_a")).alias("amount_a"),
        "statement_b", cents(F.col("amount_b")).alias("amount_b"),
        F.concat(F.format_string("%.1f", "ratio"), F.lit("x")).alias("variance"),
    )


def near_threshold_sheet(near: DataFrame) -> DataFrame:
    d = F.col("distance_to_threshold")
    return near.select(
        F.col("canonical_name").alias("vendor"), F.col("statement").alias("source"), cents(F.col("total_amount")).alias("total"),
        F.concat(F.when(d < 0, "+").otherwise("-"), dollars(F.abs(d))).alias("distance_to_600"),
    )


# --- worksheet ---------------------------------------------------------------------


def worksheet_vendors(summary: DataFrame) -> DataFrame:
    """The 13 worksheet columns with a TOTAL row; ``position`` orders vendors, TOTAL last.

    ``summary`` is a worksheet rollup built ``with_variants``.
    """
    lines = summary.select(
        F.lit(1).alias("section"), F.col("canonical_name").alias("vendor"),
        F.coalesce("entity_type", F.lit(INDIVIDUAL)).alias("entity_type"), F.col("total_amount").alias("total_paid"),
        F.col("transaction_count").alias("payments"), F.coalesce("first_payment_date", F.lit("")).alias("first_payment"),
        F.coalesce("last_payment_date", F.lit("")).alias("last_payment"), F.lit("TBD").alias("eligible_1099"),
        F.lit("TBD").alias("w9_on_file"), spend_category(F.col("canonical_name"), F.col("entity_type")).alias("category"),
        F.col("match_confidence").alias("confidence"), yes_no(F.col("needs_review")).alias("review_needed"),
        F.array_join("review_reasons", "; ").alias("review_reason"),
        F.array_join("raw_name_variants", "; ").alias("raw_name_variants"),
    )
    total = summary.agg(
        F.coalesce(F.sum("total_amount"), F.lit(0)).cast(_CENTS).alias("total_paid"),
        F.coalesce(F.sum("transaction_count"), F.lit(0)).alias("payments"),
    ).withColumns({"section": F.lit(2), "vendor": F.lit("TOTAL")})
    return lines.unionByName(total, allowMissingColumns=True)


def worksheet_detail(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.coalesce("date_raw", F.lit("")).alias("date"), F.col("description").alias("raw_description"),
        "canonical_name", F.coalesce("entity_type", F.lit("")).alias("entity_type"), "amount", "source",
        F.col("match_confidence").alias("confidence"), F.when(F.col("needs_review"), "YES").otherwise("").alias("review"),
    )


def worksheet_stats(rows: DataFrame, summary: DataFrame) -> DataFrame:
    s = summary.agg(
        F.count("*").alias("unique_vendors"), F.coalesce(F.sum("total_amount"), F.lit(0)).cast(_CENTS).alias("total_reconciled"),
        F.count_if(F.col("total_amount") >= R.THRESHOLD).alias("over_600"),
        F.count_if(F.col("entity_type").isin(R.CONTRACTOR_TYPES)).alias("with_entity_suffix"),
        F.count_if("needs_review").alias("needing_review"),
    )
    rate = F.col("needing_review") / F.greatest(F.col("unique_vendors"), F.lit(1)) * 100
    return s.withColumns(
        {
            "transactions": rows.agg(F.count("*").alias("n")).scalar(),
            "review_rate": F.concat(F.format_string("%.1f", rate), F.lit("%")),
        }
    )
