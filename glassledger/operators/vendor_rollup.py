"""Vendor totals, 1099 eligibility and spend category."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import one_of, contains_any, dollars, percent
from ..plans.joins import where_computed
from ..plans.stored import stored
from ..rules import eligibility as E
from ..rules import vendors as R
from .vendor_names import normalise_vendors, preclean

LOW_MATCH = "Low vendor name match confidence"
CLASSIFIER_REVIEW = (
    "Contains transactions flagged for review by classifier "
    "(e.g. check payment with payee that should be verified)"
)


def countable_rows(df: DataFrame) -> DataFrame:
    """Rows that neither the name rules nor the row rules exclude."""
    return where_computed(df.where(F.coalesce(F.col("include_for_1099"), F.lit(True))), ~F.col("norm_excluded"))


def _order(df: DataFrame) -> Column:
    return F.struct("statement", "line_no") if "statement" in df.columns else F.struct("line_no")


def sum_spellings(rows: DataFrame, keys: list[str], names: list[str], gated: bool) -> DataFrame:
    """Totals per raw spelling; ``names`` are further columns the spelling decides."""
    text = F.nullif(F.col("date_raw"), F.lit(""))
    day = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("M/d/yyyy", "M/d/yy", "yyyy-M-d")]).cast("date")
    review = F.coalesce(F.col("review_required"), F.lit(False)) if gated and "review_required" in rows.columns else F.lit(False)
    rows = rows.withColumns({"_day": day, "_order": _order(rows), "_review": review})
    return rows.groupBy(*keys, "raw_name", *names).agg(
        F.sum("amount").alias("total"),
        F.count("*").alias("n"),
        F.min(text).alias("first"),
        F.max(text).alias("last"),
        F.min("_day").alias("first_on"),
        F.max("_day").alias("last_on"),
        F.bool_or("_review").alias("row_review"),
        F.min("_order").alias("seen"),
    )


def sum_vendors(spelled: DataFrame, keys: list[str], with_variants: bool = False) -> DataFrame:
    """Vendor rows from the totals of their spellings."""
    entity = F.struct(F.col("seen").alias("o"), F.col("entity_type").alias("e"))
    aggs = [
        F.min(F.when(F.col("entity_type").isNotNull(), entity))["e"].alias("entity_type"),
        F.sum("total").cast("decimal(18,2)").alias("total_amount"),
        F.sum("n").alias("transaction_count"),
        F.min("first").alias("first_payment_date"),
        F.max("last").alias("last_payment_date"),
        F.min("first_on").alias("first_paid_on"),
        F.max("last_on").alias("last_paid_on"),
        F.count("*").alias("variant_count"),
        F.min("match_confidence").alias("match_confidence"),
        F.bool_or("needs_review").alias("_name_review"),
        F.bool_or("row_review").alias("_row_review"),
        F.min("seen").alias("first_seen"),
    ]
    if with_variants:
        aggs.append(F.sort_array(F.collect_list("raw_name")).alias("raw_name_variants"))
    out = spelled.groupBy(*keys, "canonical_name").agg(*aggs)
    many = (F.col("variant_count") > 1) & (F.col("match_confidence") < 0.9)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("_name_review"), LOW_MATCH),
            F.when(many, F.format_string("Multiple raw name variants grouped together (%s)", F.col("variant_count").cast("string"))),
            F.when(F.col("_row_review"), CLASSIFIER_REVIEW),
        )
    )
    return out.withColumns(
        {"needs_review": F.col("_name_review") | F.col("_row_review"), "review_reasons": reasons}
    ).drop("_name_review", "_row_review")


_NAME_COLUMNS = ["canonical_name", "entity_type", "match_confidence", "needs_review"]


def roll_up_vendors(
    df: DataFrame, keys: list[str] | None = None, profile: str = "consolidated", with_variants: bool = False
) -> DataFrame:
    """One row per vendor (within ``keys``, e.g. per statement) of normalised rows.

    Rows are first summed per raw spelling, which spreads a hot vendor over many
    groups; only those partial sums meet per vendor. First and last payment are
    the least and greatest date *text*, as printed; ``first_paid_on`` and
    ``last_paid_on`` are true dates. ``line_no`` (after ``statement``) decides
    which entity type is seen first. The list of spellings is built on request
    only; its length is always there.
    """
    keys, gated = list(keys or []), profile == "consolidated"
    rows = countable_rows(df) if gated else df
    return sum_vendors(sum_spellings(rows, keys, _NAME_COLUMNS, gated), keys, with_variants)


def roll_up_descriptions(
    df: DataFrame, keys: list[str] | None = None, vendor_list: DataFrame | None = None, profile: str = "consolidated",
    with_variants: bool = False,
) -> DataFrame:
    """The same rows as ``roll_up_vendors`` of ``normalise_vendors``, from plain statement rows.

    Rows are summed per spelling before any name rule runs, so the rules see each
    spelling once rather than each row.
    """
    keys, gated = list(keys or []), profile == "consolidated"
    rows = df.where(F.coalesce(F.col("include_for_1099"), F.lit(True))) if gated else df
    raw = preclean(F.col("description")) if gated else F.coalesce("description", F.lit(""))
    spelled = sum_spellings(rows.withColumn("raw_name", raw), keys, [], gated)
    if vendor_list is not None:
        spelled = stored(spelled, "spellings")  # their names are measured, matched and joined back
    named = normalise_vendors(spelled, vendor_list, profile, raw="raw_name", preclean_first=False)
    return sum_vendors(where_computed(named, ~F.col("norm_excluded")), keys, with_variants)


def vendor_variants(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The raw spellings behind each vendor, as rows."""
    return countable_rows(df).select(*(keys or []), "canonical_name", "raw_name").distinct()


def vendor_order(total: str = "total_amount") -> list[Column]:
    """Largest vendor first; equal totals in order of first appearance."""
    return [F.desc(total), F.col("first_seen")]


def vendor_sources(df: DataFrame) -> DataFrame:
    """In which statements a vendor was paid."""
    pairs = countable_rows(df).select("canonical_name", "statement").distinct()
    return pairs.groupBy("canonical_name").agg(
        F.count("*").alias("statement_count"), F.sort_array(F.collect_list("statement")).alias("source_statements")
    )


# --- eligibility --------------------------------------------------------------

_FAMILIES = [
    ("government", E.GOVERNMENT), ("financial", E.FINANCIAL), ("shipping", E.SHIPPING), ("attorney", E.ATTORNEY),
    ("medical", E.MEDICAL), ("cloud", E.CLOUD), ("meals", E.MEALS_AND_RIDES), ("merchandise", E.MERCHANDISE),
    ("utility", E.UTILITY), ("staffing", E.STAFFING),
]


def eligibility_rule(name: Column, entity: Column, total: Column, confidence: Column) -> Column:
    """Which rule decides, tried in order."""
    upper = F.upper(name)
    rule = F.when(total < E.FILING_THRESHOLD, "below")
    for family, words in _FAMILIES:
        hit = upper.rlike(one_of(words))
        if family in ("medical", "cloud", "staffing"):
            rule = rule.when(hit & entity.isin(E.CORPORATE), f"{family}_corp")
        rule = rule.when(hit, family)
    return (
        rule.when(entity.isin(E.CORPORATE), "corporation")
        .when((entity == "") | (confidence < E.LOW_CONFIDENCE), "review")
        .otherwise("known")
    )


def classify_1099(df: DataFrame) -> DataFrame:
    """1099 decision per vendor: form, eligibility, reasons and note."""
    name, total, conf = F.col("canonical_name"), F.col("total_amount"), F.col("match_confidence")
    df = df.withColumn("_ent", F.btrim(F.upper(F.coalesce("entity_type", F.lit("")))))
    df = df.withColumn("_rule", eligibility_rule(name, F.col("_ent"), total, conf))
    rule, ent, paid = F.col("_rule"), F.col("_ent"), dollars(total)
    form = (
        F.when(rule.isin("attorney", "medical", "cloud", "staffing", "known"), "1099-NEC")
        .when(rule == "medical_corp", "1099-MISC")
        .when(rule == "review", "REVIEW")
        .otherwise("EXEMPT")
    )

    def text(pieces: dict[str, Column]) -> Column:
        c = F.lit("")
        for key, value in pieces.items():
            c = F.when(rule == key, value).otherwise(c)
        return c

    join = F.concat
    lit = F.lit
    exemption = text(
        {
            "below": join(lit("Total "), paid, lit(" below $600 threshold")),
            "government": lit("Government agency or tax payment — exempt"),
            "financial": lit("Bank, insurance, or financial institution — exempt"),
            "shipping": lit("Freight / shipping carrier — exempt from 1099-NEC"),
            "cloud_corp": join(lit("Cloud/digital services from corporation ("), ent, lit(") — exempt")),
            "meals": lit("Ride share / food delivery — typically meal/travel expense"),
            "merchandise": lit("Merchandise/retail — 1099-NEC covers services only"),
            "utility": lit("Utility / telephone — exempt from 1099-NEC"),
            "staffing_corp": join(lit("Staffing agency incorporated ("), ent, lit(") — exempt")),
            "corporation": join(lit("Corporation ("), ent, lit(") — exempt from 1099-NEC")),
        }
    )
    exception = text(
        {
            "attorney": lit("Attorney exception — file regardless of entity type (IRS §6045(f))"),
            "medical_corp": lit("Medical exception — corporations included for Box 6"),
        }
    )
    wording = F.create_map(*[F.lit(x) for kv in E.ENTITY_WORDING.items() for x in kv])
    doubts = F.concat_ws(
        "; ",
        F.when(ent == "", "entity type unknown — could not determine if individual or corporation"),
        F.when(conf < E.LOW_CONFIDENCE, join(lit("vendor name confidence "), percent(conf),
                                             lit(" — verify this is the correct payee"))),
    )
    nec = join(lit("File 1099-NEC for "), paid)
    notes = text(
        {
            "below": join(lit("No 1099 required. Total paid "), paid, lit(" < $600 threshold.")),
            "government": join(name, lit(" appears to be a government entity or tax payment. No 1099 required.")),
            "financial": join(name, lit(" is a financial institution. Loan payments, premiums, and fees to banks are not 1099-reportable.")),
            "shipping": join(name, lit(" is a shipping carrier. Freight charges are exempt from 1099-NEC per IRS rules.")),
            "attorney": join(nec, lit(". Attorney and legal fees require 1099 filing regardless of corporate status. Obtain W-9 if not on file.")),
            "medical_corp": join(lit("File 1099-MISC Box 6 for "), paid, lit(". Medical/healthcare payments to corporations are reportable. Obtain W-9 if not on file.")),
            "medical": join(nec, lit(". Medical/healthcare provider (non-corporate). Obtain W-9 if not on file.")),
            "cloud_corp": join(name, lit(" is a corporation providing digital services. Corporations are exempt from 1099-NEC.")),
            "cloud": join(nec, lit(". "), name, lit(" provides digital/cloud services. Service fees are 1099-reportable. Obtain W-9 if not on file.")),
            "meals": join(name, lit(" is a ride share or food delivery platform. These are typically meal or travel reimbursements, not vendor service payments.")),
            "merchandise": join(name, lit(" is a retail or merchandise vendor. 1099-NEC applies to services, not goods purchases.")),
            "utility": join(name, lit(" is a utility or telephone provider. These are generally exempt from 1099-NEC reporting.")),
            "staffing_corp": join(name, lit(" is an incorporated staffing agency. Corporations are exempt from 1099-NEC.")),
            "staffing": join(nec, lit(". "), name, lit(" is a staffing or recruiting service. Obtain W-9 if not on file.")),
            "corporation": join(name, lit(" is incorporated ("), ent, lit("). Corporations are generally exempt from 1099-NEC reporting.")),
            "review": join(lit("Likely requires 1099-NEC for "), paid, lit(" but needs human review: "), doubts,
                           lit(". Obtain W-9 and confirm entity type before filing.")),
            "known": join(nec, lit(". "), name, lit(" is a "), F.coalesce(wording[ent], ent),
                          lit(", subject to 1099-NEC for service payments. Obtain W-9 if not already on file.")),
        }
    )
    return df.withColumns(
        {
            "form_type": form,
            "eligible": form != "EXEMPT",
            "threshold_met": rule != "below",
            "threshold_amount": F.lit(E.FILING_THRESHOLD),
            "needs_w9": form != "EXEMPT",
            "exemption_reason": exemption,
            "exception_reason": exception,
            "notes": notes,
            "w9_on_file": F.lit("Unknown"),
        }
    ).drop("_rule", "_ent")


def spend_category(name: Column, entity: Column) -> Column:
    """Worksheet category; utility words go before retail words."""
    upper = F.upper(name)
    return (
        F.when(contains_any(upper, R.UTILITY_WORDS), "Utility")
        .when(contains_any(upper, R.RETAIL_WORDS), "Supplies/Retail")
        .when(entity.isin(R.CONTRACTOR_TYPES), "Contractor")
        .otherwise("Unclear")
    )
