"""Cross-statement vendor consolidation end to end."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cross_check as X
from ..operators import review_flags as flags
from ..operators import vendor_rollup as V
from ..operators.classify_rows import fill_defaults
from ..operators.vendor_names import normalise_vendors
from .stored import stored


def with_extraction_confidence(vendors: DataFrame, statements: DataFrame) -> DataFrame:
    conf = statements.select("statement", F.col("confidence").alias("extraction_confidence"))
    return vendors.join(conf, "statement", "left")


@dataclass
class Consolidation:
    """The frames of one run; lazy over the rows, which are written once."""

    rows: DataFrame  # statement rows with vendor columns
    vendors: DataFrame  # per statement and vendor, with eligibility
    good: DataFrame  # the same, of statements that count
    reasons: DataFrame  # flagged vendors with their reasons
    matches: DataFrame
    mismatches: DataFrame
    variants: DataFrame
    near_threshold: DataFrame
    pooled: DataFrame  # per vendor over all statements, with eligibility
    excluded: DataFrame | None = None  # statements that failed, with the reason

    def close(self) -> None:
        self.vendors.unpersist()


def normalised_rows(rows: DataFrame, vendor_list: DataFrame | None = None) -> DataFrame:
    return normalise_vendors(fill_defaults(rows), vendor_list)


def statement_vendors(rows: DataFrame, vendor_list: DataFrame | None = None) -> DataFrame:
    """Per statement and vendor: totals, eligibility and the order keys."""
    v = V.classify_1099(V.roll_up_descriptions(fill_defaults(rows), ["statement"], vendor_list))
    return X.rank_vendors(v.withColumn("statement_key", F.col("statement")))


def consolidate(
    rows: DataFrame, vendor_list: DataFrame | None = None, with_variants: bool = True, statements: DataFrame | None = None
) -> Consolidation:
    """``rows``: statement rows (statement, line_no, date_raw, description, amount, ...).

    ``statements`` (statement, status, confidence, error_message) keeps failed statements, and those without a vendor, out of
    the whole review; they are listed as ``excluded``. Without it every statement counts.

    The per-statement rollup feeds every finding, so it is kept (in memory or on
    disk, rebuilt from the rows if an executor is lost); release it with
    ``Consolidation.close``. The rows are written once before, as the rollups per statement
    and over all statements, the sources and the sheets each read them.
    """
    rows = stored(fill_defaults(rows), "statement-rows")
    vendors, excluded = statement_vendors(rows, vendor_list), None
    if statements is not None:
        vendors = stored(vendors, "statement-vendors")  # counted per statement, then joined with the counts
        found = vendors.groupBy("statement").agg(F.count("*").alias("vendor_count"))
        known = statements.join(found, "statement", "left").withColumn("vendor_count", F.coalesce("vendor_count", F.lit(0)))
        processed, excluded = X.split_statements(known)
        vendors = with_extraction_confidence(vendors.join(processed.select("statement"), "statement", "left_semi"), statements)
        rows = rows.join(processed.select("statement"), "statement", "left_semi")
    vendors = vendors.persist()
    good = X.enough_statements(vendors)
    matches = X.cross_matches(good)
    mismatches = X.amount_mismatches(good)
    parts = [flags.statement_reasons(vendors), X.crossing_reasons(good, matches), X.mismatch_reasons(mismatches)]
    if with_variants:
        similar = X.similar_names(good)
        variants = X.name_variants(good, similar)
        parts.append(X.variant_reasons(X.variant_appearances(good, similar)))
    else:
        variants = None
    return Consolidation(
        rows=normalised_rows(rows, vendor_list),
        vendors=vendors,
        good=good,
        reasons=flags.merge_reasons(parts),
        matches=matches,
        mismatches=mismatches,
        variants=variants,
        near_threshold=X.near_threshold_vendors(good, matches),
        pooled=V.classify_1099(V.roll_up_descriptions(fill_defaults(rows), vendor_list=vendor_list)),
        excluded=excluded,
    )
