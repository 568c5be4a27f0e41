"""Findings across statements: matches, crossings, mismatches, name variants.

Input is ``vendors``: one row per statement and vendor of the good statements,
with ``statement``, ``statement_key`` (a text that sorts statements in their given
order; the label when there is no other), ``canonical_name``,
``total_amount``, ``transaction_count`` and ``first_seen``.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import Target, common_character_bound
from ..functions.text import dollars, percent
from ..rules import vendors as R
from . import review_flags as flags

PAIR_BLOCK = 256
PART_ROWS = 2000


def split_statements(statements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(processed, excluded) of a frame with statement, status, vendor_count, error_message."""
    good = F.coalesce(F.col("status"), F.lit("failed_other")).isin("success", "partial") & (F.col("vendor_count") > 0)
    processed = statements.where(good)
    why = F.coalesce(F.nullif(F.col("error_message"), F.lit("")), F.lit("No vendor data extracted"))
    excluded = statements.where(~good).select("statement", F.coalesce("status", F.lit("failed_other")).alias("status"),
                                              why.alias("reason"))
    return processed, excluded


def enough_statements(vendors: DataFrame) -> DataFrame:
    """Nothing is compared across statements when fewer than two are good."""
    several = vendors.select("statement").distinct().limit(2).agg((F.count("*") > 1).alias("x")).scalar()
    return vendors.where(several)


def combined_totals(vendors: DataFrame) -> DataFrame:
    """Per vendor over all statements."""
    return vendors.groupBy("canonical_name").agg(
        F.count("*").alias("statement_count"),
        F.sum("total_amount").cast("decimal(18,2)").alias("combined_total"),
        F.max("total_amount").alias("largest"),
        F.sum("transaction_count").alias("transaction_count"),
    )


def cross_matches(vendors: DataFrame) -> DataFrame:
    """Vendors in two statements or more, and whether only their sum crosses the threshold."""
    return combined_totals(vendors).where("statement_count > 1").select(
        "canonical_name", "statement_count", "combined_total", "transaction_count",
        ((F.col("combined_total") >= R.THRESHOLD) & (F.col("largest") < R.THRESHOLD)).alias("crosses_threshold_combined_only"),
    )


def appearances(vendors: DataFrame, matches: DataFrame) -> DataFrame:
    """The statement rows behind each match, as rows."""
    return vendors.join(matches.select("canonical_name"), "canonical_name", "left_semi").select(
        "canonical_name", "statement", "statement_key", "total_amount", "transaction_count"
    )


def threshold_crossings(matches: DataFrame) -> DataFrame:
    return matches.where("crosses_threshold_combined_only")


def crossing_reasons(vendors: DataFrame, matches: DataFrame) -> DataFrame:
    text = F.concat(F.lit("Combined total across statements ("), dollars(F.col("combined_total")),
                    F.lit(") crosses $600 threshold"))
    hit = threshold_crossings(matches).select("canonical_name", text.alias("reason"))
    return vendors.select("statement", "canonical_name").join(hit, "canonical_name").select(
        "statement", "canonical_name", F.lit(flags.PHASE["combined_total"]).alias("phase"), F.lit("").alias("at"),
        F.lit("combined_total").alias("signal"), "reason",
    )


# --- amount mismatches ----------------------------------------------------------


def _scale(amount: Column) -> Column:
    """Power of five the amount lies in: a ratio above five spans at least one step."""
    return F.floor(F.log(R.MISMATCH_RATIO, amount.cast("double"))).cast("int")


def amount_mismatches(vendors: DataFrame) -> DataFrame:
    """Pairs of statements where one vendor's totals differ more than fivefold and by more than $500.

    The two totals of such a pair lie in different powers of five, so rows meet
    only across powers. A larger row must exceed $500, and each vendor's rows of
    one power are dealt over as many parts as they need, so that a vendor found
    in very many statements is compared by many tasks.
    """
    rows = vendors.where(F.col("total_amount") > 0).select(
        "canonical_name", "statement", "statement_key", "total_amount", _scale(F.col("total_amount")).alias("p")
    )
    sizes = rows.groupBy("canonical_name", "p").agg(F.count("*").alias("n"))
    # powers a vendor has, with the parts each is dealt over: a short list (powers of five of an amount)
    parts = F.ceil(F.col("n") / PART_ROWS).cast("int")
    powers = sizes.withColumn("parts", parts)
    low = rows.join(powers, ["canonical_name", "p"]).withColumn("lo_part", F.pmod(F.xxhash64("statement"), F.col("parts").cast("long")))
    blocks = powers.alias("h").join(
        powers.alias("l"),
        (F.col("h.canonical_name") == F.col("l.canonical_name")) & (F.col("h.p") > F.col("l.p")),
    ).select(
        F.col("h.canonical_name").alias("canonical_name"), F.col("h.p").alias("hp"), F.col("l.p").alias("lp"),
        F.col("l.parts").alias("lo_parts"),
    )
    high = (
        rows.where(F.col("total_amount") > R.MISMATCH_GAP)
        .withColumnRenamed("p", "hp")
        .join(blocks, ["canonical_name", "hp"])
        .withColumn("lo_part", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("lo_parts") - 1).cast("long"))))
        .select("canonical_name", "lp", "lo_part", F.struct("statement_key", "statement", "total_amount").alias("hi"))
    )
    low = low.select("canonical_name", F.col("p").alias("lp"), "lo_part",
                     F.struct("statement_key", "statement", "total_amount").alias("lo"))
    big, small = F.col("hi")["total_amount"].cast("double"), F.col("lo")["total_amount"].cast("double")
    pairs = high.join(low, ["canonical_name", "lp", "lo_part"]).where(
        (big / small > R.MISMATCH_RATIO) & (F.col("hi")["total_amount"] - F.col("lo")["total_amount"] > R.MISMATCH_GAP)
    )
    first = F.col("hi")["statement_key"] < F.col("lo")["statement_key"]
    a, b = F.when(first, F.col("hi")).otherwise(F.col("lo")), F.when(first, F.col("lo")).otherwise(F.col("hi"))
    return pairs.select(
        "canonical_name",
        a["statement"].alias("statement_a"), a["total_amount"].alias("amount_a"), a["statement_key"].alias("no_a"),
        b["statement"].alias("statement_b"), b["total_amount"].alias("amount_b"), b["statement_key"].alias("no_b"),
        (big / small).alias("ratio"),
        (F.col("hi")["total_amount"] - F.col("lo")["total_amount"]).cast("decimal(18,2)").alias("abs_diff"),
    )


def _at(*cols: str) -> Column:
    """A text that sorts like the tuple of the text columns ``cols``."""
    return F.concat_ws("\u0001", *[F.col(c) for c in cols])


def mismatch_reasons(mismatches: DataFrame) -> DataFrame:
    text = F.concat(
        F.lit("Possible extraction issue — "), dollars(F.col("amount_a")), F.lit(" in "), F.col("statement_a"),
        F.lit(" vs "), dollars(F.col("amount_b")), F.lit(" in "), F.col("statement_b"),
        F.lit(" ("), F.format_string("%.1f", "ratio"), F.lit("x variance)"),
    )
    return flags.both_sides(mismatches, "mismatch", text, _at("no_a", "no_b"), "canonical_name", "canonical_name")


# --- name variants ----------------------------------------------------------------


def similar_names(names: DataFrame, threshold: float = R.VARIANT_THRESHOLD) -> DataFrame:
    """All ordered pairs of distinct names whose ratio reaches ``threshold``: (name_a, name_b, similarity).

    Exact. Two such names have lengths within a factor t/(2-t), so names are put
    in bands of lengths and only neighbouring bands meet; within bands, blocks of
    some ``PAIR_BLOCK`` names meet pairwise. Of a pair of blocks the common-character
    bound is computed at once, that of the common subsequence for the pairs it leaves,
    and the ratio for those that both leave.
    """
    reach = threshold / (2 - threshold)
    names = names.select(F.col("canonical_name").alias("name")).distinct().where("name <> ''")
    step = -float(np.log(reach))
    names = names.withColumn("band", F.floor(F.log(F.length(F.upper("name")).cast("double")) / step).cast("int"))
    sizes = {r["band"]: r["n"] for r in names.groupBy("band").agg(F.count("*").alias("n")).collect()}  # one row per band
    if not sizes:
        return names.sparkSession.createDataFrame([], "name_a string, name_b string, similarity double")
    start, at = {}, 0
    for band in sorted(sizes):
        start[band] = at
        at += max(1, -(-sizes[band] // PAIR_BLOCK))
    count = {b: max(1, -(-sizes[b] // PAIR_BLOCK)) for b in sizes}

    def by_band(values: dict[int, int]) -> Column:
        return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col("band")]

    # a pair of neighbouring bands meets; all others are too unlike in length
    low = {b: start.get(b - 1, start[b]) for b in sizes}
    high = {b: (start[b + 1] + count[b + 1] if b + 1 in start else start[b] + count[b]) - 1 for b in sizes}
    blocked = names.withColumn(
        "block", (by_band(start) + F.pmod(F.xxhash64("name"), by_band(count).cast("bigint"))).cast("int")
    )
    met = blocked.withColumn("other", F.explode(F.sequence(by_band(low), by_band(high)))).select(
        "name", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        left = sorted(pdf.loc[pdf["block"] == lo, "name"])
        right = left if lo == hi else sorted(pdf.loc[pdf["block"] == hi, "name"])
        rows = []
        if left and right:
            near = common_character_bound(left, right) >= threshold
            if lo == hi:
                near = np.triu(near, 1)
            targets = {name: Target(name) for name in {*left, *right}}
            for i, j in zip(*np.nonzero(near)):
                a, b = left[i], right[j]
                if targets[b].bound(a.upper()) >= threshold:
                    for x, y in ((a, b), (b, a)):
                        s = targets[y].ratio(x.upper())
                        if s >= threshold:
                            rows.append((x, y, s))
        return pd.DataFrame(rows, columns=["name_a", "name_b", "similarity"])

    # small rows, costly comparisons: not to be put together into few tasks by size
    n_pairs = at * (at + 1) // 2
    dealt = met.repartition(min(n_pairs, 4 * names.sparkSession.sparkContext.defaultParallelism), "lo", "hi")
    return dealt.groupBy("lo", "hi").applyInPandas(compare, "name_a string, name_b string, similarity double")


def variant_appearances(vendors: DataFrame, similar: DataFrame) -> DataFrame:
    """Every pair of an earlier and a later statement that hold two similar names."""
    side = vendors.select("canonical_name", "statement", "statement_key", "total_amount", "vendor_rank")

    def of(letter: str) -> DataFrame:
        new = {"canonical_name": f"name_{letter}", "statement": f"statement_{letter}", "statement_key": f"no_{letter}",
               "total_amount": f"amount_{letter}", "vendor_rank": f"rank_{letter}"}
        return side.withColumnsRenamed(new)

    return similar.join(of("a"), "name_a").join(of("b"), "name_b").where("no_a < no_b")


def variant_reasons(found: DataFrame) -> DataFrame:
    text = F.concat(
        F.lit('Name variant detected — "'), F.col("name_a"), F.lit('" in '), F.col("statement_a"),
        F.lit(' ~ "'), F.col("name_b"), F.lit('" in '), F.col("statement_b"),
        F.lit(" ("), percent(F.col("similarity")), F.lit(" similar)"),
    )
    return flags.both_sides(found, "variant", text, _at("no_a", "no_b", "rank_a", "rank_b"), "name_a", "name_b")


def name_variants(vendors: DataFrame, similar: DataFrame) -> DataFrame:
    """One row per unordered pair of names: the first found, the earlier name in the alphabet as A.

    The first find of (a, b) has a's earliest statement and b's next one after
    it, so the pairs of statements need not be listed to find it.
    """
    spot = F.struct("statement_key", "vendor_rank", "statement", "total_amount")
    first_a = vendors.groupBy(F.col("canonical_name").alias("name_a")).agg(F.min(spot).alias("a"))
    later_b = vendors.select(F.col("canonical_name").alias("name_b"), spot.alias("b"))
    found = (
        similar.join(first_a, "name_a").join(later_b, "name_b")
        .where(F.col("b")["statement_key"] > F.col("a")["statement_key"])
        .groupBy("name_a", "name_b")
        .agg(F.first("similarity").alias("similarity"), F.first("a").alias("a"), F.min("b").alias("b"))
    )
    order = F.struct(F.col("a")["statement_key"], F.col("b")["statement_key"], F.col("a")["vendor_rank"], F.col("b")["vendor_rank"])
    ua, ub = F.upper("name_a"), F.upper("name_b")
    first = found.groupBy(F.least(ua, ub).alias("_lo"), F.greatest(ua, ub).alias("_hi")).agg(
        F.min_by(F.struct("name_a", "name_b", "similarity", "a", "b"), order).alias("x")
    )
    x = F.col("x")
    swap = F.upper(x["name_a"]) > F.upper(x["name_b"])
    one, two = F.when(swap, x["b"]).otherwise(x["a"]), F.when(swap, x["a"]).otherwise(x["b"])
    return first.select(
        F.when(swap, x["name_b"]).otherwise(x["name_a"]).alias("name_a"),
        F.when(swap, x["name_a"]).otherwise(x["name_b"]).alias("name_b"),
        x["similarity"].alias("similarity"),
        one["total_amount"].alias("amount_a"), two["total_amount"].alias("amount_b"),
        one["statement"].alias("statement_a"), two["statement"].alias("statement_b"),
    )


def rank_vendors(vendors: DataFrame) -> DataFrame:
    """Position of a vendor inside its statement: larger total first, then first seen.

    Written as a sortable text rather than a row number, so no statement has to
    be sorted in one task.
    """
    cents = (F.lit(10**15) - (F.col("total_amount") * 100).cast("bigint")).cast("string")
    seen = F.lpad(F.col("first_seen")["line_no"].cast("string"), 19, "0")
    return vendors.withColumn("vendor_rank", F.concat(F.lpad(cents, 17, "0"), F.lit("/"), seen))


# --- near threshold ----------------------------------------------------------------


def near_threshold_vendors(vendors: DataFrame, matches: DataFrame) -> DataFrame:
    """Combined totals in the review zone, then single-statement totals in it."""
    zone = lambda c: F.col(c).between(R.NEAR_LOW, R.NEAR_HIGH)
    combined = matches.where(zone("combined_total")).select(
        "canonical_name", F.col("combined_total").alias("total_amount"), F.lit("Combined").alias("statement")
    )
    single = (
        vendors.where(zone("total_amount"))
        .join(matches.select("canonical_name"), "canonical_name", "left_anti")
        .select("canonical_name", "total_amount", "statement")
    )
    distance = (F.lit(R.THRESHOLD).cast("decimal(18,2)") - F.col("total_amount")).cast("decimal(18,2)")
    return combined.unionByName(single).withColumn("distance_to_threshold", distance)
