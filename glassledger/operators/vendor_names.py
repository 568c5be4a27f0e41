"""From statement descriptions to canonical vendor names."""
from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import Target, common_character_bound
from ..functions.text import one_of, squeeze, strip
from ..plans.joins import join_summary, measure_keys
from ..rules import vendors as R

LEADING_REGEX = r"(?i)^(?:\s*(?:" + R.LEADING_DESCRIPTORS + r")\s*[-–:]\s*)+"
BLOCK_NAMES = 256


@dataclass(frozen=True)
class Profile:
    """Which of the two rule sets is used."""

    noise: tuple[str, ...]
    suffixes: tuple[str, ...]
    keep_upper: tuple[str, ...]
    exclude: bool


CONSOLIDATED = Profile(tuple(R.NOISE), tuple(R.SUFFIXES), tuple(R.KEEP_UPPER), True)
WORKSHEET = Profile(tuple(R.WORKSHEET_NOISE), tuple(R.WORKSHEET_SUFFIXES), tuple(R.WORKSHEET_KEEP_UPPER), False)
PROFILES = {"consolidated": CONSOLIDATED, "worksheet": WORKSHEET}


def preclean(description: Column) -> Column:
    """Drops stacked leading descriptors such as ``ACH Payment -``; never empties a text."""
    desc = F.coalesce(description, F.lit(""))
    rest = strip(F.regexp_replace(strip(desc), LEADING_REGEX, ""))
    return F.when(rest == "", desc).otherwise(rest)


def reason_of(pattern: str) -> str:
    shown = pattern.replace("\\b", "").replace("\\s+", " ").strip()
    return f"deposit/transfer: {shown[:R.REASON_WIDTH]}"


def is_non_vendor(raw: Column) -> Column:
    """One look for all exclusion patterns together."""
    return strip(raw).rlike(R.EMBEDDED_AMOUNT) | F.upper(raw).rlike(one_of(R.NON_VENDOR))


def non_vendor_reason(raw: Column) -> Column:
    """Why a text is no vendor; null when it may be one."""
    out = F.when(strip(raw).rlike(R.EMBEDDED_AMOUNT), "embedded_amount")
    for p in R.NON_VENDOR:
        out = out.when(raw.rlike("(?i)" + p), reason_of(p))
    return out


def strip_noise(raw: Column, profile: Profile = CONSOLIDATED) -> Column:
    s = upper = strip(F.upper(raw))
    for p in profile.noise:
        s = F.regexp_replace(s, p, " ")
    # most names hold no noise at all and need one look only
    return squeeze(F.when(upper.rlike(one_of(profile.noise)), s).otherwise(upper))


def suffix_regex(profile: Profile = CONSOLIDATED) -> str:
    return r"\b(" + "|".join(re.escape(s) for s in profile.suffixes) + r")\.?\s*$"


def entity_type(name: Column, profile: Profile = CONSOLIDATED) -> Column:
    found = F.regexp_extract(strip(F.upper(name)), suffix_regex(profile), 1)
    return F.nullif(F.replace(found, F.lit("."), F.lit("")), F.lit(""))


def without_suffix(name: Column, profile: Profile = CONSOLIDATED) -> Column:
    upper = strip(F.upper(name))
    pattern = suffix_regex(profile)
    bare = strip(F.regexp_replace(strip(F.regexp_replace(upper, pattern, "")), ",+$", ""))
    return F.when(upper.rlike(pattern), bare).otherwise(upper)


def display_name(name: Column, profile: Profile = CONSOLIDATED) -> Column:
    """Title case, with a few short words kept in capitals."""
    words = F.filter(F.split(name, r"\s+"), lambda w: w != "")
    keep = list(profile.keep_upper)
    shown = F.transform(
        words,
        lambda w: F.when(F.upper(w).isin(keep), F.upper(w)).otherwise(
            F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))
        ),
    )
    return F.array_join(shown, " ")


# --- nearest name in a vendor list ------------------------------------------


def _blocks(n: int) -> int:
    return max(1, -(-n // BLOCK_NAMES))


def nearest_in_list(
    names: DataFrame, vendor_list: DataFrame, profile: Profile = CONSOLIDATED, n_names: int | None = None
) -> DataFrame:
    """Best list entry for each distinct ``bare_name``: (bare_name, match, score, shown_score).

    ``vendor_list`` has ``pos`` and ``name``; the earlier entry wins equal scores.
    A name that is an entry, capitals aside, has the only score of 1 and is found by a join.
    The others and the list are cut into blocks of some ``BLOCK_NAMES`` each, and only the best of each
    pair of blocks leaves it, so neither side is ever held whole. Within a block entries are taken by
    falling bounds, until the next bound is below the best score; that score is kept even below any threshold.
    """
    names = names.select("bare_name").distinct()
    entries = vendor_list.select("pos", "name", without_suffix(F.col("name"), profile).alias("entry"))
    first = entries.groupBy(F.upper("entry").alias("_entry")).agg(F.min(F.struct("pos", "name")).alias("_first"))
    looked_up = names.join(first, F.upper("bare_name") == F.col("_entry"), "left")
    equal = looked_up.where("_entry IS NOT NULL AND _entry <> ''").select(
        "bare_name", F.col("_first")["name"].alias("match"), F.lit(1.0).alias("score"), F.lit(1.0).alias("shown_score"))
    others = looked_up.where("_entry IS NULL OR _entry = ''").select("bare_name")
    nb, lb = _blocks(names.count() if n_names is None else n_names), _blocks(entries.count())
    left = others.select(
        "bare_name",
        F.pmod(F.xxhash64("bare_name"), F.lit(nb)).alias("nb"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lb - 1).cast("long"))).alias("lb"),
    )
    right = entries.select(
        "pos", "name", "entry",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nb - 1).cast("long"))).alias("nb"),
        F.pmod(F.xxhash64("pos", "name"), F.lit(lb)).alias("lb"),
    )

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        b = b.sort_values(["pos", "name"])
        entries_, pos, shown = b["entry"].tolist(), b["pos"].tolist(), b["name"].tolist()
        texts = a["bare_name"].tolist()
        if entries_ and texts:
            bound = common_character_bound(texts, entries_)
            targets = [Target(e) for e in entries_]
            for i, t in enumerate(texts):
                upper, score, at = t.upper(), 0.0, None
                for j in np.argsort(-bound[i], kind="stable"):
                    if bound[i, j] < score:
                        break
                    if targets[j].bound(upper) < score:
                        continue
                    s = targets[j].ratio(upper)
                    if s > score or (s == score and s > 0 and j < at):
                        score, at = s, j
                if at is not None:
                    rows.append((t, shown[at], pos[at], score, round(score, 2)))
        return pd.DataFrame(rows, columns=["bare_name", "match", "pos", "score", "shown_score"])

    # small rows, costly comparisons: not to be put together into few tasks by size
    tasks = min(nb * lb, 4 * names.sparkSession.sparkContext.defaultParallelism)
    found = (
        left.repartition(tasks, "nb", "lb").groupBy("nb", "lb")
        .cogroup(right.repartition(tasks, "nb", "lb").groupBy("nb", "lb"))
        .applyInPandas(best, "bare_name string, match string, pos long, score double, shown_score double")
    )
    best_first = F.struct("score", -F.col("pos"))
    nearest = found.groupBy("bare_name").agg(
        F.max_by("match", best_first).alias("match"),
        F.max("score").alias("score"),
        F.max("shown_score").alias("shown_score"),
    )
    return equal.unionByName(nearest)


# --- the whole normalisation -------------------------------------------------


def normalise_vendors(
    df: DataFrame,
    vendor_list: DataFrame | None = None,
    profile: str = "consolidated",
    match_threshold: float = R.MATCH_THRESHOLD,
    review_threshold: float = R.REVIEW_THRESHOLD,
    raw: str = "description",
    preclean_first: bool = True,
) -> DataFrame:
    """Adds raw_name, cleaned_name, canonical_name, entity_type, match_confidence,
    needs_review, norm_excluded and norm_reason to statement rows.

    Without a vendor list everything is a row expression and nothing is shuffled.
    """
    p = PROFILES[profile]
    name = preclean(F.col(raw)) if preclean_first else F.coalesce(F.col(raw), F.lit(""))
    out = F.col("norm_excluded")
    df = df.withColumn("raw_name", name).withColumns(
        {
            "norm_excluded": is_non_vendor(F.col("raw_name")) if p.exclude else F.lit(False),
            "cleaned_name": strip_noise(F.col("raw_name"), p),
        }
    )
    df = df.withColumn("norm_reason", F.when(out, non_vendor_reason(F.col("raw_name"))).otherwise(""))
    df = df.withColumns({"_bare": without_suffix(F.col("cleaned_name"), p), "_type": entity_type(F.col("cleaned_name"), p)})
    if vendor_list is None:
        df = df.withColumns({"_match": F.lit(None).cast("string"), "_score": F.lit(1.0), "_shown": F.lit(1.0)})
        listed = F.lit(False)
    else:
        bare = df.where(~out).select(F.col("_bare").alias("bare_name"))
        size = measure_keys(bare, {"bare": F.col("bare_name")})["bare"]
        nearest = nearest_in_list(bare, vendor_list, p, size.keys).withColumnsRenamed(
            {"bare_name": "_bare", "match": "_near", "score": "_near_score", "shown_score": "_near_shown"}
        )
        df = join_summary(df, nearest, "_bare", size, extra_bytes=160)
        listed = vendor_list.limit(1).agg((F.count("*") > 0).alias("x")).scalar()
        df = df.withColumns(
            {
                "_match": F.when(F.col("_near_score") >= match_threshold, F.col("_near")),
                "_score": F.when(listed, F.coalesce("_near_score", F.lit(0.0))).otherwise(1.0),
                "_shown": F.when(listed, F.coalesce("_near_shown", F.lit(0.0))).otherwise(1.0),
            }
        ).drop("_near", "_near_score", "_near_shown")
    short = (F.length(strip(F.col("_bare"))) < 3) | strip(F.col("_bare")).rlike(r"^\d+$")
    canonical = F.coalesce("_match", display_name(F.col("_bare"), p))
    return df.withColumns(
        {
            "canonical_name": F.when(out, F.concat(F.lit("[EXCLUDED] "), F.substring("raw_name", 1, 50)))
            .when(short, F.concat(F.lit("UNRESOLVED: "), F.col("raw_name")))
            .otherwise(canonical),
            "entity_type": F.when(~out, F.col("_type")),
            "match_confidence": F.when(out, 0.0).otherwise(F.col("_shown")),
            "needs_review": ~out & (short | (listed & (F.col("_score") < review_threshold))),
            "cleaned_name": F.when(out, F.col("raw_name")).otherwise(F.col("cleaned_name")),
        }
    ).drop("_bare", "_type", "_match", "_score", "_shown")
