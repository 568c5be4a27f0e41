"""Text and money helpers as JVM-side column expressions."""
from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\f\v"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def one_of(patterns: Iterable[str]) -> str:
    """Several regexes as one; those that start at a word boundary share it."""
    patterns = list(patterns)
    at_word = [p[2:] for p in patterns if p.startswith(r"\b")]
    rest = [p for p in patterns if not p.startswith(r"\b")]
    return "|".join(([r"\b(?:" + "|".join(at_word) + ")"] if at_word else []) + rest)


def contains_any(c: Column, words: Iterable[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | c.contains(w)
    return hit


def first_word(c: Column, words: Iterable[str]) -> Column:
    """The first of ``words`` (in list order) found in ``c``, else null."""
    return F.coalesce(*[F.when(c.contains(w), F.lit(w)) for w in words])


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def dollars(c: Column) -> Column:
    """``$1,234.50``; negatives read ``$-5.00``."""
    return F.concat(F.lit("$"), F.format_number(c, 2))


def percent(c: Column) -> Column:
    """Whole percent, halves to even."""
    return F.concat(F.bround(c * 100, 0).cast("int").cast("string"), F.lit("%"))


def to_decimal(c: Column) -> Column:
    return c.try_cast("decimal(18,2)")


def parse_amount(c: Column) -> Column:
    """``1,200.00`` / ``$45.99`` / ``(45.99)`` -> decimal; null when not a number."""
    bare = strip(F.regexp_replace(c, r"[,$]", ""))
    return to_decimal(F.regexp_replace(bare, r"^\((.*)\)$", "-$1"))


def python_list(c: Column) -> Column:
    """Show an array of strings as ``['a', 'b']``."""
    return F.concat(F.lit("['"), F.array_join(c, "', '"), F.lit("']"))


def title(s: str) -> str:
    return re.sub(r"[A-Za-z]+", lambda m: m.group(0).capitalize(), s)
