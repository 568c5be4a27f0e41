"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A document is contaminated by an item when some aligned window
of ``WINDOW`` consecutive words has at most ``MISSES`` words that differ; of an item with fewer words the whole is
the window, and one word may differ from ten words on. Items of fewer than ``LEAST_WORDS`` words tell nothing and match
nothing. Seeds look at six positions of a span and ignore the others; ``SEEDS`` are so chosen that every window
within the bound has a hit (``tests/llm`` goes through all placings of the differing words).

Test seeds are sent to every task only while they number ``BROADCAST_SEEDS`` at most (counted first); beyond, the two
sides are joined by a shuffle on the seed. Hits are few; each is then verified on the words around it.

Null or empty text: no words, clean. Null or empty items, or a null item_id: match nothing. Null doc_id: judged like any
other row; repeated rows give one result each. Equal items all count. Empty tables: no rows, or all clean.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 20
MISSES = 3
LEAST_WORDS = 7
SEEDS = ((0, 1, 2, 4, 5, 7), (0, 1, 2, 3, 5, 6))
BROADCAST_SEEDS = 1_000_000
_SPAN = 1 + max(max(s) for s in SEEDS)


def words(text: Column) -> Column:
    """The words; no text gives one empty word, which takes part in no seed."""
    return F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r")), "[\\x20\\x09-\\x0D]+")


def seeds(df: DataFrame, key: str) -> DataFrame:
    """(key, place, seed): every seed of every position. Neighbouring words come side by side by shifted copies of
    the list, so that hashing and joining stay in generated code."""
    codes = df.select(key, F.transform("_words", lambda w: F.xxhash64(w)).alias("_c"))
    shifted = F.arrays_zip(*(F.slice("_c", i + 1, F.greatest(F.size("_c"), F.lit(1))).alias(f"w{i}") for i in range(_SPAN)))
    rows = codes.select(key, F.posexplode(shifted).alias("place", "_at"))
    rows = rows.select(key, "place", *(F.col(f"_at.w{i}") for i in range(_SPAN)))
    # a position has a seed only where the whole span lies within the text
    each = [F.when(F.col(f"w{max(s)}").isNotNull(), F.xxhash64(F.lit(k), *(F.col(f"w{i}") for i in s))) for k, s in enumerate(SEEDS)]
    return rows.select(key, "place", F.explode(F.array(*each)).alias("seed")).where(F.col("seed").isNotNull())


def _matches(doc: Column, item: Column, shift: Column) -> Column:
    """Whether a window of the item, laid over the document at the shift, is within the bound."""
    n = F.size(item)
    wide = F.least(n, F.lit(WINDOW))
    least = wide - F.when(n >= WINDOW, MISSES).when(n >= 10, 1).otherwise(0)
    same = F.transform(item, lambda w, j: F.when((shift + j >= 0) & (F.get(doc, (shift + j).cast("int")) == w), 1).otherwise(0))
    begins = F.sequence(F.greatest(F.lit(0), -shift), n - wide)
    fits = lambda s: (s + shift + wide <= F.size(doc)) & (F.aggregate(F.slice(same, s + 1, wide), F.lit(0), lambda a, x: a + x) >= least)
    return F.when(F.greatest(F.lit(0), -shift) <= n - wide, F.exists(begins, fits)).otherwise(False)


def decontaminate(documents: DataFrame, benchmark: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """doc_id, n_items, first_item, contaminated of every document."""
    items = (benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").alias("_item"), words(F.col("text")).alias("_words"))
             .where(F.size("_words") >= LEAST_WORDS))
    tests = seeds(items, "_item").select("_item", F.col("place").alias("_iplace"), "seed")
    if tests.limit(broadcast_seeds + 1).count() <= broadcast_seeds:
        tests = F.broadcast(tests)
    docs = documents.select("doc_id", words(F.col("text")).alias("_words"))
    hits = seeds(docs, "doc_id").join(tests, "seed").select("doc_id", "_item", (F.col("place") - F.col("_iplace")).alias("_shift")).distinct()
    found = (hits.join(items.withColumnRenamed("_words", "_iwords"), "_item")
             .groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list(F.struct("_item", "_shift", "_iwords")).alias("_hits")))
    judged = (documents.select("doc_id", "text").join(found, F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
              .select("doc_id", "_hits", F.when(F.col("_hits").isNotNull(), words(F.col("text"))).alias("_words")))
    real = F.filter("_hits", lambda h: _matches(F.col("_words"), h["_iwords"], h["_shift"]))
    listed = F.when(F.col("_hits").isNotNull(), F.array_distinct(F.transform(real, lambda h: h["_item"])))
    judged = judged.select("doc_id", listed.alias("_items"))
    n = F.when(F.col("_items").isNull(), 0).otherwise(F.size("_items")).cast("long")
    return judged.select("doc_id", n.alias("n_items"), F.array_min("_items").alias("first_item"), (n > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
i AS (SELECT item_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM benchmark WHERE item_id IS NOT NULL),
items AS (SELECT item_id, w, len(w) n, least(len(w), 20) wide, CASE WHEN len(w) >= 20 THEN 3 WHEN len(w) >= 10 THEN 1 ELSE 0 END miss
          FROM i WHERE len(w) >= 7),
dw AS (SELECT doc_id, len(w) nd, unnest(w) word, generate_subscripts(w, 1) - 1 p FROM d),
iw AS (SELECT item_id, unnest(w) word, generate_subscripts(w, 1) - 1 q FROM items),
same AS (SELECT doc_id, item_id, p - q AS shift, any_value(nd) nd, list(q) qs FROM dw JOIN iw USING (word) GROUP BY ALL HAVING count(*) >= 6),
windows AS (SELECT doc_id, item_id, shift, nd, qs, wide, miss, unnest(range(0, n - wide + 1)) s FROM same JOIN items USING (item_id)),
found AS (SELECT DISTINCT doc_id, item_id FROM windows
          WHERE s + shift >= 0 AND s + shift + wide <= nd AND len(list_filter(qs, lambda q: q >= s AND q < s + wide)) >= wide - miss)
SELECT d.doc_id, count(item_id) n_items, min(item_id) first_item, count(item_id) > 0 AS contaminated
FROM d LEFT JOIN found USING (doc_id) GROUP BY d.doc_id
"""
