"""Quality rules: counts per document and an n-gram log-likelihood ratio.

Words and pairs of words are hashed into ``BUCKETS`` cells. One pass over all documents
counts the cells in the raw corpus and in a trusted part, the documents that ``labels`` marks
as good, all of them. The trusted multinomial
is smoothed by the raw one. A document's score is the mean of ``log(trusted / raw)`` over
its n-grams, and it is kept when no base rule fails and the score reaches ``MIN_RATIO``.

Null or empty text: no words, ratio 0, base_failed. Null doc_id: judged like any other row.
Repeated rows: one result each. Without trusted documents every ratio is 0. An empty table gives none.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glassledger.llm.words import Texts, grams, map_texts, mix, runs, segment_codes

BUCKETS = 1 << 16
MIN_RATIO = -0.2
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"[#*$%&|<>]")] = True
_SYMBOL[list(b"[]")] = False


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def _cells(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all words and pairs, and the text each belongs to."""
    words = texts.words()
    codes, row, left = words.codes(), words.row, words.left()
    pairs = grams(codes, 2, 3)
    inside = left[:len(pairs)] > 1
    cells = np.concatenate([mix(codes, 5), pairs[inside]]) & np.uint64(BUCKETS - 1)
    return cells.astype(np.int64), np.concatenate([row, row[:len(pairs)][inside]])


def cell_counts(documents: DataFrame, trusted: DataFrame) -> DataFrame:
    """(cell, raw, trusted): n-grams of the whole corpus. Each task sends one row a cell at most."""
    # by shuffle for any number of ids; rows without a doc_id meet nothing and are dealt out by their text
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0)
    marked = (documents.select("doc_id", "text", spread.alias("_spread"))
              .join(trusted.withColumns({"good": F.lit(True), "_spread": F.lit(0).cast("long")}).hint("shuffle_hash"), ["doc_id", "_spread"], "left").select("text", "good"))

    def count(batches):
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for rows, texts in runs(batches):
            cells, row = _cells(texts)
            raw += np.bincount(cells, minlength=BUCKETS)
            chosen = np.asarray(rows.column("good").fill_null(False)).astype(bool)[row]
            good += np.bincount(cells[chosen], minlength=BUCKETS)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(good[seen])], ["cell", "raw", "trusted"])

    return (marked.mapInArrow(count, "cell long, raw long, trusted long")
            .groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """log(trusted / raw) of every cell: BUCKETS numbers, whatever the corpus holds."""
    table = counts.toPandas()
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[table["cell"]], good[table["cell"]] = table["raw"], table["trusted"]
    if not good.sum():
        return np.zeros(BUCKETS)
    share = raw / raw.sum()
    smoothed = (good + BUCKETS * share) / (good.sum() + BUCKETS)
    return np.log(np.divide(smoothed, share, out=np.ones(BUCKETS), where=share > 0))


def repeated_lines(texts: Texts) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    data, offsets = texts.data, texts.offsets
    breaks = np.flatnonzero(data == 10)
    some = np.flatnonzero(np.diff(offsets))
    starts = np.sort(np.concatenate([offsets[some], breaks + 1]))
    ends = np.sort(np.concatenate([offsets[some + 1], breaks]))
    row = np.searchsorted(offsets, starts, "right") - 1
    closing = starts >= np.append(offsets[1:], len(data))[np.minimum(row, texts.rows - 1)]
    # a text that ends with a line break has an empty last line, which has no word
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~np.isin(data, (32, 9, 10, 11, 12, 13)), out=filled[1:])
    real = (ends > starts) & ~closing
    starts, ends, row = starts[real], ends[real], row[real]
    real = filled[ends] > filled[starts]
    starts, ends, row = starts[real], ends[real], row[real]
    keys = np.unique(np.stack([row.astype(np.uint64), segment_codes(data, starts, ends)]), axis=1)[0] if len(row) else row
    return np.bincount(row, minlength=texts.rows) - np.bincount(np.asarray(keys, np.int64), minlength=texts.rows)


def repeated_words(texts: Texts, words, codes: np.ndarray, n: int = 8) -> np.ndarray:
    """Words of each text inside windows of n words that the text has twice or more."""
    windows = grams(codes, n, 11)
    at = np.flatnonzero(words.left()[:len(windows)] >= n)
    if not len(at):
        return np.zeros(texts.rows, np.int64)
    keys = windows[at] ^ mix(words.row[at].astype(np.uint64), 13)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, at[again], 1)
    np.add.at(edge, at[again] + n, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    return covered[words.first[1:]] - covered[words.first[:-1]]


def quality_rules(documents: DataFrame, labels: DataFrame, min_ratio: float = MIN_RATIO) -> DataFrame:
    ratios = log_ratios(cell_counts(documents, trusted_ids(labels)))

    def judge(rows, texts):
        words = texts.words()
        codes = words.codes()
        points = texts.sums((texts.data & 0xC0) != 0x80)
        spaces = texts.sums(np.isin(texts.data, (32, 9, 10, 11, 12, 13)))
        cells, row = _cells(texts)
        n = np.bincount(row, minlength=texts.rows)
        ratio = np.bincount(row, ratios[cells], minlength=texts.rows) / np.maximum(n, 1)
        again = repeated_words(texts, words, codes)
        failed = (words.count < 20) | (100 * again > 30 * words.count)
        return {"doc_id": rows.column("doc_id"), "n_words": words.count, "word_chars": points - spaces,
                "n_symbols": texts.sums(_SYMBOL[texts.data]), "n_dup_lines": repeated_lines(texts), "n_repeat_words": again,
                "base_failed": failed, "kept": ~failed & (ratio >= min_ratio), "log_ratio": ratio}

    return map_texts(documents.select("doc_id", "text"), judge,
                     "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                     "base_failed boolean, kept boolean, log_ratio double")
