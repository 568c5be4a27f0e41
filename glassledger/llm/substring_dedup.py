"""Substring dedup by prefix-partitioned suffix trees over words.

A window is ``WINDOW`` consecutive words. Its words go when the same window also starts in a document of a smaller doc_id.

1. Every window is filed under one prefix, its smallest ``PREFIX``-word gram by hash. Neighbouring windows mostly share it, so
   they travel as one string. Prefixes that occur in one document only cannot repeat; their strings are not sent at all.
2. Equal strings are one, with their smallest doc_id, so a passage that a third of all documents share is one row a task.
3. Strings are dealt by prefix into groups. A prefix with more than ``GROUP`` different strings is lengthened: its strings fall apart into
   windows, dealt by all their words. A task builds the subtree of as many groups as fill its memory: suffixes are
   named level by level (1, 2, 4, 8, 13 words), equal names at the last level being the internal nodes of that depth or more.
4. Each node's smallest doc_id goes back to the strings, from there to the places of every document.

Null text: no words. Null doc_id: nothing is removed, and nothing because of it. Rows that repeat a doc_id: none is the other's
copy; what is found for one is removed from both where their windows agree. Fewer words than a window: none goes. Empty table: no rows.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glassledger.llm.store import keep
from glassledger.llm.words import Texts, grams, map_texts, runs, texts_of

WINDOW = 13
PREFIX = 4
GROUP = 20_000
_FULL = 15_000


def _filed(texts: Texts, window: int):
    """The strings of windows filed under one place: text, prefix code, first window, number of windows; and the words."""
    words = texts.words()
    codes = words.codes()
    start = np.flatnonzero(words.left() >= window)
    if not len(start):
        return words, *(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))
    gram = grams(codes, PREFIX, 41)
    best, place = gram[start], start.copy()
    for i in range(1, window - PREFIX + 1):
        less = gram[start + i] < best
        best, place = np.where(less, gram[start + i], best), np.where(less, start + i, place)
    row = words.row[start]
    new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (row[1:] != row[:-1])))
    return words, row[new], best[new], start[new], np.diff(np.append(new, len(start)))


def prefixes(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, prefix), once for each document."""
    def task(batches):
        for rows, texts in runs(batches):
            _, row, prefix, _, _ = _filed(texts, window)
            order = np.lexsort((prefix, row))
            row, prefix = row[order], prefix[order]
            new = np.append(True, (row[1:] != row[:-1]) | (prefix[1:] != prefix[:-1])) if len(row) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(row[new])), pa.array(prefix[new].view(np.int64))], ["doc", "prefix"])

    return documents.select("doc_id", "text").where("doc_id is not null").mapInArrow(task, "doc long, prefix long")


def _strings(texts_with_prefixes: DataFrame, window: int) -> DataFrame:
    """(prefix, doc, place, string) of the windows filed under a prefix that repeats."""
    def task(batches):
        for rows, texts in runs(batches):
            words, row, prefix, first, n = _filed(texts, window)
            lists = rows.column("prefixes")
            of = np.repeat(np.arange(texts.rows), np.diff(np.asarray(lists.offsets)))
            wanted = np.sort(_pair(of, np.asarray(lists.flatten()).view(np.uint64)))
            mine = _pair(row, prefix)
            at = np.minimum(np.searchsorted(wanted, mine), max(len(wanted) - 1, 0))
            chosen = np.flatnonzero(wanted[at] == mine) if len(wanted) else np.zeros(0, np.int64)
            raw = texts.data.tobytes()
            begins, ends = words.start[first[chosen]], words.end[first[chosen] + n[chosen] + window - 2]
            strings = [b" ".join(raw[a:b].split()) for a, b in zip(begins.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([
                pa.array(prefix[chosen].view(np.int64)), rows.column("doc_id").take(pa.array(row[chosen])),
                pa.array(first[chosen] - words.first[row[chosen]]), pa.array(strings, pa.binary()).cast(pa.string())], ["prefix", "doc", "place", "string"])

    return texts_with_prefixes.mapInArrow(task, "prefix long, doc long, place long, string string")


def _pair(row: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    # only chooses what is sent: a chance equality sends a string too many, nothing else
    return prefix ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def node_names(codes: np.ndarray, window: int) -> np.ndarray:
    """A name for the ``window`` words from each position on, equal where the words are; the last positions have none."""
    name, wide = np.unique(codes, return_inverse=True)[1].astype(np.int64), 1
    while wide < window:
        step = min(wide, window - wide)
        pairs = name[:-step] * (len(codes) + 1) + name[step:]
        name, wide = np.unique(pairs, return_inverse=True)[1].astype(np.int64), wide + step
    return name


def _subtrees(window: int):
    """(prefix, string, doc) rows, sorted by prefix -> for each string its code and the smallest doc_id of each window."""
    def built(rows: pa.Table):
        words = texts_of(rows.column("string").combine_chunks()).words()
        name = node_names(words.codes(), window)
        start = np.flatnonzero(words.left() >= window)
        doc = rows.column("doc").to_numpy()[words.row[start]]
        order = np.lexsort((doc, name[start]))
        sorted_name = name[start][order]
        head = np.append(True, sorted_name[1:] != sorted_name[:-1])
        least = np.empty(len(start), np.int64)
        least[order] = doc[order][head][np.cumsum(head) - 1]
        cut = np.searchsorted(words.row[start], np.arange(rows.num_rows + 1)).astype(np.int32)
        return pa.RecordBatch.from_arrays([rows.column("code").combine_chunks(), rows.column("check").combine_chunks(),
                                           pa.array(np.zeros(rows.num_rows, np.int64)), pa.ListArray.from_arrays(pa.array(cut), pa.array(least))], ["code", "check", "begin", "least"])

    def task(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= _FULL:
                rows = pa.Table.from_batches(held)
                prefix = rows.column("prefix").to_numpy()
                whole = int(np.searchsorted(prefix, prefix[-1]))  # the last group may go on
                if whole:
                    yield built(rows.slice(0, whole))
                held = rows.slice(whole).to_batches()
                size = rows.num_rows - whole
        if size:
            yield built(pa.Table.from_batches(held))

    return task


def _windows(window: int):
    """(code, check, string, doc) -> one row for each window of the string."""
    def task(batches):
        for rows in batches:
            out: dict[str, list] = {"code": [], "check": [], "begin": [], "string": [], "doc": []}
            for r in rows.to_pylist():
                words = r["string"].split(" ")
                for i in range(len(words) - window + 1):
                    for k, v in (("code", r["code"]), ("check", r["check"]), ("begin", i), ("string", " ".join(words[i:i + window])), ("doc", r["doc"])):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.string() if k == "string" else pa.int64()) for k, v in out.items()], list(out))

    return task


def repeated_windows(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, starts): the places (words from 0) of windows that also start in a document of a smaller doc_id."""
    documents = documents.select("doc_id", "text")
    filed = prefixes(documents, window)
    shared = filed.groupBy("prefix").agg(F.min("doc").alias("_low"), F.max("doc").alias("_high")).where("_low < _high").select("prefix")
    lists = keep(filed.join(shared, "prefix").groupBy("doc").agg(F.collect_set("prefix").alias("prefixes")), "prefixes")
    texts = documents.join(lists, F.col("doc_id") == F.col("doc")).select("doc_id", "text", "prefixes")
    strings = keep(_strings(texts, window), "strings")
    code, check = F.xxhash64("string").alias("code"), F.xxhash64(F.lit(1), "string").alias("check")
    distinct = keep(strings.groupBy("prefix", "string").agg(F.min("doc").alias("doc")), "distinct-strings")
    long = distinct.groupBy("prefix").agg(F.count("*").alias("_n")).where(F.col("_n") > GROUP).select("prefix", F.lit(True).alias("_long"))
    dealt = distinct.join(long, "prefix", "left").select("prefix", "string", "doc", code, check, F.coalesce("_long", F.lit(False)).alias("_long"))
    usual = dealt.where("not _long").select("prefix", "string", "doc", "code", "check").repartition("prefix").sortWithinPartitions("prefix")
    trees = usual.mapInArrow(_subtrees(window), "code long, check long, begin long, least array<long>")
    trees = keep(trees, "subtrees")
    apart = dealt.where("_long").select("code", "check", "string", "doc").mapInArrow(_windows(window), "code long, check long, begin long, string string, doc long")
    mins = apart.groupBy("string").agg(F.min("doc").alias("_least"))
    trees = trees.unionByName(apart.join(mins, "string").select("code", "check", "begin", F.array("_least").alias("least")))
    places = strings.select("doc", "place", code, check)
    met = places.join(trees, ["code", "check"])
    inside = F.filter(F.transform("least", lambda x, i: F.when(x < F.col("doc"), (F.col("place") + F.col("begin") + i).cast("int"))), lambda x: x.isNotNull())
    met = met.select("doc", inside.alias("_starts")).where(F.size("_starts") > 0)
    return keep(met.groupBy("doc").agg(F.flatten(F.collect_list("_starts")).alias("starts")), "starts")


def dedup_substrings(documents: DataFrame, window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document, and the words kept if ``keep_text``."""
    found = repeated_windows(documents, window)
    joined = documents.select("doc_id", "text").join(found, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "starts")

    def task(rows, texts):
        words = texts.words()
        lists = rows.column("starts")
        offsets = np.asarray(lists.offsets)
        at = np.asarray(lists.flatten()).astype(np.int64)
        # null lists hold nothing, so what is listed belongs to the rows by their lengths
        n = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()]) if lists.null_count else np.diff(offsets)
        at = at + np.repeat(words.first[:-1], n)
        edge = np.zeros(len(words.start) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, np.minimum(at + window, len(words.start)), -1)
        gone = np.cumsum(edge)[:-1] > 0
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[words.first[1:]] - total[words.first[:-1]]
        raw, kept = texts.data.tobytes(), []
        for i in range(texts.rows):
            listed = raw[texts.offsets[i]:texts.offsets[i + 1]].split()
            if removed[i]:
                listed = [w for w, g in zip(listed, gone[words.first[i]:words.first[i + 1]].tolist()) if not g]
            kept.append(b" ".join(listed))
        out = {"doc_id": rows.column("doc_id"), "n_words": words.count, "n_removed": removed, "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept]}
        return out | ({"kept": pa.array(kept, pa.binary()).cast(pa.string())} if keep_text else {})

    return map_texts(joined, task, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
p AS (SELECT doc_id, w, len(w) n, unnest(range(0, greatest(len(w) - 12, 0))) s FROM d),
win AS (SELECT doc_id, s, list_slice(w, s + 1, s + 13) g FROM p),
low AS (SELECT g, min(doc_id) least FROM win GROUP BY g),
hit AS (SELECT doc_id, s FROM win JOIN low USING (g) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) i FROM hit),
lost AS (SELECT doc_id, list(i) gi FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(len(gi), 0) AS BIGINT) n_removed,
       sha256(array_to_string(CASE WHEN gi IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(gi, k - 1)) END, ' ')) kept_sha256
FROM d LEFT JOIN lost USING (doc_id)
"""
