"""Language identification by prediction by partial matching over bytes.

For every language the counts of each byte after each context of up to ``ORDER`` bytes are taken
from the learning folds (at most ``SAMPLE_ROWS`` documents a language, those of the smallest hash). The
contexts of all languages form one tree; of the longest contexts only the ``CONTEXTS`` commonest are kept.
The statistics are then frozen. Within a context with n bytes seen, d of them different, a seen
byte has probability ``count / (n + d)``; the rest, ``d / (n + d)``, escapes to the next shorter context, where
bytes already excluded no longer count; at last all other bytes share what is left. A text's code length in a
language is the exact sum over all its bytes; the language of the shortest code is predicted.

Null text, or a text without a letter: ``und``, score 0. Equal lengths: the first language by name.
Null doc_id: predicted, in no fold. Repeated rows: one result each. Nothing to learn from: ``und``. An empty
table gives none.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glassledger.llm.labelled import held_out, remainder
from glassledger.llm.words import Texts, runs

ORDER = 3
CONTEXTS = 12_000
SAMPLE_ROWS = 1_500
ALPHABET = 128


def learning_ids(documents: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, lang) of at most ``rows`` documents a language; the rank keeps that many from each task."""
    order = W.partitionBy("lang").orderBy(F.xxhash64(F.lit("lang"), "doc_id"), "doc_id")
    return (documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (remainder() != 0))
            .select("doc_id", "lang").withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= rows).drop("_rank").distinct())


def _keys(texts: Texts) -> np.ndarray:
    """For each byte, itself and the ORDER bytes before it in its text, as one number; 0 stands for no byte."""
    data = texts.data.astype(np.int64)
    ahead = np.arange(len(data)) - np.repeat(texts.offsets[:-1], np.diff(texts.offsets))
    key = data.copy()
    for back in range(1, ORDER + 1):
        before = np.zeros_like(data)
        before[back:] = data[:-back]
        before[ahead < back] = 0
        key |= before << (8 * back)
    return key


def byte_counts(documents: DataFrame, chosen: DataFrame) -> DataFrame:
    """(lang, key, n): how often each byte follows each context of the longest order."""
    rows = documents.select("doc_id", "text", F.col("lang").alias("lang")).join(F.broadcast(chosen.select("doc_id", "lang")), ["doc_id", "lang"])

    def count(batches):
        for part, texts in runs(batches):
            langs = part.column("lang").to_pandas()
            row_of = np.repeat(np.arange(texts.rows), np.diff(texts.offsets))
            keys = _keys(texts)
            for lang in sorted(langs.unique()):
                found, n = np.unique(keys[(langs == lang).to_numpy()[row_of]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(n)], ["lang", "key", "n"])

    return rows.mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


class Model:
    """bits[state, byte, language]; the state of a position is its longest context in the tree."""

    def __init__(self, table, contexts: int = CONTEXTS, alphabet: int = ALPHABET):
        self.langs = sorted(table["lang"].unique())
        lang = table["lang"].map({x: i for i, x in enumerate(self.langs)}).to_numpy(np.int64)
        key, n = table["key"].to_numpy(np.int64), table["n"].to_numpy(np.int64)
        # bytes get codes from 2 on, the commonest first; 0 is no byte, 1 a byte without a code of its own
        often = np.bincount(key & 255, n, minlength=256)
        known = [int(b) for b in np.argsort(-often, kind="stable") if often[b]][:alphabet - 2]
        self.code = np.ones(256, np.int64)
        self.code[known] = np.arange(len(known)) + 2
        self.size = a = len(known) + 2
        digits = [np.where((key >> (8 * i)) & 255 if i else True, self.code[(key >> (8 * i)) & 255], 0) for i in range(ORDER + 1)]
        context = (digits[3] * a + digits[2]) * a + digits[1]  # of order 3; its remainders are the shorter ones
        total = np.bincount(context, n, minlength=a ** 3)
        chosen = np.argsort(-total, kind="stable")[:contexts]
        chosen = np.sort(chosen[total[chosen] > 0])
        levels = [np.zeros(1, np.int64), np.unique(context % a), np.unique(context % a ** 2), chosen]
        first = np.cumsum([0, *map(len, levels)])
        counts = np.zeros((first[-1], a, len(self.langs)))
        for order, found in enumerate(levels):
            at = context % a ** order
            place = np.minimum(np.searchsorted(found, at), len(found) - 1)
            there = found[place] == at
            np.add.at(counts, (first[order] + place[there], digits[0][there], lang[there]), n[there])
        shorter = np.zeros(first[-1], np.int64)
        self.state_of = np.zeros(a ** 3, np.int32)
        whole = np.arange(a ** 3)
        for order in (1, 2, 3):
            place = np.minimum(np.searchsorted(levels[order], whole % a ** order), len(levels[order]) - 1)
            there = levels[order][place] == whole % a ** order
            self.state_of[there] = first[order] + place[there]
            if order > 1:
                up = np.searchsorted(levels[order - 1], levels[order] % a ** (order - 1))
                shorter[first[order]:first[order + 1]] = first[order - 1] + up
        self.bits = self._bits(counts, shorter, first)

    @staticmethod
    def _bits(counts: np.ndarray, shorter: np.ndarray, first: np.ndarray) -> np.ndarray:
        out = np.zeros(counts.shape, np.float32)
        for order in range(len(first) - 1):
            for begin in range(first[order], first[order + 1], 1000):
                states = np.arange(begin, min(begin + 1000, first[order + 1]))
                here, p = states, np.zeros((len(states), *counts.shape[1:]))
                mass = np.ones((len(states), 1, counts.shape[2]))
                excluded = np.zeros(p.shape, bool)
                for level in range(order, -1, -1):
                    c = np.where(excluded, 0, counts[here])
                    n, d = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
                    p += np.where(c > 0, mass * c / np.maximum(n + d, 1), 0)
                    mass = np.where(n > 0, mass * d / np.maximum(n + d, 1), mass)
                    excluded |= c > 0
                    here = shorter[here] if level > 1 else np.zeros_like(here)
                excluded[:, 0] = True  # no byte is never coded
                rest = (~excluded).sum(axis=1, keepdims=True)
                p += np.where(excluded, 0, mass / np.maximum(rest, 1))
                with np.errstate(divide="ignore"):
                    out[states] = np.where(p > 0, -np.log2(p), 0)
        return out

    def lengths(self, texts: Texts) -> np.ndarray:
        """Bits of every text in every language."""
        data = self.code[texts.data]
        ahead = np.arange(len(data)) - np.repeat(texts.offsets[:-1], np.diff(texts.offsets))
        context = np.zeros(len(data), np.int64)
        for back in (3, 2, 1):
            before = np.zeros_like(data)
            before[back:] = data[:-back]
            before[ahead < back] = 0
            context = context * self.size + before
        cost = self.bits[self.state_of[context], data]
        total = np.zeros((len(data) + 1, len(self.langs)))
        np.cumsum(cost, axis=0, dtype=np.float64, out=total[1:])
        return total[texts.offsets[1:]] - total[texts.offsets[:-1]]


def learn(documents: DataFrame, rows: int = SAMPLE_ROWS, contexts: int = CONTEXTS) -> Model | None:
    table = byte_counts(documents, learning_ids(documents, rows)).toPandas()
    if table.empty:
        return None
    return Model(table.sort_values(["lang", "key"]), contexts)


def predict_language(documents: DataFrame, model: Model | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score: the posterior of the language predicted, all being equally likely before."""
    model = model or learn(documents, sample_rows)

    def predict(rows, texts):
        if model is None:
            return {"doc_id": rows.column("doc_id"), "best": pa.nulls(texts.rows, pa.string()), "score": np.zeros(texts.rows)}
        bits = model.lengths(texts)
        best = bits.argmin(axis=1)
        ahead = np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000))
        names = np.asarray(model.langs, object)[best]
        return {"doc_id": rows.column("doc_id"), "best": pa.array(names, pa.string()), "score": 1 / ahead.sum(axis=1)}

    # the text's letters are looked for beside it, so that the text itself need not come back
    lettered = documents.select("doc_id", F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))
    found = lettered.mapInArrow(_with_letters(predict), "doc_id long, best string, score double, lettered boolean")
    known = F.col("lettered") & F.col("best").isNotNull()
    return found.select("doc_id", held_out().alias("held_out"), F.when(known, F.col("best")).otherwise("und").alias("lang_pred"),
                        F.when(known, F.col("score")).otherwise(0.0).alias("score"))


def _with_letters(predict):
    def task(batches):
        for rows, texts in runs(batches):
            columns = predict(rows, texts)
            columns["lettered"] = rows.column("text").is_valid()
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))

    return task
