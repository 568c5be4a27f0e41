"""Mixing to target weights with soft memberships.

The domains are the four kinds of document that ``labels`` tells apart (quality and toxicity). A multinomial classifier over
hashed words, fitted on at most ``SAMPLE_ROWS`` labelled documents (those of the smallest hash), gives every
document its probability of each; evidence counts as of ``WEIGHT`` words at most, so that memberships stay soft. They are
rounded to ``GRID`` parts, so documents fall into a few thousand cells of equal membership whatever the corpus holds.

Rates r >= 0 minimise the squared distance of the expected domain totals, sum of r * tokens * membership, from the targets, each
domain scaled by its natural total. Projected gradient steps start from r = 1; a document's rate depends on its cell and on
the residuals so far alone, so one step is one distributed sum over the cells and K numbers for the driver.
A document's copies are its rate rounded up or down by a hash of its doc_id.

Null or empty text: no tokens, prior memberships. Null doc_id: mixed like any other. Repeated rows: one result each. No labels: every
rate is 1. An empty table gives none.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glassledger.llm.store import keep
from glassledger.llm.words import map_texts, mix, runs

DOMAINS = ("poor", "poor_toxic", "good", "good_toxic")
TARGET = {"good": 0.96, "good_toxic": 0.01, "poor": 0.03, "poor_toxic": 0.0}
GAIN = 1.05
SAMPLE_ROWS = 12_000
CELLS = 1 << 14
WEIGHT = 300
GRID = 32
STEPS = 25
_K = len(DOMAINS)


def classifier(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray] | None:
    """Log prior, and log probability of each cell in each domain."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & F.col("toxic").isin(0, 1)).groupBy("doc_id")
             .agg((2 * F.max("quality") + F.max("toxic")).cast("int").alias("domain")).orderBy(F.xxhash64(F.lit("mix"), "doc_id"), "doc_id").limit(rows))

    def count(batches):
        totals, docs = np.zeros((_K, CELLS), np.int64), np.zeros(_K, np.int64)
        for part, texts in runs(batches):
            words = texts.words()
            domain = part.column("domain").to_numpy()
            cell = (mix(words.codes(), 71) & np.uint64(CELLS - 1)).astype(np.int64)
            totals += np.bincount(domain[words.row] * CELLS + cell, minlength=_K * CELLS).reshape(_K, CELLS)
            docs += np.bincount(domain, minlength=_K)
        at = np.flatnonzero(totals.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1 - np.arange(_K))), pa.array(np.append(totals.ravel()[at], docs))], ["at", "n"])

    sample = documents.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    table = sample.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).where("n > 0").toPandas()
    if table.empty:
        return None
    at, n = table["at"].to_numpy(), table["n"].to_numpy(float)
    docs, counts = np.zeros(_K), np.zeros(_K * CELLS)
    docs[-1 - at[at < 0]], counts[at[at >= 0]] = n[at < 0], n[at >= 0]
    counts = counts.reshape(_K, CELLS)
    whole = (counts.sum(axis=0) + 1) / (counts.sum() + CELLS)
    smooth = (counts + CELLS / 4 * whole) / (counts.sum(axis=1, keepdims=True) + CELLS / 4)
    return np.log((docs + 0.1) / (docs.sum() + 0.1 * _K)), np.log(smooth / whole)


def memberships(documents: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, n_tokens, and the parts of GRID that each domain has in the document."""
    prior, cells = model

    def task(rows, texts):
        words = texts.words()
        at = (mix(words.codes(), 71) & np.uint64(CELLS - 1)).astype(np.int64)
        n = words.count
        score = np.stack([np.bincount(words.row, cells[k][at], minlength=texts.rows) for k in range(_K)], axis=1)
        score = prior + score * (np.minimum(n, WEIGHT) / np.maximum(n, 1))[:, None]
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p = GRID * p / p.sum(axis=1, keepdims=True)
        parts = np.floor(p).astype(np.int64)
        # what rounding leaves over goes to the largest remainders
        rank = np.argsort(np.argsort(-(p - parts), axis=1, kind="stable"), axis=1, kind="stable")
        parts += rank < (GRID - parts.sum(axis=1))[:, None]
        return {"doc_id": rows.column("doc_id"), "n_tokens": n} | {d: parts[:, k] for k, d in enumerate(DOMAINS)}

    return map_texts(documents.select("doc_id", "text"), task, "doc_id long, n_tokens long, " + ", ".join(f"{d} long" for d in DOMAINS))


def _rates(parts: np.ndarray, residuals: list[np.ndarray]) -> np.ndarray:
    r = np.ones(len(parts))
    for residual in residuals:
        r = np.maximum(0.0, r - parts @ residual / GRID)
    return r


def solve(cells: DataFrame, target: dict[str, float], gain: float = GAIN, steps: int = STEPS) -> list[np.ndarray]:
    """The residuals of each step, scaled by the natural totals."""
    def totals(residuals):
        def task(batches):
            for rows in batches:
                parts = np.stack([rows.column(d).to_numpy() for d in DOMAINS], axis=1)
                got = (_rates(parts, residuals) * rows.column("tokens").to_numpy()) @ parts / GRID if rows.num_rows else np.zeros(_K)
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in got], list(DOMAINS))

        row = cells.mapInArrow(task, ", ".join(f"{d} double" for d in DOMAINS)).agg(*(F.sum(d).alias(d) for d in DOMAINS)).first()
        return np.array([row[d] or 0.0 for d in DOMAINS])

    natural = totals([])
    weights = np.array([target[d] for d in DOMAINS])
    lead = int(weights.argmax())
    goal = weights / weights[lead] * natural[lead] * gain
    residuals: list[np.ndarray] = []
    have = natural
    for _ in range(steps):
        # nine digits, so that the order of addition does not show
        residuals.append(np.array([float(f"{x:.9g}") for x in np.divide(have - goal, natural, out=np.zeros(_K), where=natural > 0)]))
        if np.abs(residuals[-1]).max() < 1e-4:
            break
        have = totals(residuals)
    return residuals


def mixed(documents: DataFrame, labels: DataFrame, target: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_tokens, domain (the likeliest), rate, copies of every document."""
    target = target or TARGET
    model = classifier(documents, labels)
    unit = F.pmod(F.xxhash64(F.lit("copies"), "doc_id"), F.lit(1_000_003)) / 1_000_003
    if model is None:
        out = map_texts(documents.select("doc_id", "text"), lambda rows, texts: {"doc_id": rows.column("doc_id"), "n_tokens": texts.words().count}, "doc_id long, n_tokens long")
        return out.select("doc_id", "n_tokens", F.lit(None).cast("string").alias("domain"), F.lit(1.0).alias("rate"), F.lit(1).cast("long").alias("copies"))
    table = keep(memberships(documents, model), "memberships")
    cells = keep(table.groupBy(*DOMAINS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    residuals = solve(cells, target)

    def rated(batches):
        for rows in batches:
            if rows.num_rows:
                parts = np.stack([rows.column(d).to_numpy() for d in DOMAINS], axis=1)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("n_tokens"), pa.array(np.asarray(DOMAINS, object)[parts.argmax(axis=1)], pa.string()),
                                                  pa.array(_rates(parts, residuals).round(9))], ["doc_id", "n_tokens", "domain", "rate"])

    out = table.mapInArrow(rated, "doc_id long, n_tokens long, domain string, rate double")
    return out.withColumn("copies", F.floor(F.col("rate") + unit).cast("long"))


def mixture(documents: DataFrame, labels: DataFrame, target: dict[str, float] | None = None) -> DataFrame:
    """The documents of the mixture, all columns, with domain, rate and copies; those of no copy are left out."""
    rates = mixed(documents, labels, target).select(F.col("doc_id").alias("_doc"), "domain", "rate", "copies").where("copies > 0").dropDuplicates(["_doc"])
    taken = documents.drop("domain", "rate", "copies")
    return taken.join(rates, taken["doc_id"].eqNullSafe(F.col("_doc"))).drop("_doc")
