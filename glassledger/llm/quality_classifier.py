"""Quality classifier: a factorisation machine over hashed words and structure.

Each distinct word of a text is one of ``BUCKETS`` features, of value ``1 / sqrt(distinct words)``.
Structure statistics and the stored length (``n_chars``, or the length of the text where it is null) are
features of their own. All pairs interact through ``RANK`` factors; by the sum-of-squares identity a
score takes time linear in the features. The machine is fitted on ``SAMPLE_ROWS`` labelled documents
at most (those of the smallest hash); every document is scored whole.

Null or empty text: scored by its structure alone. Null doc_id: scored, in no fold. Repeated rows: one result each.
Without labels every score is 0.5. An empty table gives none.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glassledger.llm.labelled import held_out, sample_of_texts
from glassledger.llm.quality_rules import repeated_lines, repeated_words
from glassledger.llm.words import Texts, map_texts, runs

BUCKETS = 1 << 15
RANK = 6
SAMPLE_ROWS = 6_000
THRESHOLD = 0.3
EPOCHS = 12
_STATS = 13


def _marks(*groups: bytes) -> list[np.ndarray]:
    out = []
    for g in groups:
        m = np.zeros(256, dtype=bool)
        m[list(g)] = True
        out.append(m)
    return out


_UPPER, _LOWER, _DIGIT, _SYMBOL, _POINT = _marks(bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b"#*$%&|<>{}=_@^~\\/", b".,;:!?")


def features(texts: Texts, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of distinct words, the text of each, its value; and the structure statistics."""
    words = texts.words()
    codes = words.codes()
    row = words.row
    key = np.unique((row.astype(np.uint64) << np.uint64(15)) | (codes & np.uint64(BUCKETS - 1)))
    of, bucket = (key >> np.uint64(15)).astype(np.int64), (key & np.uint64(BUCKETS - 1)).astype(np.int64)
    distinct = np.bincount(of, minlength=texts.rows)
    value = 1 / np.sqrt(np.maximum(distinct, 1))[of]
    n_bytes, n_words = np.diff(texts.offsets), words.count
    per = lambda part, whole: part / np.maximum(whole, 1)
    upper, lower = texts.sums(_UPPER[texts.data]), texts.sums(_LOWER[texts.data])
    lines = texts.sums(texts.data == 10) + 1
    next_same = np.zeros(len(codes), bool)
    next_same[1:] = (codes[1:] == codes[:-1]) & (row[1:] == row[:-1])
    width = words.end - words.start
    mean_width = per(np.bincount(row, width, minlength=texts.rows), n_words)
    spread = np.sqrt(np.maximum(per(np.bincount(row, width.astype(float) ** 2, minlength=texts.rows), n_words) - mean_width ** 2, 0))
    stats = np.stack([
        per(upper, upper + lower), per(texts.sums(_DIGIT[texts.data]), n_bytes), per(texts.sums(_SYMBOL[texts.data]), n_bytes),
        per(texts.sums(_POINT[texts.data]), n_words), per(texts.sums(texts.data == 33), n_words), mean_width / 10, spread / 10,
        per(distinct, n_words), per(np.bincount(row[next_same], minlength=texts.rows), n_words),
        per(repeated_words(texts, words, codes), n_words), per(repeated_lines(texts), lines), np.log1p(per(n_words, lines)) / 5,
        np.log1p(np.maximum(n_chars, 0)) / 10], axis=1)
    return bucket, of, value, stats


def _lengths(rows, texts: Texts) -> np.ndarray:
    points = texts.sums((texts.data & 0xC0) != 0x80)
    given = rows.column("n_chars").to_numpy(zero_copy_only=False).astype(float)
    return np.where(np.isnan(given), points, given)


class Machine:
    """bias, linear weights and factors; the statistics stand behind the buckets."""

    def __init__(self, seed: int = 17):
        draw = np.random.default_rng(seed)
        self.bias = 0.0
        self.linear = np.zeros(BUCKETS + _STATS)
        self.factors = draw.normal(0, 0.05, (BUCKETS + _STATS, RANK))
        self.mean, self.scale = np.zeros(_STATS), np.ones(_STATS)

    def inputs(self, bucket, of, value, stats):
        z = np.clip((stats - self.mean) / self.scale, -6, 6) / np.sqrt(_STATS)
        n = len(stats)
        return (np.concatenate([bucket, np.tile(np.arange(_STATS) + BUCKETS, n)]),
                np.concatenate([of, np.repeat(np.arange(n), _STATS)]), np.concatenate([value, z.ravel()]))

    def margins(self, index, of, value, n):
        """Margins, and the factor sums of each row."""
        v = self.factors[index] * value[:, None]
        sums = np.stack([np.bincount(of, v[:, f], minlength=n) for f in range(RANK)], axis=1)
        squares = np.bincount(of, (v * v).sum(axis=1), minlength=n)
        pairs = 0.5 * ((sums * sums).sum(axis=1) - squares)
        return self.bias + np.bincount(of, self.linear[index] * value, minlength=n) + pairs, sums


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(samples: list[tuple], labels: np.ndarray, epochs: int = EPOCHS, batch: int = 256, rate: float = 0.02, decay: float = 1e-5) -> Machine:
    """Logistic loss by Adam over batches in a fixed order."""
    m = Machine()
    stats = np.concatenate([s[2] for s in samples]).reshape(-1, _STATS)
    m.mean, m.scale = stats.mean(axis=0), stats.std(axis=0) + 1e-6
    m.bias = float(np.log((labels.mean() + 1e-3) / (1 - labels.mean() + 1e-3)))
    width = BUCKETS + _STATS
    theta = np.concatenate([m.linear[:, None], m.factors], axis=1)
    first, second, step = np.zeros_like(theta), np.zeros_like(theta), 0
    draw = np.random.default_rng(5)
    for _ in range(epochs):
        order = draw.permutation(len(samples))
        for b in range(0, len(order), batch):
            chosen = order[b:b + batch]
            part = [samples[i] for i in chosen]
            of = np.repeat(np.arange(len(part)), [len(p[0]) for p in part])
            index, of, value = m.inputs(np.concatenate([p[0] for p in part]), of, np.concatenate([p[1] for p in part]), np.stack([p[2] for p in part]))
            z, sums = m.margins(index, of, value, len(part))
            error = (_sigmoid(z) - labels[chosen]) / len(part)
            touched, place = np.unique(index, return_inverse=True)
            push = error[of] * value
            grads = [np.bincount(place, push, minlength=len(touched))]
            v = theta[index, 1:]
            for f in range(RANK):
                grads.append(np.bincount(place, push * (sums[of, f] - v[:, f] * value), minlength=len(touched)))
            g = np.stack(grads, axis=1) + decay * theta[touched]
            step += 1
            first[touched] = 0.9 * first[touched] + 0.1 * g
            second[touched] = 0.99 * second[touched] + 0.01 * g * g
            theta[touched] -= rate * (first[touched] / (1 - 0.9 ** step)) / (np.sqrt(second[touched] / (1 - 0.99 ** step)) + 1e-8)
            m.bias -= rate * float(error.sum())
            m.linear, m.factors = theta[:, 0], theta[:, 1:]
    assert width == len(theta)
    return m


def learn(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Machine | None:
    """The machine of a bounded sample; its features are made in tasks, only they come to the driver."""
    sample = sample_of_texts(documents, labels, "quality", rows, ("n_chars",))

    def task(rows_, texts):
        bucket, of, value, stats = features(texts, _lengths(rows_, texts))
        cut = np.searchsorted(of, np.arange(texts.rows + 1))
        return {"doc_id": rows_.column("doc_id"), "label": rows_.column("label"),
                "buckets": pa.array([bucket[a:b].astype(np.uint16).tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
                "stats": pa.array(list(stats), pa.list_(pa.float64()))}

    got = map_texts(sample.select("doc_id", "text", "n_chars", "label"), task, "doc_id long, label int, buckets binary, stats array<double>").toPandas()
    if got.empty:
        return None
    got["key"] = [hash_of for hash_of in got["buckets"].map(lambda b: bytes(b)[:64])]
    got = got.sort_values(["doc_id", "key"], kind="stable")  # whatever the order of the tasks
    samples = []
    for b, s in zip(got["buckets"], got["stats"]):
        bucket = np.frombuffer(b, np.uint16).astype(np.int64)
        samples.append((bucket, np.full(len(bucket), 1 / np.sqrt(max(len(bucket), 1))), np.asarray(s)))
    return fit(samples, got["label"].to_numpy(float))


def quality_scores(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    machine = learn(documents, labels, sample_rows)

    def score(rows, texts):
        if machine is None:
            return {"doc_id": rows.column("doc_id"), "score": np.full(texts.rows, 0.5)}
        bucket, of, value, stats = features(texts, _lengths(rows, texts))
        margins, _ = machine.margins(*machine.inputs(bucket, of, value, stats), texts.rows)
        return {"doc_id": rows.column("doc_id"), "score": _sigmoid(margins)}

    scored = map_texts(documents.select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars")), score, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, whose score reaches the threshold."""
    machine = learn(documents, labels, sample_rows)

    def task(batches):
        for rows, texts in runs(batches):
            if machine is not None:
                bucket, of, value, stats = features(texts, _lengths(rows, texts))
                margins, _ = machine.margins(*machine.inputs(bucket, of, value, stats), texts.rows)
                rows = rows.filter(pa.array(_sigmoid(margins) >= threshold))
            yield rows

    return documents.mapInArrow(task, documents.schema)
