"""Toxicity by a linear-chain conditional random field over words.

Tokens are labelled from the documents that ``labels`` marks: in a toxic document, a word is toxic when it,
or its first bytes, occur in toxic documents far beyond chance (log-likelihood ratio of the document counts of at
least ``SEED_G2``). A two-state field over hashed words, word beginnings and transitions is fitted to these tokens;
forward-backward marginals then tag every word of every text. A document's score is the largest
marginal of its words, its log-odds moved so that 0.5 parts the documents learned from; words of 0.5 or more
make up the offending spans. At most ``SAMPLE_ROWS`` labelled
documents, those of the smallest hash, are learned from; every document is scored whole.

Null or empty text: score 0, no span. Null doc_id: scored, in no fold. Repeated rows: one result each.
Without labels every score is 0. An empty table gives none.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glassledger.llm.labelled import held_out, sample_of_texts
from glassledger.llm.words import Texts, lower_ascii, map_texts, mix, segment_codes

BUCKETS = 1 << 18
SAMPLE_ROWS = 2_500
SEED_G2 = 22.0
THRESHOLD = 0.5
STEPS = 40
_BLOCK = 128
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b".,;:!?%&$#*|<>()[]{}\"'")] = True


def tokens(texts: Texts):
    """The words, and for each the buckets of itself and of its first 5 and 4 bytes."""
    words = texts.words()
    data, start, end = lower_ascii(texts.data), words.start.copy(), words.end.copy()
    for _ in range(6):
        end -= (end > start + 1) & _MARK[data[end - 1]]
        start += (end > start + 1) & _MARK[data[start]]
    whole = segment_codes(data, start, end)
    kinds = [whole, *(mix(segment_codes(data, start, np.minimum(start + n, end)), n) for n in (5, 4))]
    return words, np.stack([(k & np.uint64(BUCKETS - 1)).astype(np.int32) for k in kinds], axis=1)


def _compose(p, q):
    """The 2x2 product p q of maps r -> (a r + b) / (c r + d), scaled."""
    a, b, c, d = p
    e, f, g, h = q
    out = [a * e + b * g, a * f + b * h, c * e + d * g, c * f + d * h]
    top = np.maximum(np.maximum(out[0], out[1]), np.maximum(out[2], out[3]))
    return [x / top for x in out]


def _scan(a, b, c, d):
    """r after each map, in order, from r = 0; blocks run side by side, so the loops are short."""
    n = len(a)
    if not n:
        return np.zeros(0)
    wide = -(-n // _BLOCK)
    grid = []
    for x, fill in ((a, 1.0), (b, 0.0), (c, 0.0), (d, 1.0)):
        padded = np.full(wide * _BLOCK, fill)
        padded[:n] = x
        grid.append(padded.reshape(wide, _BLOCK).T.copy())
    parts = [[x[0] for x in grid]]
    for k in range(1, _BLOCK):
        parts.append(_compose([x[k] for x in grid], parts[-1]))
    enter, r = np.zeros(wide), 0.0
    la, lb, lc, ld = (x.tolist() for x in parts[-1])
    for i in range(wide):
        enter[i] = r
        r = (la[i] * r + lb[i]) / (lc[i] * r + ld[i])
    out = np.stack([(p[0] * enter + p[1]) / (p[2] * enter + p[3]) for p in parts])
    return out.T.ravel()[:n]


def chain(u: np.ndarray, t: np.ndarray, first: np.ndarray, last: np.ndarray):
    """For toxic-state scores u and log transitions t: forward ratios, backward ratios, marginals."""
    e, k = np.exp(np.clip(u, -30, 30)), np.exp(t)
    forward = _scan(np.where(first, 0, e * k[1, 1]), np.where(first, e, e * k[0, 1]), np.where(first, 0, k[1, 0]), np.where(first, 1, k[0, 0]))
    # the ratio behind a word comes from the word after it
    ahead = np.append(e[1:], 1.0)
    back = [np.where(last, 0, k[1, 1] * ahead), np.where(last, 1, k[1, 0]), np.where(last, 0, k[0, 1] * ahead), np.where(last, 1, k[0, 0])]
    backward = _scan(*(x[::-1] for x in back))[::-1]
    product = forward * backward
    return forward, backward, product / (1 + product)


def _edges(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    count = count[count > 0]
    last = np.zeros(int(count.sum()), bool)
    last[np.cumsum(count) - 1] = True
    first = np.zeros(len(last), bool)
    first[np.cumsum(count) - count] = True
    return first, last


class Field:
    def __init__(self, weights: np.ndarray, bias: float, transitions: np.ndarray):
        self.weights, self.bias, self.transitions, self.shift = weights.astype(np.float32), bias, transitions, 0.0

    def marginals(self, buckets: np.ndarray, count: np.ndarray) -> np.ndarray:
        first, last = _edges(count)
        u = self.bias + self.weights[buckets].sum(axis=1, dtype=np.float64)
        return 1 / (1 + np.exp(np.clip(self.shift - _logit(chain(u, self.transitions, first, last)[2]), -30, 30)))


def _seeds(buckets: np.ndarray, row: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """The labels of the tokens."""
    n1, n0 = toxic.sum(), (~toxic).sum()
    tagged = np.zeros(len(buckets), bool)
    for k in (0, 1):
        pairs = np.unique(row.astype(np.int64) * BUCKETS + buckets[:, k])
        bad = toxic[pairs // BUCKETS]
        a, b = (np.bincount((pairs % BUCKETS)[m], minlength=BUCKETS).astype(float) for m in (bad, ~bad))
        with np.errstate(divide="ignore", invalid="ignore"):
            g2 = 2 * (np.where(a > 0, a * np.log(a * (n1 + n0) / ((a + b) * n1)), 0) + np.where(b > 0, b * np.log(b * (n1 + n0) / ((a + b) * n0)), 0))
        strong = (g2 >= SEED_G2) & (a > 4 * b * n1 / max(n0, 1)) & (a >= 10 * b)
        tagged |= strong[buckets[:, k]]
    return tagged & toxic[row]


def fit(buckets: np.ndarray, count: np.ndarray, toxic: np.ndarray, steps: int = STEPS, rate: float = 0.4, decay: float = 2e-7) -> Field:
    """Conditional likelihood of the labelled tokens, climbed by Adam over whole passes."""
    row = np.repeat(np.arange(len(count)), count)
    y = _seeds(buckets, row, toxic).astype(float)
    first, last = _edges(count)
    used, place = np.unique(buckets, return_inverse=True)
    place = place.reshape(buckets.shape)
    theta = np.zeros(len(used) + 5)  # weights, bias, transitions in rows
    theta[len(used)] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    pair = ~last[:-1]
    now, then = y[:-1][pair].astype(int), y[1:][pair].astype(int)
    seen = np.bincount(now * 2 + then, minlength=4) / max(len(y), 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        u = theta[len(used)] + theta[place].sum(axis=1)
        t = theta[len(used) + 1:].reshape(2, 2)
        forward, backward, p = chain(u, t, first, last)
        e, k, r, b = np.exp(np.clip(u[1:][pair], -30, 30)), np.exp(t), forward[:-1][pair], backward[1:][pair]
        joint = np.stack([np.full(len(r), k[0, 0]), k[0, 1] * e * b, r * k[1, 0], r * k[1, 1] * e * b])
        expected = (joint / joint.sum(axis=0)).sum(axis=1) / max(len(y), 1)
        miss = (p - y) / max(len(y), 1)
        g = np.concatenate([sum(np.bincount(place[:, i], miss, minlength=len(used)) for i in range(buckets.shape[1])), [miss.sum()], expected - seen]) + decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
    weights = np.zeros(BUCKETS)
    weights[used] = theta[:len(used)]
    field = Field(weights, float(theta[len(used)]), theta[len(used) + 1:].reshape(2, 2))
    field.shift = _shift(_tops(field.marginals(buckets, count), count), toxic)
    return field


def _tops(p: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The largest marginal of each text."""
    top = np.zeros(len(count))
    some = np.flatnonzero(count)
    if len(some):
        top[some] = np.maximum.reduceat(p, (np.cumsum(count) - count)[some])
    return top


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def _shift(tops: np.ndarray, toxic: np.ndarray) -> float:
    """Where documents part, on the scale of log-odds: the middle between the 2nd and the 99.9th hundredth of the two kinds."""
    if toxic.all() or not toxic.any():
        return 0.0
    return max(0.0, float(np.quantile(_logit(tops[toxic]), 0.02) + np.quantile(_logit(tops[~toxic]), 0.999)) / 2)


def learn(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Field | None:
    def task(part, texts):
        words, buckets = tokens(texts)
        return {"doc_id": part.column("doc_id"), "label": part.column("label"),
                "buckets": pa.array([buckets[a:b].tobytes() for a, b in zip(words.first[:-1], words.first[1:])], pa.binary())}

    sample = sample_of_texts(documents, labels, "toxic", rows).select("doc_id", "text", "label")
    got = map_texts(sample, task, "doc_id long, label int, buckets binary").toPandas()
    if got.empty or not got["label"].any():
        return None
    got["key"] = got["buckets"].map(lambda b: bytes(b)[:64])
    got = got.sort_values(["doc_id", "key"], kind="stable")  # whatever the order of the tasks
    parts = [np.frombuffer(b, np.int32).reshape(-1, 3) for b in got["buckets"]]
    return fit(np.concatenate(parts), np.array([len(p) for p in parts]), got["label"].to_numpy() == 1)


def toxicity_scores(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and spans (code points from start to end) of every document."""
    field = learn(documents, labels, sample_rows)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def score(rows, texts):
        if field is None:
            return {"doc_id": rows.column("doc_id"), "score": np.zeros(texts.rows), "spans": pa.array([[]] * texts.rows, kind)}
        words, buckets = tokens(texts)
        p = field.marginals(buckets, words.count)
        top = _tops(p, words.count)
        bad = p >= threshold
        row = words.row
        joined = np.zeros(len(p), bool)  # goes on the span of the word before it
        joined[1:] = bad[1:] & bad[:-1] & (row[1:] == row[:-1])
        begins = np.flatnonzero(bad & ~joined)
        ends = np.flatnonzero(bad & ~np.append(joined[1:], False))
        points = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
        base = points[texts.offsets[row[begins]]]
        cut = np.searchsorted(row[begins], np.arange(texts.rows + 1)).astype(np.int32)
        spans = pa.StructArray.from_arrays([pa.array(points[words.start[begins]] - base), pa.array(points[words.end[ends]] - base)], ["start", "end"])
        return {"doc_id": rows.column("doc_id"), "score": top, "spans": pa.ListArray.from_arrays(pa.array(cut), spans)}

    scored = map_texts(documents.select("doc_id", "text"), score, "doc_id long, score double, spans array<struct<start:long,end:long>>")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
