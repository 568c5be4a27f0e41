"""Isolation forest over the six ledger signals (Liu, Ting & Zhou, 2008).

The forest sees a row only through its six features, five of which are 0/1.
Rows are therefore counted per feature vector first: copies of a row, however
many, are one counted vector in every later step.

Fit: each tree takes at most 256 rows, so 200 trees need some 51,200 rows
whatever the ledger holds. They are picked by hash straight from the counted
vectors, by one rule for every size, and trees are grown one per group.

Score: for a fixed 0/1 pattern the mean path length is a step function of the
z-score. The steps of the 32 patterns (at most 200 x 255 each) are worked out
once and a row is scored by one binary search.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stored import stored
from ..rules import ledger as R
from .ledger import contamination, raw_tier, tier_cuts

TREES = 200
SAMPLE = 256
SEED = 42
_FLAGS = list(R.FLAG_LABELS)


# --- features --------------------------------------------------------------


def feature_array(df: DataFrame) -> DataFrame:
    """The six model inputs in fixed order, null as 0."""
    return df.withColumn("features", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in R.FEATURES]))


def pattern_code() -> Column:
    """The five 0/1 signals as one number from 0 to 31."""
    code = F.lit(0)
    for i, c in enumerate(_FLAGS):
        code = code + F.coalesce(F.col(c), F.lit(0)) * (1 << i)
    return code.cast("int")


def z_value() -> Column:
    """The z-score with 0 for null; exact account sums make it the same on any partitioning. (The sum takes the sign from a zero.)"""
    return F.coalesce(F.col(R.Z_COLUMN), F.lit(0.0)) + F.lit(0.0)


def feature_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(pattern_code().alias("pattern"), z_value().alias("z")).agg(F.count("*").alias("n"))


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean 0, population deviation 1 per column; a constant column becomes 0."""
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    stats = df.agg(
        F.struct(*[F.struct(F.avg(v).alias("m"), F.stddev_pop(v).alias("s")).alias(c) for c, v in filled.items()]).alias("x")
    ).scalar()
    out = {
        f"{c}_scaled": F.when(stats[c]["s"] == 0, F.lit(0.0)).otherwise((v - stats[c]["m"]) / stats[c]["s"])
        for c, v in filled.items()
    }
    return df.withColumns(out)


# --- fit -------------------------------------------------------------------


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, c))


def _unit_hash(*cols: Column) -> Column:
    """A hash of the columns spread over [0, 1)."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)).cast("double") / float(1 << 52)


def draw_tree_rows(counts: DataFrame, total: int, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """Some 1.6 x ``sample`` ledger rows per tree without replacement, straight from the counted vectors; all where there are fewer.

    A vector that stands for n rows is picked n x share x ``trees`` times, the fraction decided by its hash, and its picks go
    round the trees from a place that its hash gives: in one tree it has at most n of them, and no row is drawn by itself.
    """
    share = min(1.0, sample * 1.6 / max(total, 1))
    vector = (F.col("pattern"), F.col("z"))
    picks = F.floor(F.col("n") * F.lit(share) * trees + _unit_hash(F.lit(seed), *vector)).cast("long")
    picked = counts.withColumn("_picks", picks).where("_picks > 0")
    dealt = picked.select("pattern", "z", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_picks") - 1)).alias("copy"))
    tree = F.pmod(F.xxhash64(F.lit(seed + 2), *vector) + F.col("copy"), F.lit(trees)).cast("int")
    return dealt.select("pattern", "z", "copy", tree.alias("tree"),
                        _unit_hash(F.lit(seed + 1), tree, *vector, F.col("copy")).alias("u"))


_STEP_SCHEMA = "tree int, pattern int, bound double, jump double"


def _grow(tree: int, x: np.ndarray, limit: int, seed: int) -> list[tuple]:
    """Isolation tree as node rows; feature -1 marks a leaf."""
    rng = np.random.default_rng([seed, tree])
    nodes: list[list] = []

    def build(idx: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([tree, me, -1, 0.0, -1, -1, depth, len(idx)])
        if depth >= limit or len(idx) <= 1:
            return me
        lo, hi = x[idx].min(axis=0), x[idx].max(axis=0)
        varied = np.flatnonzero(hi > lo)
        if len(varied) == 0:
            return me
        f = int(rng.choice(varied))
        cut = float(rng.uniform(lo[f], hi[f]))
        go_left = x[idx, f] <= cut
        nodes[me][2], nodes[me][3] = f, cut
        nodes[me][4] = build(idx[go_left], depth + 1)
        nodes[me][5] = build(idx[~go_left], depth + 1)
        return me

    build(np.arange(len(x)), 0)
    return [tuple(n) for n in nodes]


def _pattern_bits(pattern: np.ndarray) -> np.ndarray:
    return (pattern[:, None] >> np.arange(len(_FLAGS))) & 1


def _tree_steps(nodes: list[tuple], tree: int) -> list[tuple]:
    """Path length as a step function of z, per 0/1 pattern, for one tree.

    The first row of a pattern (bound -inf) holds the path at the far left, the
    others the change of path length at each cut.
    """
    path = average_path(np.array([n[7] for n in nodes], dtype=float)).tolist()
    out = []
    for code in range(1 << len(_FLAGS)):
        pieces, stack = [], [(0, math.inf)]
        while stack:
            i, upper = stack.pop()
            _, _, feature, cut, left, right, depth, _ = nodes[i]
            if feature < 0:
                pieces.append((upper, depth + path[i]))
            elif feature == 0:
                stack.append((right, upper))
                stack.append((left, min(cut, upper)))
            else:
                bit = (code >> (feature - 1)) & 1
                stack.append((left if bit <= cut else right, upper))
        out.append((tree, code, -math.inf, pieces[0][1]))
        for (bound, p), (_, q) in zip(pieces, pieces[1:]):
            if p != q:
                out.append((tree, code, bound, q - p))
    return out


def tree_steps(rows: DataFrame, sample: int, seed: int = SEED) -> DataFrame:
    """Grow one tree per group of at most 1.6 x ``sample`` drawn rows; give its steps."""
    limit = math.ceil(math.log2(max(sample, 2)))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["u", "pattern", "z", "copy"]).head(sample)
        x = np.column_stack([pdf["z"].to_numpy(), _pattern_bits(pdf["pattern"].to_numpy())]).astype(float)
        tree = int(pdf["tree"].iloc[0])
        steps = _tree_steps(_grow(tree, x, limit, seed), tree)
        return pd.DataFrame(steps, columns=["tree", "pattern", "bound", "jump"])

    return rows.groupBy("tree").applyInPandas(fit, _STEP_SCHEMA)


def sum_steps(steps: pd.DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per pattern: cut points and the path length, summed over trees, on each stretch."""
    out = {}
    for code, part in steps.sort_values(["pattern", "bound", "tree"]).groupby("pattern"):
        bound, jump = part["bound"].to_numpy(), part["jump"].to_numpy()
        first = np.searchsorted(bound, -math.inf, side="right")
        level = jump[:first].sum() + np.concatenate([[0.0], np.cumsum(jump[first:])])
        out[int(code)] = (bound[first:], level)
    return out


class Forest:
    """A fitted forest: step tables small enough to send to every task."""

    def __init__(self, steps: dict, trees: int, sample: int):
        self.steps, self.trees, self.sample = steps, trees, sample

    def normality(self, pattern: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Minus the anomaly score: near -1 is anomalous, near 0 normal."""
        total = np.empty(len(z))
        for code in np.unique(pattern):
            mask = pattern == code
            bounds, level = self.steps[int(code)]
            total[mask] = level[np.searchsorted(bounds, z[mask], side="left")]
        scale = self.trees * float(average_path(self.sample))
        return -np.power(2.0, -total / scale) if scale > 0 else np.full(len(z), -0.5)


def fit_forest(counts: DataFrame, total: int, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> Forest:
    """``counts`` is a counted feature frame. The driver receives the steps only:
    at most ``trees`` x 32 x ``sample`` rows, whatever the ledger holds."""
    sample = min(sample, total)
    rows = draw_tree_rows(counts, total, trees, sample, seed)
    steps = tree_steps(rows, sample, seed).toPandas()
    return Forest(sum_steps(steps), steps["tree"].nunique(), sample)


def normality_column(df: DataFrame, forest: Forest, pattern: Column, z: Column) -> Column:
    model = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        f = model.value
        for code, value in batches:
            yield pd.Series(f.normality(code.to_numpy(), value.to_numpy()))

    return score(pattern, z)


def score_with_forest(
    df: DataFrame, sensitivity: str | None = None, seed: int = SEED, trees: int = TREES
) -> DataFrame:
    """Adds ``anomaly_score`` (lower is worse), ``anomaly_label`` and ``raw_tier``."""
    share = contamination(sensitivity)
    df = stored(df, "signals")  # read by the fit and, once scored, by each report
    counts = feature_counts(df).persist()
    try:
        total = counts.agg(F.sum("n")).first()[0] or 0
        if total == 0:
            return df.withColumns(
                {"anomaly_score": F.lit(None).cast("double"), "anomaly_label": F.lit(1), "raw_tier": F.lit("Low")}
            )
        forest = fit_forest(counts, total, trees=trees, seed=seed)
        vectors = counts.select("n", normality_column(counts, forest, F.col("pattern"), F.col("z")).alias("normality"))
        # few distinct scores stand for all rows, so the exact cuts are cheap
        by_score = vectors.groupBy("normality").agg(F.sum("n").alias("n"))
        high, medium = tier_cuts(by_score, share, "normality", "n")
    finally:
        counts.unpersist()
    scored = df.withColumn("anomaly_score", normality_column(df, forest, pattern_code(), z_value()) - F.lit(high))
    return scored.withColumns(
        {
            "anomaly_label": F.when(F.col("anomaly_score") < 0, -1).otherwise(1),
            "raw_tier": raw_tier(F.col("anomaly_score"), 0.0, medium - high),
        }
    )
