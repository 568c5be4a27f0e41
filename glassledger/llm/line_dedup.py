"""Line dedup: a segment-partition join of lines within a few edits.

Lines are the parts of a text between line breaks. A line goes when an equal line, or a line within ``EDITS`` insertions, deletions
or substitutions of code points, appears earlier: in a document of a smaller doc_id, or further up. Links are judged on the input, so a line may
go by one that goes itself; the first of every chain stays. Edits are looked for between lines of ``MIN_CHARS`` code points or more:
two edits turn a short line into another word. With ``short_repeats`` (the query and the pipeline) shorter lines that have
a word go when an equal one appears earlier; without it they are not looked at. Blank lines below that length stay.

Each distinct line of l code points is cut into ``EDITS + 1`` segments. Of two lines within the bound the longer one holds
some segment of the other unchanged, at one of a few places that follow from both lengths; these substrings are the
probes. All keys of a line come from one pass over it (sums of its bytes by place). Two lines that meet are a candidate only if the classes of letters that they hold an odd number of times differ in
``2 * EDITS`` at most, which no pair within the bound fails. Candidates are verified by an automaton that runs over the ``2 * EDITS + 1`` diagonals of the band as bits, for many pairs at once.
The texts of candidates are fetched through a filter of ``FILTER`` cells at most, the only thing that is broadcast.

Null text: no lines. Null doc_id: counts as the smallest. Rows that repeat a doc_id: an equal line at the same place counts
once, so neither goes. Ties: by doc_id, then line number. An empty table gives none.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glassledger.llm.store import keep
from glassledger.llm.words import mix, runs

EDITS = 2
MIN_CHARS = 20
FILTER = 1 << 18
_ODD = 0x9E3779B97F4A7C15
WORD = r"[^\x20\x09-\x0D]"


def all_lines(documents: DataFrame, min_chars: int = MIN_CHARS, short_repeats: bool = False) -> DataFrame:
    """doc_id, line_no, line, of the lines that may go."""
    lines = documents.where(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    long = F.char_length("line") >= min_chars
    return lines.where(long | F.col("line").rlike(WORD) if short_repeats else long)


def _segment(length: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Place (from 0) and size of segment i of lines; the last ones are longer by one where it does not divide."""
    parts = edits + 1
    base, longer = length // parts, length % parts
    return base * i + np.maximum(0, i - parts + longer), base + (i >= parts - longer)


def probe_places(edits: int) -> list[tuple[int, int, int]]:
    """(how much shorter the other line is, its segment, how far it may have moved), those of equal length first."""
    return [(less, i, shift) for less in range(edits + 1) for i in range(edits + 1)
            for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1)]


class _Parts:
    """Hashes of any part of many lines, each by two lookups in the sums of bytes times powers of one odd number."""

    def __init__(self, texts):
        data, head = texts.data, (texts.data & 0xC0) != 0x80
        points = np.append(0, np.cumsum(head))
        self.byte = np.append(np.flatnonzero(head), len(data))
        self.first, self.length = points[texts.offsets[:-1]], np.diff(points[texts.offsets])
        value = mix(np.arange(256, dtype=np.uint64), 71)[data]
        up, down = (np.cumprod(np.append(np.uint64(1), np.full(len(data), x, np.uint64))) for x in (_ODD, pow(_ODD, -1, 1 << 64)))
        self.sums, self.down = np.append(np.uint64(0), np.cumsum(value * up[:-1], dtype=np.uint64)), down

    def key(self, length: np.ndarray, i: int, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The key of a part that is segment i of a line of such a length."""
        begin, end = (self.byte[self.first + np.clip(x, 0, self.length)] for x in (start, start + size))
        part = (self.sums[end] - self.sums[begin]) * self.down[begin]
        return mix(part ^ mix(length.astype(np.uint64) * np.uint64(64) + np.uint64(i), 73), 79).view(np.int64)


def _letters(texts) -> np.ndarray:
    """Bit k tells whether the code points of class k are odd in number. An edit turns two bits at most."""
    data = texts.data
    follows = np.append(data[1:], np.uint8(0)).astype(np.uint32)
    kind = (data + np.where(data >= 0xC0, 7 * follows, 0)) % 31
    bits = np.zeros(len(data) + 1, np.int32)
    bits[1:] = np.where((data & 0xC0) != 0x80, np.left_shift(1, kind), 0)
    odd = np.bitwise_xor.accumulate(bits)
    return odd[texts.offsets[1:]] ^ odd[texts.offsets[:-1]]


def segment_keys(lines: DataFrame, edits: int = EDITS, probe: bool = False) -> DataFrame:
    """code, letters, keys of lines (code, line): of their segments or, for a probe, of the parts that may be segments of lines shorter by 0 to
    ``edits`` (``probe_places``; null where the place lies outside)."""
    places = probe_places(edits) if probe else [(0, i, 0) for i in range(edits + 1)]

    def task(batches):
        for rows, texts in runs(batches):
            parts = _Parts(texts)
            keys, none = np.empty((texts.rows, len(places)), np.int64), np.zeros((texts.rows, len(places)), bool)
            for k, (less, i, shift) in enumerate(places):
                at, size = _segment(parts.length - less, i, edits)
                keys[:, k] = parts.key(parts.length - less, i, at + shift, size)
                none[:, k] = (at + shift < 0) | (at + shift + size > parts.length)
            cut = np.arange(texts.rows + 1, dtype=np.int32) * len(places)
            yield pa.RecordBatch.from_arrays([rows.column("code"), pa.array(_letters(texts)), pa.ListArray.from_arrays(pa.array(cut), pa.array(keys.ravel(), mask=none.ravel()))],
                                             ["code", "letters", "keys"])

    return lines.select("code", F.col("line").alias("text")).mapInArrow(task, "code long, letters int, keys array<long>")


def within(first: list[str], second: list[str], edits: int = EDITS) -> np.ndarray:
    """Whether each pair is within so many edits. Bit k of state e: the diagonal k - edits is reached with e edits."""
    n = len(first)
    if not n:
        return np.zeros(0, bool)
    la, lb = (np.array([len(x) for x in texts]) for texts in (first, second))
    wide = int(max(la.max(), lb.max())) + 1

    def table(texts, left):
        out = np.full((n, wide + 2 * edits + 1), 0xFFFFFFFF - left, np.uint32)
        for i, x in enumerate(texts):
            out[i, left:left + len(x)] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.ascontiguousarray(out.T)

    a, b = table(first, edits), table(second, 0)
    band = (1 << (2 * edits + 1)) - 1
    states = [np.full(n, ((1 << (e + 1)) - 1) << edits, np.int64) & band for e in range(edits + 1)]
    goal = np.clip(la - lb + edits, 0, 62)
    near = np.abs(la - lb) <= edits
    result = (states[-1] >> goal) & 1 & (lb == 0)
    for j in range(int(lb.max())):
        same = np.zeros(n, np.int64)
        for k in range(2 * edits + 1):
            same |= (a[j + k] == b[j]).astype(np.int64) << k
        new = [states[0] & same]
        for e in range(1, edits + 1):
            new.append(((states[e] & same) | states[e - 1] | (states[e - 1] >> 1) | (new[e - 1] << 1)) & band)
        states = new
        result |= ((states[-1] >> goal) & 1) & (lb == j + 1)
    return (result == 1) & near


def _verify(edits: int):
    def task(batches):
        for batch in batches:
            lines = sorted(zip(batch.column("line_a").to_pylist(), batch.column("line_b").to_pylist(), batch.column("a").to_pylist(),
                               batch.column("b").to_pylist()), key=lambda x: len(x[0]) + len(x[1]))
            begin = 0
            while begin < len(lines):  # as many at once as fill some megabytes, like by like
                end, room = begin, 1 << 20
                while end < len(lines) and (end == begin or room > 0):
                    room -= max(len(lines[end][0]), len(lines[end][1]))
                    end += 1
                part = lines[begin:end]
                good = within([x[0] for x in part], [x[1] for x in part], edits)
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x, g in zip(part, good) if g], pa.int64()) for i in (2, 3)], ["a", "b"])
                begin = end

    return task


def line_links(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """(a, b): the codes of distinct lines within the bound, a < b."""
    distinct = lines.select("line").distinct().select(F.xxhash64("line").alias("code"), "line")
    index = segment_keys(distinct, edits).select(F.col("code").alias("a"), "letters", F.explode("keys").alias("key"))
    equal = sum(less == 0 for less, _, _ in probe_places(edits))
    probe = segment_keys(distinct, edits, probe=True).select(F.col("code").alias("b"), F.col("letters").alias("other"), F.posexplode("keys").alias("_place", "key"))
    probe = probe.where(F.col("key").isNotNull()).select("b", "other", "key", (F.col("_place") >= equal).alias("shorter"))
    close = F.bit_count(F.col("letters").bitwiseXOR(F.col("other"))) <= 2 * edits
    # lines of one length probe each other: one of the two ways is enough
    met = index.join(probe, "key").where(close & ((F.col("a") < F.col("b")) | (F.col("shorter") & (F.col("a") != F.col("b")))))
    pairs = keep(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "line-pairs")
    cell = lambda c: F.pmod(F.col(c), F.lit(FILTER))
    cells = pairs.select(F.explode(F.array(cell("a"), cell("b"))).alias("cell")).distinct()
    wanted = (lines.select(F.xxhash64("line").alias("code"), "line").withColumn("cell", cell("code"))
              .join(F.broadcast(cells), "cell", "left_semi").groupBy("code").agg(F.min("line").alias("line")))
    wanted = keep(wanted, "line-texts")
    texts = (pairs.join(wanted.select(F.col("code").alias("a"), F.col("line").alias("line_a")), "a")
             .join(wanted.select(F.col("code").alias("b"), F.col("line").alias("line_b")), "b"))
    return texts.select("a", "b", "line_a", "line_b").mapInArrow(_verify(edits), "a long, b long")


def judge_lines(documents: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, short_repeats: bool = False) -> DataFrame:
    """doc_id, removed (line numbers), n_links: of the documents with lines that go or have links."""
    documents = documents.select("doc_id", "text")
    links = keep(line_links(all_lines(documents, min_chars), edits), "line-links")
    lines = all_lines(documents, min_chars, short_repeats)
    places = lines.select("doc_id", "line_no", F.xxhash64("line").alias("code"), F.xxhash64(F.lit(1), "line").alias("check"))
    firsts = keep(places.groupBy("code", "check").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n")), "line-firsts")
    of = lambda end: firsts.select(F.col("code").alias(end), F.col("first").alias(f"first_{end}"))
    ordered = links.join(of("a"), "a").join(of("b"), "b")
    both = ordered.select(F.explode(F.array(F.struct(F.col("a").alias("code"), (F.col("first_b") < F.col("first_a")).alias("late")),
                                            F.struct(F.col("b").alias("code"), (F.col("first_a") < F.col("first_b")).alias("late")))).alias("x"))
    linked = both.groupBy("x.code").agg(F.max("x.late").alias("late"), F.count("*").alias("links"))
    known = firsts.join(linked, "code", "left").where((F.col("n") > 1) | F.col("links").isNotNull())
    met = places.join(known.select("code", "check", "first", "late", "links"), ["code", "check"])
    at_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("line_no") == F.col("first.line_no"))
    gone = F.coalesce("late", F.lit(False)) | ~at_first
    return met.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.when(gone, F.col("line_no")))).alias("removed"),
                                     F.sum(F.coalesce("links", F.lit(0))).alias("n_links"))


def dedup_lines(documents: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, short_repeats: bool = False) -> DataFrame:
    """doc_id, n_lines, n_removed, n_links (links of its lines to other distinct lines) of every document."""
    judged = judge_lines(documents, edits, min_chars, short_repeats).withColumnRenamed("doc_id", "_doc")
    counted = documents.select("doc_id", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).alias("_lines"), F.col("text").isNull().alias("_none"))
    out = counted.join(judged, F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    return out.select("doc_id", F.when(F.col("_none"), 0).otherwise(F.col("_lines")).cast("long").alias("n_lines"),
                      F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).cast("long").alias("n_removed"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def without_repeated_lines(documents: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, short_repeats: bool = False) -> DataFrame:
    """The documents, all columns, with the lines taken out; the others stay in order. ``n_chars`` follows the text."""
    judged = judge_lines(documents, edits, min_chars, short_repeats).select(F.col("doc_id").alias("_doc"), F.col("removed").alias("_removed"))
    joined = documents.join(judged, F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    some = F.size("_removed") > 0
    rest = F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains(F.col("_removed"), i))
    text = F.when(some, F.concat_ws("\n", rest)).otherwise(F.col("text"))
    kept = documents.columns
    out = joined.withColumn("_text", text)
    return out.select(*[F.col("_text").alias("text") if c == "text" else F.when(some, F.char_length("_text").cast("long")).otherwise(F.col(c)).alias(c)
                        if c == "n_chars" else F.col(f"`{c}`") for c in kept])
