"""Words of many texts at once, as numpy arrays over an Arrow column.

A word is ``[^\\x20\\x09-\\x0D]+``. Texts are taken in runs of some megabytes, so
memory follows the longest single text and never the batch. Word codes are 64-bit
hashes that are the same in every process.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser, one to one, so distinct codes stay distinct."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODE = mix(np.arange(256, dtype=np.uint64), 7)
_powers: dict[str, np.ndarray] = {}


def _power(which: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1024)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if size <= 4 * CHUNK_BYTES:
            _powers[which] = have
    return have[:n]


def segment_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A code of the bytes from each start to its end; of empty segments, the code of nothing."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * _power("up", _BASE, len(data)), out=total[1:])
    raw = (total[ends] - total[starts]) * _power("down", _INVERSE, len(data) + 1)[starts]
    return mix(raw ^ ((ends - starts).astype(np.uint64) << np.uint64(40)))


class Texts:
    """The bytes of some texts and where each begins; null texts are empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.rows = len(offsets) - 1

    def sums(self, mask: np.ndarray) -> np.ndarray:
        """The number of marked bytes in each text."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def words(self) -> Words:
        return Words(self)


class Words:
    """start and end of each word, first[i]..first[i+1] the words of text i."""

    def __init__(self, texts: Texts):
        self.texts = texts
        data, offsets = texts.data, texts.offsets
        inside = ~_SPACE[data]
        begins, ends = inside.copy(), inside.copy()
        if len(data):
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            edges = offsets[(offsets > 0) & (offsets < len(data))]
            begins[edges] = inside[edges]
            ends[edges - 1] = inside[edges - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts.rows), self.count)

    def codes(self, data: np.ndarray | None = None) -> np.ndarray:
        return segment_codes(self.texts.data if data is None else data, self.start, self.end)

    def left(self) -> np.ndarray:
        """For each word, how many words of its text begin at it."""
        return np.repeat(self.first[1:], self.count) - np.arange(len(self.start))


def grams(codes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Code of the n words from each position on; the last n - 1 have none."""
    size = max(0, len(codes) - n + 1)
    out = np.zeros(size, np.uint64)
    for i in range(n):
        out = out * _BASE + mix(codes[i:i + size], seed)
    return mix(out, seed)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def texts_of(column: pa.Array) -> Texts:
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(raw[at[0]:at[-1]], at - at[0])


def runs(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """The batches cut into runs of rows whose texts hold some ``limit`` bytes, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = texts_of(batch.column("text"))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(whole.offsets, whole.offsets[begin] + limit, "right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            a, b = whole.offsets[begin], whole.offsets[end]
            yield batch.slice(begin, end - begin), Texts(whole.data[a:b], whole.offsets[begin:end + 1] - a)
            begin = end


def map_texts(df, fn, schema: str):
    """``fn(rows, texts)`` over runs of ``doc_id, text`` rows; its dict of columns is the result's rows."""
    def task(batches):
        for rows, texts in runs(batches):
            columns = fn(rows, texts)
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))

    return df.mapInArrow(task, schema)
