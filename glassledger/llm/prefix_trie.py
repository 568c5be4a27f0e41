"""Prefix trie of conversations by burst tries.

Every conversation is rebuilt (``rebuild``) and becomes a string of turn ids, 16 bytes of SHA-256 for a role and a text each. Equal
strings count once, with their number and smallest conv_id; the ids of the conversations that end there are hashed as a sorted
stream, so a group of copies of any size needs constant memory.

A container holds the strings below one trie head. While its strings have more than ``LIMIT`` turns left together, it bursts: its
shared beginning becomes a chain of nodes, and the strings go into containers by their next turn. The shared beginning of a
container is that of its smallest and largest string, so every burst parts its strings, or ends a container that holds only one.
Other containers are dealt to shards, each is sorted and swept once with a stack of open nodes. Counts of leaves and of saved
tokens then go up the chains, last round first; heads are few against strings.

Rows of a conversation go by turn (nulls first), rows of equal turn by their turn id. Null role or text: empty. Null conv_id: the row belongs to no
conversation. Repeated rows are turns of their own. Empty text: a turn of no bytes. Empty table: no node, not even a root.
A conversation is one row of some 20 bytes a turn. Other columns are not looked at.
"""
from __future__ import annotations

import hashlib
import itertools
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glassledger.llm.crc import TABLES, crc32_sql
from glassledger.llm.store import keep

LIMIT = 50_000
SHARED = 9
GROUP = 5
_ID = 16
_NO_ENDS = hashlib.sha256().hexdigest()


# --- conversations as strings of turn ids

def turn_strings(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order, as (turn, id, size) structs; size: UTF-8 bytes of the text."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    code = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"), F.struct(F.col("turn"), F.unhex(F.substring(code, 1, 2 * _ID)).alias("id"), F.octet_length(text).alias("size")).alias("_t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("_t")).alias("turns"))


def rebuild(strings: DataFrame) -> DataFrame:
    """conv_id, seq (turn ids one after the other), sizes: the first h turns of the group's first conversation, then the own ones after
    the first h; h = crc32(conv_id) % 9."""
    strings = keep(strings, "trie-turns")
    first = strings.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("_first"), F.slice("turns", 1, SHARED - 1).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % SHARED).cast("int")
    joined = strings.join(first, F.col("conv_id") - F.col("conv_id") % GROUP == F.col("_first"), "left").withColumn("_h", h)
    none = F.slice("turns", 1, 0)
    own = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0)))
    turns = F.concat(F.slice(F.coalesce("_head", none), F.lit(1), F.col("_h")), own)
    hexed = F.array_join(F.transform("_turns", lambda t: F.hex(t["id"])), "")
    return joined.select("conv_id", turns.alias("_turns")).select(
        "conv_id", F.unhex(hexed).alias("seq"), F.transform("_turns", lambda t: t["size"]).alias("sizes"))


def _hash_ends(batches):
    """(code, smallest, n, ends_sha256) of rows that come sorted by code and conv_id."""
    rows = ((code, conv_id) for b in batches for code, conv_id in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    out = []
    for _, group in itertools.groupby(rows, key=lambda row: row[0]):
        smallest = next(group)[1]
        h, n = hashlib.sha256(str(smallest).encode()), 1
        for _, conv_id in group:
            h.update(b",%d" % conv_id)
            n += 1
        out.append((smallest, n, h.hexdigest()))
        if len(out) == 10_000:
            yield _batch(out, _ENDS)
            out = []
    if out:
        yield _batch(out, _ENDS)


_ENDS = {"smallest": pa.int64(), "n": pa.int64(), "ends": pa.string()}


def _batch(rows: list[tuple], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(column), kind) for column, kind in zip(zip(*rows), kinds.values())], list(kinds))


def distinct_strings(rebuilt: DataFrame) -> DataFrame:
    """seq, sizes, smallest, n, ends: every different string once, with the conversations that are it."""
    rebuilt = keep(rebuilt, "trie-rebuilt")
    dealt = rebuilt.select(F.sha2("seq", 256).alias("code"), "conv_id").repartition("code").sortWithinPartitions("code", "conv_id")
    ends = keep(dealt.mapInArrow(_hash_ends, "smallest long, n long, ends string"), "trie-ends")
    return rebuilt.join(ends, F.col("conv_id") == F.col("smallest")).drop("conv_id")


# --- nodes of a chain and of a container

_NODE = {"conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(),
         "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string(), "up": pa.string()}
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, up string"


def _chains(batches):
    """The nodes from each burst head down to where its strings part; only the head's own row names its ``up``."""
    for b in batches:
        for row in b.to_pylist():
            top, low, n = row["depth"], row["low"], row["members"]
            own = (n - 1) * np.array([row["sizes"][d - 1] if d else 0 for d in range(top, low + 1)], np.int64)
            saved = (np.cumsum(own[::-1])[::-1] + row["saved"]).tolist()
            for begin in range(top, low + 1, 10_000):
                depths = range(begin, min(begin + 10_000, low + 1))
                yield _batch([(row["smallest"], d, row["parent"] if d == top else row["smallest"], n, 1 if d < low else row["children"], row["leaves"],
                               saved[d - top], row["ends"] or _NO_ENDS if d == low else _NO_ENDS, row["up"] if d == top else None) for d in depths], _NODE)


class _Open:
    """A node whose strings are still coming."""

    __slots__ = ("depth", "size", "smallest", "n", "leaves", "saved", "ends", "children")

    def __init__(self, depth: int, size: int):
        self.depth, self.size = depth, size
        self.smallest, self.n, self.leaves, self.saved, self.ends, self.children = None, 0, 0, 0, _NO_ENDS, []


def sweep(strings: list[tuple], depth: int, parent: int | None, up: str | None) -> list[tuple]:
    """All nodes of a container from its head on; ``strings``: sorted (seq, sizes, smallest, n, ends)."""
    rows: list[list] = []
    first = strings[0][1]
    path = [_Open(depth, first[depth - 1] if depth else 0)]

    def close() -> None:
        node = path.pop()
        saved = node.saved + (node.n - 1) * node.size
        for i in node.children:
            rows[i][2] = node.smallest
        rows.append([node.smallest, node.depth, parent, node.n, len(node.children), node.leaves or 1, saved, node.ends, None])
        if path:
            above = path[-1]
            above.children.append(len(rows) - 1)
            above.n, above.leaves, above.saved = above.n + node.n, above.leaves + (node.leaves or 1), above.saved + saved
            above.smallest = node.smallest if above.smallest is None else min(above.smallest, node.smallest)

    before = strings[0][0]
    for seq, sizes, smallest, n, ends in strings:
        shared, most = depth, min(len(before), len(seq)) // _ID
        while shared < most and before[shared * _ID:(shared + 1) * _ID] == seq[shared * _ID:(shared + 1) * _ID]:
            shared += 1
        while path[-1].depth > shared:
            close()
        path.extend(_Open(d, sizes[d - 1]) for d in range(path[-1].depth + 1, len(seq) // _ID + 1))
        end = path[-1]
        end.n, end.ends = end.n + n, ends
        end.smallest = smallest if end.smallest is None else min(end.smallest, smallest)
        before = seq
    while path:
        close()
    rows[-1][8] = up
    return [tuple(r) for r in rows]


def _sweep_containers(batches):
    names = ("head", "depth", "parent", "up", "seq", "sizes", "smallest", "n", "ends")
    rows = (row for b in batches for row in zip(*(b.column(k).to_pylist() for k in names)))
    out = []
    for (_, depth, parent, up), group in itertools.groupby(rows, key=lambda row: row[:4]):
        out += sweep(sorted(row[4:] for row in group), depth, parent, up)
        if len(out) >= 10_000:
            yield _batch(out, _NODE)
            out = []
    if out:
        yield _batch(out, _NODE)


# --- bursting

def _prefix(turns: int | str) -> F.Column:
    return F.substring("seq", F.lit(1), F.expr(f"CAST({turns} * {_ID} AS INT)"))


def _parted(rows: DataFrame) -> DataFrame:
    """Of every oversized container: what its chain of nodes needs, and ``low``, the depth at which its strings part."""
    heads = rows.groupBy("head").agg(F.min(F.struct("seq", "sizes")).alias("_a"), F.max("seq").alias("_z"), F.min("smallest").alias("smallest"),
                                     F.sum("n").alias("members"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("up").alias("up"))
    a, z = F.col("_a.seq"), F.col("_z")
    n = F.floor(F.least(F.octet_length(a), F.octet_length(z)) / _ID).cast("int")
    turn = lambda seq, i: F.substring(seq, i * _ID + 1, F.lit(_ID))
    differs = F.filter(F.sequence(F.lit(0), n), lambda i: (i == n) | (turn(a, i) != turn(z, i)))
    low = F.array_min(differs).cast("long")
    return heads.withColumn("low", low).select("head", "smallest", "members", "depth", "parent", "up", "low", F.slice("_a.sizes", F.lit(1), F.col("low").cast("int")).alias("sizes"))


def prefix_trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    strings = keep(distinct_strings(rebuild(turn_strings(conversations))), "trie-strings")
    rows = strings.withColumns({"head": F.lit(""), "depth": F.lit(0).cast("long"), "parent": F.lit(None).cast("long"), "up": F.lit(None).cast("string")})
    ready, bursts = [], []
    while True:
        left = F.octet_length("seq") / _ID - F.col("depth")
        sizes = keep(rows.groupBy("head").agg(F.sum(left).alias("_left"), F.count("*").alias("_strings")), "trie-sizes")
        large = sizes.where(F.col("_left") > limit).select("head")
        if not large.take(1):
            ready.append(rows)
            break
        ready.append(rows.join(large, "head", "left_anti"))
        big = rows.join(large, "head", "left_semi")
        heads = keep(_parted(big), "trie-heads")
        burst = big.drop("parent", "up", "depth").join(heads.select("head", "low", F.col("smallest").alias("parent")), "head")
        length = F.octet_length("seq") / _ID
        # a string that ends where the others part has no next turn; there is one at most, as strings differ
        ended = burst.where(length == F.col("low")).select("head", "ends")
        bursts.append(keep(heads.join(ended, "head", "left"), "trie-bursts"))
        on = burst.where(length > F.col("low"))
        rows = keep(on.select("seq", "sizes", "smallest", "n", "ends", F.sha2(_prefix("(low + 1)"), 256).alias("_next"),
                              (F.col("low") + 1).alias("depth"), "parent", F.col("head").alias("up")).withColumnRenamed("_next", "head"), "trie-rows")
    columns = ["head", "depth", "parent", "up", "seq", "sizes", "smallest", "n", "ends"]
    shards = reduce(DataFrame.unionByName, [r.select(*columns) for r in ready]).repartition("head").sortWithinPartitions("head")
    nodes = keep(shards.mapInArrow(_sweep_containers, NODES), "trie-nodes")
    for heads in reversed(bursts):
        below = nodes.where("up IS NOT NULL").groupBy(F.col("up").alias("head")).agg(
            F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        filled = heads.join(below, "head", "left").withColumns({
            "children": F.coalesce("children", F.lit(0)), "leaves": F.coalesce("leaves", F.lit(1)), "saved": F.coalesce("saved", F.lit(0))})
        nodes = nodes.unionByName(keep(filled.mapInArrow(_chains, NODES), "trie-chains"))
    return nodes.drop("up")


ORACLE = f"""
WITH RECURSIVE {TABLES},
t AS (SELECT conv_id c, turn, strlen(coalesce(text, '')) size, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) id
      FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, size, id, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, id) p FROM t),
ids AS (SELECT c, {crc32_sql("c")} % 9 h FROM (SELECT DISTINCT c FROM t), crc),
rebuilt AS (SELECT ids.c, size, id, 0 side, p FROM ids JOIN own ON own.c = ids.c - ids.c % 5 AND p <= h
            UNION ALL SELECT c, size, id, 1, p FROM ids JOIN own USING (c) WHERE p > h),
steps AS (SELECT c, size, id, row_number() OVER (PARTITION BY c ORDER BY side, p) d FROM rebuilt),
paths AS (SELECT c, size, d, sha256(string_agg(id, '') OVER (PARTITION BY c ORDER BY d)) k FROM steps UNION ALL SELECT c, 0, 0, '' FROM ids),
lengths AS (SELECT c, max(d) n FROM paths GROUP BY c),
nodes AS (SELECT k, d, min(c) m, count(*) n, any_value(size) size FROM paths GROUP BY k, d),
parents AS (SELECT nodes.k, p.k up FROM nodes JOIN paths p ON p.c = m AND p.d = nodes.d - 1),
children AS (SELECT up k, count(*) n_children FROM parents GROUP BY up),
whole AS (SELECT nodes.*, coalesce(n_children, 0) n_children FROM nodes LEFT JOIN children USING (k)),
sums AS (SELECT p.k, count(*) FILTER (n_children = 0) n_leaves, sum((n - 1) * w.size) saved FROM whole w JOIN paths p ON p.c = w.m AND p.d <= w.d GROUP BY p.k),
ends AS (SELECT k, sha256(string_agg(c, ',' ORDER BY c)) e FROM paths JOIN lengths USING (c) WHERE d = lengths.n GROUP BY k)
SELECT w.m conv_id, w.d AS depth, up.m parent_conv_id, w.n n_convs, w.n_children, n_leaves, CAST(saved AS BIGINT) saved_tokens, coalesce(e, sha256('')) ends_sha256
FROM whole w JOIN sums USING (k) LEFT JOIN ends USING (k) LEFT JOIN parents USING (k) LEFT JOIN nodes up ON up.k = parents.up
"""
