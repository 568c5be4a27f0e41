"""Merkle manifest of a dataset: a digest per document, per source and for all, with a proof for every document.

A digest H is the lower-case hex SHA-256 of its inputs one after the other, digests as hex text. A leaf is H of doc_id, source, lang,
n_chars and text, each ``-`` if null, else its UTF-8 byte count, ``:`` and the value. In a tree every ``FAN`` consecutive nodes become
their H while more than one is left. Leaves of a source, by doc_id, make its subroot; subroots, by source, make the root.

**Cogrouped subtree exchange.** Leaves are hashed where the documents are read and only digests travel. Sorted ranges give each leaf
its position: numbers within a range, plus what earlier ranges hold of its source, which only the first source of a range needs.
Then superblocks of ``FAN ** LEVELS`` positions are reduced to one node each, their nodes again as positions of the next round,
until a tree is one superblock: two or three rounds for any size. Back down, each superblock's nodes are cogrouped with its outer
path (the siblings above it, some kilobytes): one ``applyInPandas`` finishes the local reduction, joins local siblings to the outer
ones and hands every node its path; at the leaves it makes the proof and folds the path on to the root. No group is larger than
a superblock, whatever a source holds. The tree over the sources runs through the same two passes.

Null in any column is written ``-``; a null source is a source of its own and the first one, a null doc_id comes first. Rows of equal
doc_id are ordered by leaf; repeated rows are leaves of their own, and those that are equal get the positions in any order (only the
proofs of such rows differ). Empty table: no rows. Other columns are not looked at.
"""
from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glassledger.llm.crc import TABLES, crc32_sql
from glassledger.llm.store import keep

FAN = 16
LEVELS = 3
TAMPERED = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(documents: DataFrame) -> DataFrame:
    """doc_id, source, leaf, tampered: the second leaf is that of the tampered row, null where rows stay as they are."""
    d = documents.select("doc_id", F.col("source").cast("string").alias("source"), "lang", "n_chars", "text")

    def leaf(text: Column) -> Column:
        return F.sha2(F.concat(*(_field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text))), 256)

    chosen = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    lower = F.translate(F.col("text"), _UPPER, _LOWER)
    return d.select(F.col("doc_id").cast("long"), "source", leaf(F.col("text")).alias("leaf"), F.when(chosen, leaf(lower)).alias("tampered"))


# --- positions

def _numbered(batches):
    """Adds the range and the number within range and tree to rows that come sorted by tree."""
    part, tree, n = TaskContext.get().partitionId(), None, -1
    for b in batches:
        numbers = []
        for t in b.column("tree").to_pylist():
            tree, n = t, n + 1 if t == tree else 0
            numbers.append(n)
        columns = [*b.columns, pa.array([part] * len(numbers), pa.int64()), pa.array(numbers, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, "range", "no"])


def with_positions(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows with ``pos``, their place within ``tree`` by ``order``; and (tree, n) of all trees."""
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", range long, no long"
    dealt = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    numbered = keep(dealt.mapInArrow(_numbered, kind), "merkle-numbered")
    counts = numbered.groupBy("tree", "range").agg((F.max("no") + 1).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("tree").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    counts = keep(counts.withColumn("_before", earlier), "merkle-ranges")
    # only a range's first tree can have begun in an earlier range, so there is one row for each range at most
    begun = F.broadcast(counts.where("_before > 0").select("tree", "range", "_before"))
    placed = numbered.join(begun, ["tree", "range"], "left").withColumn("pos", F.col("no") + F.coalesce("_before", F.lit(0)))
    return placed.drop("range", "no", "_before"), counts.groupBy("tree").agg(F.sum("_n").alias("n"))


# --- within a superblock

def _levels(nodes: list[str], lone: bool, depth: int) -> list[list[str]]:
    """The nodes and what they are reduced to: to one if the superblock is the whole tree, else ``depth`` times."""
    levels = [nodes]
    while len(levels[-1]) > 1 if lone else len(levels) <= depth:
        below = levels[-1]
        levels.append([digest(*below[i:i + FAN]) for i in range(0, len(below), FAN)])
    return levels


def _siblings(levels: list[list[str]], i: int) -> tuple[list[str], list[str]]:
    """What stands left and right of the i-th node in its run, level by level."""
    left, right = [], []
    for level in levels[:-1]:
        begin = i - i % FAN
        left.append("".join(level[begin:i]))
        right.append("".join(level[i + 1:begin + FAN]))
        i //= FAN
    return left, right


def fold(node: str, left: list[str], right: list[str]) -> str:
    for a, b in zip(left, right):
        node = digest(a, node, b)
    return node


_NODE = "tree string, pos long, node string, top string"


def _reduce(key: tuple, rows: pd.DataFrame, depth: int) -> pd.DataFrame:
    nodes = rows.sort_values("pos")["node"].tolist()
    return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "node": [_levels(nodes, False, depth)[-1][0]], "top": [_levels(nodes, True, depth)[-1][0]]})


_PATH = "tree string, superblock long, lone boolean, lefts array<string>, rights array<string>, subroot string, root string"


def _hand_down(key: tuple, rows: pd.DataFrame, outer: pd.DataFrame, depth: int) -> pd.DataFrame:
    """Every node's path: its siblings within the superblock, then the superblock's own."""
    rows, above = rows.sort_values("pos"), outer.iloc[0]
    levels = _levels(rows["node"].tolist(), above["lone"], depth)
    paths = [_siblings(levels, i) for i in range(len(rows))]
    return pd.DataFrame({"tree": key[0], "superblock": rows["pos"].tolist(), "lone": False, "lefts": [a + list(above["lefts"]) for a, _ in paths],
                         "rights": [b + list(above["rights"]) for _, b in paths], "subroot": above["subroot"], "root": above["root"]})


_PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _prove(key: tuple, rows: pd.DataFrame, outer: pd.DataFrame, depth: int) -> pd.DataFrame:
    """Reduces a superblock of leaves, joins the outer path and folds every leaf up to the root."""
    rows, above = rows.sort_values("pos"), outer.iloc[0]
    nodes, changed = rows["node"].tolist(), rows["tampered"].tolist()
    levels = _levels(nodes, above["lone"], depth)
    proofs, folded = [], []
    for i, node in enumerate(nodes):
        left, right = _siblings(levels, i)
        left, right = left + list(above["lefts"]), right + list(above["rights"])
        proofs.append(digest(*(a + b for a, b in zip(left, right))))
        folded.append(fold(changed[i] if isinstance(changed[i], str) else node, left, right))
    return pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), "leaf": nodes, "subroot": above["subroot"], "root": above["root"], "proof_sha256": proofs,
                         "folded_root": folded, "verified": [f == above["root"] for f in folded]})


# --- whole trees

class _Forest:
    """Trees of positioned nodes, reduced and proved by superblocks of ``FAN ** depth`` positions."""

    def __init__(self, nodes: DataFrame, sizes: DataFrame, depth: int):
        self.depth, self.width = depth, FAN ** depth
        self.nodes = nodes
        most, self.n_rounds = sizes.agg(F.max("n")).first()[0] or 0, 0
        last = F.lit(0)  # the round in which a tree is one superblock
        while most > self.width ** (self.n_rounds + 1):
            self.n_rounds += 1
            last = F.when(F.col("n") > self.width ** self.n_rounds, self.n_rounds).otherwise(last)
        self.rounds, self.tops = self._reduced(keep(sizes.select("tree", last.alias("round")), "merkle-rounds"))

    def _blocks(self, nodes: DataFrame) -> DataFrame:
        return nodes.withColumn("superblock", F.floor(F.col("pos") / self.width))

    def _reduced(self, last: DataFrame) -> tuple[list[DataFrame], DataFrame]:
        """The nodes of every round, and (tree, round, top): what each tree comes to."""
        depth, rounds, tops = self.depth, [self.nodes.select("tree", "pos", "node")], []
        for r in range(self.n_rounds + 1):
            reduced = self._blocks(rounds[r]).groupBy("tree", "superblock").applyInPandas(lambda key, rows: _reduce(key, rows, depth), _NODE)
            up = keep(reduced.join(last, "tree"), "merkle-nodes")
            tops.append(up.where(F.col("round") == r).select("tree", "round", "top"))
            rounds.append(up.where(F.col("round") > r).select("tree", "pos", "node"))
        return rounds[:-1], reduce(DataFrame.unionByName, tops)

    def _outer(self, above: DataFrame) -> DataFrame:
        """The outer paths of the superblocks of ``nodes``; ``above``: (tree, round, lefts, rights, subroot, root), the paths above whole trees."""
        depth, paths = self.depth, None
        whole = above.select("tree", F.lit(0).cast("long").alias("superblock"), F.lit(True).alias("lone"), "lefts", "rights", "subroot", "root", "round")
        for r in reversed(range(self.n_rounds + 1)):
            here = whole.where(F.col("round") == r).drop("round")
            here = here if paths is None else here.unionByName(paths)
            if r:
                paths = keep(self._cogrouped(self.rounds[r], here).applyInPandas(lambda key, rows, outer: _hand_down(key, rows, outer, depth), _PATH), "merkle-paths")
        return here

    def _cogrouped(self, nodes: DataFrame, outer: DataFrame):
        return self._blocks(nodes).groupBy("tree", "superblock").cogroup(outer.groupBy("tree", "superblock"))

    def paths(self, above: DataFrame) -> DataFrame:
        """The path of every node, under its position as ``superblock``."""
        depth = self.depth
        return self._cogrouped(self.nodes, self._outer(above)).applyInPandas(lambda key, rows, outer: _hand_down(key, rows, outer, depth), _PATH)

    def proofs(self, above: DataFrame) -> DataFrame:
        depth = self.depth
        return self._cogrouped(self.nodes, self._outer(above)).applyInPandas(lambda key, rows, outer: _prove(key, rows, outer, depth), _PROOF)


def manifest(documents: DataFrame, depth: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document."""
    hashed = keep(leaves(documents), "merkle-leaves")
    # the null source sorts before every other, the empty one included
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    placed, sizes = with_positions(hashed.select(tree.alias("tree"), "doc_id", F.col("leaf").alias("node"), "tampered"), ["doc_id", "node"])
    docs = _Forest(keep(placed, "merkle-placed"), sizes, depth)
    subroots = keep(docs.tops.select(F.col("tree").alias("name"), "round", "top"), "merkle-subroots")
    placed, sizes = with_positions(subroots.select(F.lit("all").alias("tree"), "name", F.col("top").alias("node")), ["name"])
    sources = _Forest(keep(placed, "merkle-sources"), sizes, depth)
    none = F.array().cast("array<string>")
    root = sources.tops.select("tree", "round", none.alias("lefts"), none.alias("rights"), F.col("top").alias("subroot"), F.col("top").alias("root"))
    paths = sources.paths(root).select(F.col("superblock").alias("pos"), "lefts", "rights", "root")
    above = (sources.nodes.select("pos", "name").join(paths, "pos").join(subroots, "name")
             .select(F.col("name").alias("tree"), "round", "lefts", "rights", F.col("top").alias("subroot"), "root"))
    return docs.proofs(keep(above, "merkle-above"))


ORACLE = f"""
WITH RECURSIVE {TABLES},
d AS (SELECT row_number() OVER () id, coalesce('s' || source, '') tree, * FROM documents),
marked AS (SELECT d.*, doc_id IS NOT NULL AND {crc32_sql("doc_id")} % 5 = 0 tamper FROM d, crc),
head AS (SELECT id, tree, doc_id, tamper, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') low,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') h FROM marked),
leaf AS (SELECT id, tree, doc_id, tamper, sha256(h || coalesce(strlen(text) || ':' || text, '-')) leaf,
    sha256(h || coalesce(strlen(low) || ':' || low, '-')) other FROM head),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 pos FROM leaf),
nodes(tree, lvl, pos, node) AS (
  SELECT tree, 0, pos, leaf FROM placed UNION ALL
  SELECT tree, lvl + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) c FROM nodes) WHERE c > 1 GROUP BY tree, lvl, pos // 16),
tops AS (SELECT tree, max(lvl) lvl FROM nodes GROUP BY tree),
sub AS (SELECT tree, node, row_number() OVER (ORDER BY tree) - 1 pos FROM nodes JOIN tops USING (tree, lvl)),
above(lvl, pos, node) AS (
  SELECT 0, pos, node FROM sub UNION ALL
  SELECT lvl + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER () c FROM above) WHERE c > 1 GROUP BY lvl, pos // 16),
root AS (SELECT node root FROM above ORDER BY lvl DESC LIMIT 1),
runs AS (SELECT tree, lvl, pos // 16 run, list(node ORDER BY pos) l FROM nodes GROUP BY ALL),
above_runs AS (SELECT lvl, pos // 16 run, list(node ORDER BY pos) l FROM above GROUP BY ALL),
steps AS (
  SELECT id, r.lvl, l, (placed.pos // CAST(pow(16, r.lvl) AS BIGINT)) % 16 i FROM placed JOIN tops USING (tree)
  JOIN runs r ON r.tree = placed.tree AND r.lvl < tops.lvl AND r.run = placed.pos // CAST(pow(16, r.lvl + 1) AS BIGINT)
  UNION ALL
  SELECT id, 100 + r.lvl, l, (sub.pos // CAST(pow(16, r.lvl) AS BIGINT)) % 16 FROM placed JOIN sub USING (tree)
  JOIN above_runs r ON r.run = sub.pos // CAST(pow(16, r.lvl + 1) AS BIGINT) AND r.lvl < (SELECT max(lvl) FROM above)),
sides AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY lvl) k, array_to_string(l[:CAST(i AS INT)], '') a,
  array_to_string(l[CAST(i AS INT) + 2:], '') b FROM steps),
proofs AS (SELECT id, sha256(string_agg(a || b, '' ORDER BY k)) proof FROM sides GROUP BY id),
folded(id, k, node) AS (
  SELECT id, 0, CASE WHEN tamper THEN other ELSE leaf END FROM placed UNION ALL
  SELECT f.id, s.k, sha256(s.a || f.node || s.b) FROM folded f JOIN sides s ON s.id = f.id AND s.k = f.k + 1),
ends AS (SELECT id, arg_max(node, k) folded_root FROM folded GROUP BY id)
SELECT doc_id, leaf, sub.node subroot, root, coalesce(proof, sha256('')) proof_sha256, folded_root, folded_root = root verified
FROM placed JOIN sub USING (tree) JOIN ends USING (id) LEFT JOIN proofs USING (id), root
"""
