"""Near duplicates by a chosen-path similarity join over minwise tokens.

A text's set holds its distinct shingles of five words (A-Z lower-cased). Texts of equal sets form one class. Of each class one
document goes down independent trees. A root chooses two of the ``TOKENS`` minwise tokens of a document, every other
node one, and a second with such a probability that it makes 1 / bound on average (``branching``): documents of less than that
similarity part on the way down, others stay together. Each token chosen names a child. Nodes of up to ``SMALL`` documents are
compared exhaustively; larger ones branch again, by several levels a job (``STEPS``). Before that, the nodes of the first ``STARS``
trees compare their documents with their smallest one, and at every step all large nodes those outside their largest connected part with one inside. Rows go down the trees
with the component known so far, and nodes whose documents are
all connected are done: whatever links they hold join nothing new; a node with few pairs left open (``SMALL`` for each of
its documents) has just those compared. Nodes still large and mixed after the last step
are compared in full. Documents meet with the parities of their shingles by ``64 * ODD`` hash values; two sets differ in as many shingles at least
as in parities, so a pair that differs in too many for the bound is no link and leaves the join that it met in (``may_link``, exact). Pairs that agree in fewer than ``fewest_common`` tokens are passed over (pairs at the bound do so with
a probability of 0.0003); the others are confirmed on their full sets, and only their texts are read again. A pair right at the bound misses all its first choices
with probability 0.15^24 (bound 0.85) or less; in large groups of barely similar texts it may part in all the paths it shares. All trees
choose among the same tokens, so ``missed`` averages over the number that agree: 0.001 after 11 levels below the root, 0.015 after 19, 0.064 after all 30
(0.002 at 0.90 under the bound of 0.85). The number of trees is the least that keeps the last figure under ``MISS`` for any bound.

Result: doc_id, n_shingles, component_id, kept. Null or empty text: an empty set, linked with nothing. Null doc_id: no node of
the graph; its component is that of its class, or null. Repeated rows: equal sets, so one class; a doc_id that comes with
several texts has the links of all of them. Ties: the smallest doc_id stays. An empty table gives none.
"""
from __future__ import annotations

from functools import lru_cache, reduce
from math import ceil, comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glassledger.llm.store import components, forget, in_tasks, keep
from glassledger.llm.words import Texts, grams, lower_ascii, map_texts, mix, runs, texts_of

SHINGLE = 5
SIMILAR = 85
TOKENS = 128
ODD = 16
MISS = 0.07
SMALL = 12
STARS = 2
STEPS = (1, 5, 7, 9, 9)


def missed(similarity: float, again: float, trees: int, levels: int) -> float:
    """The probability that a pair parts in all trees within so many levels, averaged over the number of tokens that agree."""
    total = 0.0
    for k in range(TOKENS + 1):
        agree, parted = k / TOKENS, 0.0
        for _ in range(levels - 1):
            one = 1 - agree + agree * parted
            parted = (1 - again) * one + again * one * one
        total += comb(TOKENS, k) * similarity ** k * (1 - similarity) ** (TOKENS - k) * (1 - agree + agree * parted) ** (2 * trees)
    return total


@lru_cache
def branching(similar: int) -> tuple[float, int]:
    """How often a node chooses a second token, and the number of trees, for pairs of ``similar`` hundredths or more."""
    again, trees = ceil(10_000 / similar - 100) / 100, 1
    while missed(similar / 100, again, trees, sum(STEPS)) > MISS:
        trees += 1
    return again, trees


def shingles(texts: Texts, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, one text after the other; and how many each has."""
    words = texts.words()
    codes, left, row = words.codes(lower_ascii(texts.data)), words.left(), words.row
    whole = grams(codes, n)
    at = np.flatnonzero(left[:len(whole)] >= n)
    found, of = [whole[at]], [row[at]]
    for few in range(1, n):  # a shorter text is one shingle
        chosen = np.flatnonzero(words.count == few)
        if len(chosen):
            first = words.first[chosen]
            found.append(grams(codes[first[:, None] + np.arange(few)].ravel(), few, few)[::few])
            of.append(chosen)
    codes, of = np.concatenate(found), np.concatenate(of)
    order = np.lexsort((codes, of))
    codes, of = codes[order], of[order]
    if len(codes):
        new = np.append(True, (codes[1:] != codes[:-1]) | (of[1:] != of[:-1]))
        codes, of = codes[new], of[new]
    return codes, np.bincount(of, minlength=texts.rows)


def _tokens(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """TOKENS minwise tokens of each set."""
    out = np.empty((len(starts), TOKENS), np.uint32)
    factors = mix(np.arange(TOKENS, dtype=np.uint64), 21) | np.uint64(1)
    for t in range(TOKENS):
        x = codes * factors[t]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        out[:, t] = np.minimum.reduceat((x >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _parities(codes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64 * ODD bits of each set: whether the shingles of a hash value are odd in number."""
    out, place = np.zeros((len(n), ODD), np.uint64), mix(codes, 41)
    np.bitwise_xor.at(out, (np.repeat(np.arange(len(n)), n), (place >> np.uint64(6)) % np.uint64(ODD)), np.uint64(1) << (place & np.uint64(63)))
    return out.view(np.int64)


def sketches(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, the set's 128-bit digest, its minwise tokens and its parities."""
    def task(rows, texts):
        codes, n = shingles(texts)
        some = np.flatnonzero(n)
        starts = (np.cumsum(n) - n)[some]
        tokens, odd, digests = ([None] * texts.rows for _ in range(3))
        if len(some):
            wide, bits, sums = _tokens(codes, starts), _parities(codes, n[some]), [np.add.reduceat(mix(codes, s), starts) for s in (31, 37)]
            for i, k in enumerate(some):
                tokens[k] = wide[i].tobytes()
                odd[k] = bits[i]
                digests[k] = sums[0][i].tobytes() + sums[1][i].tobytes()
        return {"doc_id": rows.column("doc_id"), "n_shingles": n, "digest": pa.array(digests, pa.binary()), "tokens": pa.array(tokens, pa.binary()), "odd": pa.array(odd, pa.list_(pa.int64()))}

    return map_texts(documents.select("doc_id", "text"), task, "doc_id long, n_shingles long, digest binary, tokens binary, odd array<long>")


def _branch(levels: int, again: float, first: bool = False):
    """From (doc, comp, tokens, nodes) rows, one a document, to the (node, doc, comp) rows of the nodes so many levels below.

    At a root both choices are taken. The nodes of a batch are taken some at a time, so that memory does not grow with them."""
    def task(batches):
        for batch in batches:
            tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint32).reshape(-1, TOKENS)
            nodes = batch.column("nodes")
            owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(nodes).to_numpy(zero_copy_only=False))
            nodes = nodes.flatten().to_numpy().view(np.uint64)
            for begin in range(0, len(nodes), 1 << 15):
                node, at = nodes[begin:begin + (1 << 15)], owner[begin:begin + (1 << 15)]
                for _ in range(levels):
                    place = mix(node, 51) % np.uint64(TOKENS)
                    more = first | (mix(node, 52) < np.uint64(int(again * 2.0 ** 64)))
                    other = (place + np.uint64(1) + mix(node, 53) % np.uint64(TOKENS - 1)) % np.uint64(TOKENS)  # never the same
                    place = np.concatenate([place, other[more]])
                    node, at = np.concatenate([node, node[more]]), np.concatenate([at, at[more]])
                    node = mix(mix(node, 57) ^ (place << np.uint64(32)) ^ tokens[at, place.astype(np.int64)], 59)
                of = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), *(batch.column(c).take(of) for c in ("doc", "comp"))], ["node", "doc", "comp"])

    return task


def _roots(trees: int) -> Column:
    """The roots of so many trees, the same for every document."""
    return F.array(*(F.lit(int(r)) for r in mix(np.arange(trees, dtype=np.uint64), 61).view(np.int64)))


def fewest_common(similar: int) -> int:
    """3.5 standard errors below what pairs at the bound have in common."""
    s = similar / 100
    return int(TOKENS * s - 3.5 * (TOKENS * s * (1 - s)) ** 0.5)


def may_link(similar: int) -> Column:
    """Whether the sets (n_a, odd_a) and (n_b, odd_b) may be similar enough: no link fails.

    Of n_a + n_b = n shingles, linked sets have n * (100 - similar) / (100 + similar) in one of them only at most."""
    room = (100 - similar) * (F.col("n_a") + F.col("n_b"))
    apart = reduce(lambda x, y: x + y, (F.bit_count(F.col("odd_a")[i].bitwiseXOR(F.col("odd_b")[i])) for i in range(ODD)))
    return ((100 + similar) * F.abs(F.col("n_a") - F.col("n_b")) <= room) & ((100 + similar) * apart <= room)


def _end(reps: DataFrame, end: str) -> DataFrame:
    return reps.select(F.col("doc").alias(end), F.col("n").alias(f"n_{end}"), F.col("odd").alias(f"odd_{end}"))


def alike(pairs: DataFrame, reps: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The pairs that ``may_link``."""
    with_a, b = pairs.distinct().join(_end(reps, "a"), "a"), _end(reps, "b").withColumnRenamed("b", "_b")
    return with_a.join(b, (F.col("b") == F.col("_b")) & may_link(similar)).select("a", "b")


def likely(pairs: DataFrame, reps: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The pairs, a written table, that agree in enough of their tokens (one byte of each is looked at)."""
    tokens = lambda end: reps.select(F.col("doc").alias(end), F.col("tokens").alias(f"tokens_{end}"))
    fewest = fewest_common(similar)
    met = pairs.join(tokens("a"), "a").join(tokens("b"), "b").select("a", "b", "tokens_a", "tokens_b")

    def task(batches):
        for rows in batches:
            if rows.num_rows:
                a, b = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint32).astype(np.uint8).reshape(-1, TOKENS) for c in ("tokens_a", "tokens_b"))
                yield pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b")], ["a", "b"]).filter(pa.array((a == b).sum(axis=1) >= fewest))

    return in_tasks(met, pairs.count()).mapInArrow(task, "a long, b long")


def confirm(pairs: DataFrame, texts: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The pairs (a, b), a written table, whose full sets are similar enough."""
    with_b = pairs.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b")
    with_both = with_b.join(texts.select(F.col("doc").alias("a"), "text"), "a").select("a", "b", "text", "text_b")

    def task(batches):
        for rows, left in runs(batches, 1 << 20):
            ca, na = shingles(left)
            cb, nb = shingles(texts_of(rows.column("text_b")))
            ea, eb = np.cumsum(na), np.cumsum(nb)
            linked = []
            for i in range(len(na)):
                both = len(np.intersect1d(ca[ea[i] - na[i]:ea[i]], cb[eb[i] - nb[i]:eb[i]], assume_unique=True))
                linked.append(bool(both) and 100 * both >= similar * (na[i] + nb[i] - both))
            yield pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b")], ["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return in_tasks(with_both, pairs.count()).mapInArrow(task, "a long, b long")


def _sized(rows: DataFrame) -> DataFrame:
    """node, doc, comp, least, major, hub, done: the rows of nodes whose documents are not all connected yet.

    The hub is a document of the largest part, drawn by a hash, so that each node of a large group offers another one.
    A node is done with when the pairs not yet connected number SMALL for each of its documents at most."""
    parts = rows.groupBy("node", "comp").agg(F.count("*").alias("_n"), F.min("doc").alias("_low"), F.min_by("doc", F.xxhash64("node", "doc")).alias("_hub"))
    nodes = (parts.groupBy("node").agg(F.sum("_n").alias("_size"), F.sum(F.col("_n") * F.col("_n")).alias("_squares"), F.min("_low").alias("least"),
                                       F.max(F.struct("_n", "comp", "_hub")).alias("_most"), F.count("*").alias("_parts")).where(F.col("_parts") > 1))
    open_pairs = (F.col("_size") * F.col("_size") - F.col("_squares")) / 2
    nodes = nodes.select("node", "least", F.col("_most.comp").alias("major"), F.col("_most._hub").alias("hub"), (open_pairs <= SMALL * F.col("_size")).alias("done"))
    return rows.join(nodes, "node")


def _with_components(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The documents with ``comp``, the component that each is known to be in; rows go down the trees with it."""
    if labels is None:
        return docs.withColumn("comp", F.col("doc"))
    return docs.join(labels.select(F.col("id").alias("doc"), "component"), "doc", "left").withColumn("comp", F.coalesce("component", "doc")).drop("component")


def _open_pairs(rows: DataFrame, reps: DataFrame, similar: int) -> DataFrame:
    """Of all pairs of a node that are not connected, those that ``may_link``: the documents outside its largest part meet all the others.

    Sizes and parities are joined once a document, to the list of its nodes."""
    nodes = rows.groupBy("doc").agg(F.collect_set(F.struct("node", "comp", "major")).alias("nodes"))
    rows = nodes.join(reps.select("doc", "n", "odd"), "doc").select("doc", "n", "odd", F.explode("nodes").alias("at")).select("at.*", "doc", "n", "odd")
    minor = rows.where(F.col("comp") != F.col("major")).select("node", F.col("doc").alias("a"), F.col("comp").alias("_a"), F.col("n").alias("n_a"), F.col("odd").alias("odd_a"))
    every = rows.select(F.col("node").alias("_node"), F.col("doc").alias("b"), "comp", "major", F.col("n").alias("n_b"), F.col("odd").alias("odd_b"))
    still = (F.col("comp") != F.col("_a")) & ((F.col("comp") == F.col("major")) | (F.col("a") < F.col("b")))
    met = minor.join(every, (F.col("node") == F.col("_node")) & still & may_link(similar))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _first_pairs(rows: DataFrame) -> DataFrame:
    """Nothing is connected yet: a node's smallest document meets all the others."""
    return rows.where(F.col("doc") > F.col("least")).select(F.col("least").alias("a"), F.col("doc").alias("b"))


def _star_pairs(rows: DataFrame) -> DataFrame:
    """The documents outside a node's largest part meet its hub; those inside are connected with it already."""
    return rows.where(F.col("comp") != F.col("major")).select(F.least("hub", "doc").alias("a"), F.greatest("hub", "doc").alias("b"))


def near_duplicates(documents: DataFrame, similar: int = SIMILAR, steps: tuple[int, ...] = STEPS) -> DataFrame:
    documents, (again, trees) = documents.select("doc_id", "text"), branching(similar)
    sketched = keep(sketches(documents), "sketch")
    classes = sketched.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("tokens").alias("tokens"), F.min("n_shingles").alias("n"), F.min("odd").alias("odd"))
    classes = keep(in_tasks(classes, sketched.count()), "classes")
    of_class = keep(sketched.select("doc_id", "n_shingles", "digest"), "of-class")
    forget(sketched)
    reps = classes.where("rep is not null").select(F.col("rep").alias("doc"), "tokens", "n", "odd")
    tested: list[DataFrame] = []
    labels = None

    def texts_of_ends(pairs: DataFrame) -> DataFrame:
        ends = keep(in_tasks(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), 2 * pairs.count()), "ends")
        texts = documents.join(ends, "doc_id", "left_semi").select(F.col("doc_id").alias("doc"), "text").distinct()
        texts = keep(in_tasks(texts, ends.count()), "texts")
        forget(ends)
        return texts

    def test(pairs: DataFrame, met: DataFrame) -> DataFrame:
        """Confirms the likely pairs, of those that ``may_link``, not confirmed before; the components that all links so far give.

        The pairs are those of the node rows ``met``; they are few for them, as hardly one may link."""
        # written, so that their number is known: the few sketches they need are taken from the others without a shuffle
        pairs = keep(in_tasks(pairs.distinct(), met.count()), "pairs")
        near = keep(reps.select("doc", "tokens").join(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "doc", "left_semi"), "ends")
        close = keep(reduce(lambda p, t: p.join(t, ["a", "b"], "left_anti"), tested, likely(pairs, near, similar)), "close")
        forget(pairs, near)
        tested.append(close)
        if labels is not None and not close.take(1):
            return labels
        texts = texts_of_ends(close)
        links = keep(confirm(close, texts, similar), "links")
        forget(texts)
        if labels is not None and not links.take(1):
            return labels
        if labels is not None:
            links = links.unionByName(labels.select(F.col("id").alias("a"), F.col("component").alias("b")))
        new = components(links)
        forget(labels)
        return new

    def below(docs: DataFrame, nodes: Column, levels: int, first: bool = False) -> DataFrame:
        return docs.select("doc", "comp", "tokens", nodes.alias("nodes")).mapInArrow(_branch(levels, again, first), "node long, doc long, comp long")

    def written(rows: DataFrame, number: float) -> DataFrame:
        return keep(in_tasks(_sized(rows), ceil(number)), "nodes")

    number = reps.count()
    # a first look: the nodes of a few trees, all compared with their smallest document, connect what is plainly alike
    sized = written(below(_with_components(reps, None), _roots(STARS), 1, True), number * STARS * 2)
    labels = test(alike(_first_pairs(sized), reps, similar), sized)
    forget(sized)
    sized = written(below(_with_components(reps, labels), _roots(trees), steps[0], True), number * trees * 2 ** steps[0])
    for step in range(1, len(steps) + 1):
        large = sized.where("not done")
        more = large.count()
        if more and step < len(steps):
            pairs = _open_pairs(sized.where("done"), reps, similar).unionByName(alike(_star_pairs(large), reps, similar))
        else:
            pairs = _open_pairs(sized, reps, similar)
        labels = test(pairs, sized)
        if not more or step == len(steps):
            break
        # Large nodes branch again; _sized drops those below them whose documents are all connected by now. A document comes with the
        # list of its nodes (as many as the trees and levels give, whatever the data), so components and tokens are joined once a document.
        left = large.groupBy("doc").agg(F.collect_list("node").alias("nodes"))
        rows = below(left.join(_with_components(reps, labels).select("doc", "comp", "tokens"), "doc"), F.col("nodes"), steps[step])
        before, sized = sized, written(rows, more * (1 + again) ** steps[step])
        forget(before)
    forget(sized)
    member = classes.select("digest", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    member = member.select("digest", F.coalesce("component", "rep").alias("_component"))
    out = of_class.join(member, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("_component")).alias("component_id")
    return out.select("doc_id", "n_shingles", component).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
