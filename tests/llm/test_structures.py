"""Prefix trie, Merkle manifest and WARC archives against SQL on hostile tables: nulls, ties, repeats, long texts, clashing names, no rows."""
import random

import duckdb
import pytest

from glassledger.llm import merkle, near_dedup, prefix_trie, warc
from glassledger.llm.store import components
from oracle_check import compare

CONVERSATIONS = "conv_id long, turn long, role string, text string, head string, seq binary"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos int, node string"
PAGES = "page_id long, url string, html string, file string, value int, payload binary"


def both(spark, name, kind, rows, used, extra):
    """The rows as a frame with extra columns of clashing names, dealt out, and as a table for SQL."""
    con = duckdb.connect()
    names = [part.strip() for part in kind.split(",")][:used]
    con.execute(f"CREATE TABLE {name} ({', '.join(n.replace(' long', ' bigint').replace(' string', ' varchar') for n in names)})")
    if rows:
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * used)})", rows)
    return spark.createDataFrame([r + extra for r in rows], kind).repartition(4), con


def conversations():
    draw = random.Random(2)
    out = [(None, 0, "user", "of nobody")]
    for c in [*range(-12, 120), 10**12]:
        if c % 7 == 6:
            continue
        for k in range(300 if c == 60 else draw.choice((0, 1, 2, 3, 5, 9, 12))):
            text = draw.choice(("", "a", "é b", None, "x" * 3_000_000 if c == 61 and k == 0 else "y"))
            out.append((c, draw.choice((None, k, k, k)), draw.choice(("user", "assistant", None)), text if draw.random() < 0.5 else "same"))
    return out + out[5:9]


@pytest.mark.parametrize("limit", [prefix_trie.LIMIT, 60, 5])
def test_prefix_trie(spark, limit):
    df, con = both(spark, "conversations", CONVERSATIONS, conversations(), 4, ("x", b"y"))
    assert compare(spark, con, lambda s, _: prefix_trie.prefix_trie(df, limit), prefix_trie.ORACLE, "") is None


def test_prefix_trie_of_copies(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 400, 5) for t in range(4)] + [(5 * 10**6 + i, 0, "user", str(i)) for i in range(9)]
    df, con = both(spark, "conversations", CONVERSATIONS, rows, 4, ("x", b"y"))
    assert compare(spark, con, lambda s, _: prefix_trie.prefix_trie(df, 3), prefix_trie.ORACLE, "") is None
    assert prefix_trie.prefix_trie(df.limit(0)).collect() == []


def documents():
    out = [(None, "A", "x", None, 3), (None, "B", None, None, None), (1, None, None, "", None), (1, None, None, "", None), (5, "Éa A", "e", "s", 4),
           (5, "É", "e", "s", 4), (-7, "", "", "ß", 0), (9, "A long one " * 300_000, "en", "t", 3)]
    return out + [(i, f"T{i}", "en", "hot", i) for i in range(600)] + [(i, "t", None, f"one{i}", 1) for i in range(40)]


@pytest.mark.parametrize("depth", [1, 2, merkle.LEVELS])
def test_merkle_manifest(spark, depth):
    """Superblocks of 16 leaves give trees of several rounds, over sources too."""
    df, con = both(spark, "documents", DOCUMENTS, documents(), 5, ("x", 1, "z"))
    assert compare(spark, con, lambda s, _: merkle.manifest(df, depth), merkle.ORACLE, "") is None


def test_merkle_manifest_of_little(spark):
    df, con = both(spark, "documents", DOCUMENTS, documents()[6:7], 5, ("x", 1, "z"))
    assert compare(spark, con, lambda s, _: merkle.manifest(df), merkle.ORACLE, "") is None
    assert merkle.manifest(df.limit(0)).collect() == []


def html(draw):
    """Payloads that look like records, hold the magic or parts of it, or end within one."""
    nested = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\nContent-Length: 900\r\n\r\n"
    return draw.choice([
        None, "", "x" * 1200, nested + "y" * draw.randrange(300), "WARC/1.1\r\n" * draw.randrange(60) + "é" * draw.randrange(400),
        "WARC/WARC/1.1\r\n\r\n\r\nContent-Length: 3\r\n\r\nabc", "WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n" * draw.randrange(30),
        "z" * draw.randrange(3000), "\r\n\r\nWARC/1.1", "a\r\n\r\n" * 400])


def pages():
    draw = random.Random(5)
    out = [(i, draw.choice((None, f"http://a/{i}\r\nContent-Length: 1")), html(draw)) for i in range(200)]
    out += [(None, None, "q" * 1500), (None, None, "q" * 1500), (7, None, "q" * 1500), (7, None, "q" * 1500), (3, None, "q" * 1500)]
    return out + [(None, None, "n" * 1000), (None, None, "n" * 1000), (500, "u", "m" * 3_000_000), (501, "u", "WARC/1.1\r\n" * 5000)]


@pytest.mark.parametrize("block", ["128m", "3k", "500"])
def test_warc(spark, block):
    """Blocks of a few hundred bytes: records over many blocks, blocks without a record's beginning."""
    rows = pages() if block != "500" else pages()[:60]
    df, con = both(spark, "pages", PAGES, rows, 3, ("x", 1, b"z"))
    keys = {"spark.sql.files.maxPartitionBytes": block, "spark.sql.files.openCostInBytes": "100", "spark.sql.files.minPartitionNum": "500" if block == "3k" else "8"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        assert compare(spark, con, lambda s, _: warc.archive_index(df), warc.ORACLE, "") is None
    finally:
        for k in keys:
            spark.conf.unset(k)


def test_warc_of_nothing(spark):
    df, _ = both(spark, "pages", PAGES, [], 3, ())
    assert warc.archive_index(df).collect() == []


def test_warc_keeps_what_is_whole(spark, tmp_path):
    """Archives of another writer: a broken chain ends where it breaks, a file without a record at its start gives none."""
    record = lambda kind, body: b"WARC/1.1\r\nWARC-Type: " + kind + b"\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    (tmp_path / "good.warc").write_bytes(record(b"warcinfo", b"a: b") + record(b"resource", b"\xff\xfe WARC/1.1\r\n"))
    (tmp_path / "broken.warc").write_bytes(record(b"resource", b"one") + record(b"resource", b"two") + b"!" + record(b"resource", b"three"))
    (tmp_path / "short.warc").write_bytes(record(b"resource", b"one") + record(b"resource", b"two")[:-6])
    (tmp_path / "late.warc").write_bytes(b"x" + record(b"resource", b"one"))
    second = len(record(b"warcinfo", b"a: b"))
    got = sorted((r.file.rsplit("/")[-1], r.offset, r.record_type, bytes(r.payload)) for r in warc.read_archives(spark, str(tmp_path)).collect())
    assert got == [("broken.warc", 0, "resource", b"one"), ("good.warc", 0, "warcinfo", b"a: b"), ("good.warc", second, "resource", b"\xff\xfe WARC/1.1\r\n"),
                   ("short.warc", 0, "resource", b"one")]


@pytest.mark.parametrize("order", ["path", "hostile", "random"])
def test_components_of_long_chains(spark, order):
    """Chains whose ids run against the labels; rounds must grow with the logarithm of their length only."""
    n = 500
    ids = list(range(n)) if order == "path" else [0, *range(n - 1, 0, -1)] if order == "hostile" else random.Random(1).sample(range(n), n)
    edges = [(a, b) for a, b in zip(ids, ids[1:])] + [(1000, 1001), (1001, 1000), (2000, 2000), (1001, 1002)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(n)} | {1000: 1000, 1001: 1000, 1002: 1000}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def revisions(n, seed=6):
    """A chain of texts, each linked with its neighbours only, under hostile ids."""
    draw = random.Random(seed)
    words = [f"w{draw.randrange(10**6)}" for _ in range(120)]
    ids = [0, *range(n - 1, 0, -1)]
    out = []
    for i in ids:
        out.append((i, " ".join(words)))
        words = words[2:] + [f"w{draw.randrange(10**6)}" for _ in range(2)]
    return out


def test_near_duplicates_of_a_chain_of_revisions(spark):
    """120 revisions: 97 of a hundred shingles stay from one to the next, so two and more steps are linked as well, the ends are not."""
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in revisions(120)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.component_id for r in near_dedup.near_duplicates(df).collect()} == {0}


def test_recall_in_a_large_group_of_barely_similar_texts(spark):
    """300 texts around one base, pairs of some 0.80 to 0.90: at least nine in ten of the documents that brute force joins must be joined."""
    draw = random.Random(8)
    base = [f"b{i}" for i in range(200)]
    texts = []
    for i in range(300):
        words = list(base)
        for at in draw.sample(range(200), draw.choice((1, 2, 3))):
            words[at] = f"x{draw.randrange(10**6)}"
        texts.append((i, " ".join(words)))
    from test_llm import brute_links

    df = spark.createDataFrame([(i, t, None, None, None) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    want = brute_links(texts)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()}
    joined = [i for i, (_, c) in want.items() if c != i]
    assert len(joined) > 200 and sum(got[i] == want[i][1] for i in joined) >= 0.9 * len(joined)


def around(base, changes, n, seed):
    """n texts, each with some words of one base replaced."""
    draw, out = random.Random(seed), []
    for i in range(n):
        words = list(base)
        for at in draw.sample(range(len(base)), draw.choice(changes)):
            words[at] = f"x{draw.randrange(10**6)}"
        out.append((i, " ".join(words)))
    return out


def test_pairs_that_differ_too_much_leave_their_join(spark, monkeypatch):
    """250 texts of a large group, pairs of some 0.65 to 0.80 but for a few links: hardly another pair gets past its join, and only the texts of these are read."""
    from test_llm import brute_links

    texts = around([f"b{i}" for i in range(200)], (3, 4), 250, 9)
    texts += [(1000 + i, t + " end") for i, t in texts[:20]]
    met, read = [], []
    likely, confirm = near_dedup.likely, near_dedup.confirm

    def counted(pairs, *rest):
        met.append(pairs.count())
        return likely(pairs, *rest)

    def watched(pairs, texts, *rest):
        read.append({r.doc for r in texts.collect()} == {x for r in pairs.collect() for x in (r.a, r.b)})
        return confirm(pairs, texts, *rest)

    monkeypatch.setattr(near_dedup, "likely", counted)
    monkeypatch.setattr(near_dedup, "confirm", watched)
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute_links(texts)
    assert read and all(read) and sum(met) <= 3 * len(texts)


def test_may_link_passes_every_link(spark):
    """Pairs at any similarity, sets of 1 to some 6,000 shingles: what links passes, and what is far apart does not."""
    from pyspark.sql import functions as F

    long = [f"w{i}" for i in range(6000)]
    texts = around([f"b{i}" for i in range(120)], (0, 1, 2, 3, 6, 12), 40, 3) + [(100 + i, t) for i, t in around(long, (0, 30, 90, 150), 10, 4)]
    texts += [(200, "one"), (201, "one two"), (202, "one one"), (203, "x " * 50), (204, "X " * 50 + "y")]
    from test_llm import WORD

    def shingles(t):
        w = WORD.findall(t.lower())
        return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}

    sets = {i: shingles(t) for i, t in texts}
    df = spark.createDataFrame([(i, t) for i, t in texts], "doc_id long, text string")
    reps = near_dedup.sketches(df).select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), "odd")
    pairs = [(a, b) for a in sets for b in sets if a < b]
    for similar in (50, 80, 85, 99):
        links = {(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b])}
        got = {(r.a, r.b) for r in near_dedup.alike(spark.createDataFrame(pairs, "a long, b long"), reps, similar).collect()}
        assert links <= got and len(got) < len(pairs) / 2
        assert not any(100 * len(sets[a] & sets[b]) < (similar - 25) * len(sets[a] | sets[b]) for a, b in got if b < 100)


def test_few_rows_take_few_tasks(spark, monkeypatch):
    """90 shuffle partitions that nothing puts together: no table written on the way has more files than two a core, links stay the same."""
    from pathlib import Path

    from glassledger.llm import store
    from test_llm import brute_links

    texts = around([f"b{i}" for i in range(200)], (1, 2, 3), 120, 5) + [(1000 + i, f"{i} " * 3 + f"some words of text {i // 2} and {i // 2}") for i in range(80)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    files, keep = {}, store.keep

    def counted(rows, label):
        table = keep(rows, label)
        files[label] = max(files.get(label, 0), len(list(Path(table._kept_path.removeprefix("file:")).glob("*.parquet"))))
        return table

    monkeypatch.setattr(store, "keep", counted)
    monkeypatch.setattr(near_dedup, "keep", counted)
    held = {"spark.sql.shuffle.partitions": "90", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute_links(texts)
    assert {"classes", "nodes", "pairs", "edges"} <= set(files) and 0 < max(files.values()) <= 2 * spark.sparkContext.defaultParallelism, files


def test_tasks_grow_with_the_rows(spark):
    """As many tasks as the rows need, up to the partitions there are."""
    from glassledger.llm.store import ROWS, in_tasks

    df, least = spark.range(0, 1000, 1, 64), 2 * spark.sparkContext.defaultParallelism
    assert [in_tasks(df, n).rdd.getNumPartitions() for n in (0, 1000, (least + 9) * ROWS, 10 ** 9)] == [least, least, least + 9, 64]
    assert in_tasks(df, 0).count() == 1000
