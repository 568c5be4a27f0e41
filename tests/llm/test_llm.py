"""The training-data operators against brute force, on small tables with nulls, ties, repeats and clashing names."""
import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from glassledger.llm import chat_format, decontamination, language_id, line_dedup, mixing, near_dedup, quality_classifier, quality_rules, substring_dedup, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, prefix string, label int, code long"
LABELS = "doc_id long, quality int, toxic int"


def table(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, langs[i] if langs else None, None, None, "x", 1, 2) for i, t in texts], SCHEMA)


def corpus(seed=3):
    """Copies, near copies, shared passages, nulls, blanks and odd spaces."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdeéü") for _ in range(draw.randint(2, 6))) for _ in range(300)]
    text = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    passage, base = text(30), text(120)
    out = [None, "", " \t\n", "one", "one two three", text(200), base, base, text(12), text(13)]
    for _ in range(12):
        words = base.split()
        words[draw.randrange(len(words))] = draw.choice(vocabulary)
        out.append(" ".join(words))
    for _ in range(6):
        out.append(text(draw.randint(0, 20)) + "\n" + passage + "\x0b" + text(draw.randint(0, 20)))
    out += ["ONE two THREE", "x " * 400]
    return list(enumerate(out))


def brute_links(texts, similar=85):
    sets = {}
    for i, t in texts:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if either and 100 * both >= similar * either:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates(spark):
    texts = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(table(spark, texts)).collect()}
    assert got == brute_links(texts)


def test_near_duplicates_in_large_nodes(spark):
    draw = random.Random(9)
    base = [f"w{draw.randrange(10_000)}" for _ in range(150)]
    texts = []
    for i in range(150):
        words = list(base)
        for _ in range(draw.choice((0, 1, 2, 4))):
            words[draw.randrange(150)] = f"v{draw.randrange(10_000)}"
        texts.append((i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(table(spark, texts)).collect()}
    assert got == brute_links(texts)


def test_pipeline_stage_takes_pairs_from_080(spark):
    """Pairs between the stage's bound and op3's, alone and in a large node."""
    import corpus_pipeline as pipeline

    draw, texts = random.Random(12), corpus()
    for size in [2] * 30 + [60]:
        base = [f"w{draw.randrange(10_000)}" for _ in range(150)]
        for i in range(size):
            words = list(base)
            for at in range(30, 30 + 40 * (i > 0) * (3 if size == 2 else draw.choice((1, 2, 3))), 40):
                words[at + draw.randrange(9)] = f"v{draw.randrange(10_000)}"
            texts.append((len(texts), " ".join(words)))
    want = brute_links(texts, 80)
    kept = {i for i, (_, component) in want.items() if i == component}
    assert kept < {i for i, (_, component) in brute_links(texts).items() if i == component}
    docs = table(spark, texts)
    assert {r.doc_id for r in pipeline.near_dedup(spark, docs, "").collect()} == kept
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, 80).collect()} == want
    assert near_dedup.SIMILAR == 85


def test_branching_keeps_the_recall():
    """At any bound, averaged over the tokens that agree, down to the last level."""
    for similar in (70, 80, 85, 90):
        again, trees = near_dedup.branching(similar)
        assert again >= 100 / similar - 1
        assert near_dedup.missed(similar / 100, again, trees, sum(near_dedup.STEPS)) <= near_dedup.MISS
    assert near_dedup.missed(0.80, 0.18, 12, 32) > 0.3


def test_substrings(spark):
    texts = corpus()
    words = {i: WORD.findall(t or "") for i, t in texts}
    least = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            least.setdefault(tuple(words[i][k:k + 13]), i)
    want = {}
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - 12) if least[tuple(w[k:k + 13])] < i for j in range(13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    for group in (substring_dedup.GROUP, 1):  # prefixes lengthened, or not
        before, substring_dedup.GROUP = substring_dedup.GROUP, group
        try:
            got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_substrings(table(spark, texts)).collect()}
        finally:
            substring_dedup.GROUP = before
        assert got == want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_band_automaton():
    draw, first, second = random.Random(1), [], []
    for _ in range(2000):
        a = "".join(draw.choice("abé") for _ in range(draw.randint(0, 12)))
        b = list(a)
        for _ in range(draw.randint(0, 4)):
            at = draw.randint(0, len(b))
            b[at:at + draw.randint(0, 1)] = draw.choice(["", "a", "é", "ab"])
        first.append(a)
        second.append("".join(b))
    for edits in (1, 2, 3):
        assert [bool(x) for x in line_dedup.within(first, second, edits)] == [distance(a, b) <= edits for a, b in zip(first, second)]


def test_line_links(spark):
    """Every pair within the bound is linked, whatever the letters and lengths."""
    draw, found = random.Random(4), set()
    for base in ("the quick brown fox jumps", "Żółć été дом 語言処理 naïve", "a" * 22):
        for _ in range(25):
            line = list(base)
            for _ in range(draw.randrange(4)):
                at = draw.randrange(len(line))
                line[at:at + draw.randrange(2)] = draw.choice(["", "é", "x", "語", "a"])
            found.add("".join(line))
    found = sorted(x for x in found if len(x) >= 20)
    lines = spark.createDataFrame([(x,) for x in found], "line string").repartition(3)
    codes = {r.code: r.line for r in lines.selectExpr("line", "xxhash64(line) AS code").collect()}
    got = [tuple(sorted((codes[r.a], codes[r.b]))) for r in line_dedup.line_links(lines).collect()]
    want = {(a, b) for a, b in itertools.combinations(found, 2) if distance(a, b) <= 2}
    assert len(got) == len(want) and set(got) == want and want


def test_lines(spark):
    draw, texts = random.Random(2), [(0, None), (1, ""), (2, "short\nshort")]
    pool = ["".join(draw.choice("abcdefgh ü") for _ in range(draw.randint(20, 40))) for _ in range(12)]
    for i in range(3, 30):
        lines = []
        for _ in range(draw.randint(1, 5)):
            line = list(draw.choice(pool))
            for _ in range(draw.choice((0, 0, 1, 2, 3))):
                line[draw.randrange(len(line))] = draw.choice("abc")
            lines.append("".join(line))
        texts.append((i, "\n".join(lines)))
    seen, want = [], {}
    for i, t in texts:
        gone = []
        for k, line in enumerate((t or "").split("\n") if t is not None else []):
            if len(line) >= 20:
                if any(distance(line, x) <= 2 for x in seen):
                    gone.append(k)
                seen.append(line)
        want[i] = gone
    docs = table(spark, texts)
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {i: len(g) for i, g in want.items()}
    rest = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(docs).collect()}
    assert rest == {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i]) for i, t in texts}


def test_short_repeats(spark, tmp_path):
    """In the query and the stage a repeat of any line with a word goes; edits count from 20 code points on."""
    import corpus_pipeline as pipeline
    from glassledger.llm import queries

    draw = random.Random(8)
    pool = ["a", "Les.", "Les,", "And ornd.", "é", "x" * 19, "y" * 19 + "z", "y" * 20, "", "  ", "\t", "a sentence of more than twenty", "a sentence of more than twentx"]
    texts = [(0, None), (1, ""), (2, "short\nshort")] + [(i, "\n".join(draw.choice(pool) for _ in range(draw.randint(1, 6)))) for i in range(3, 40)]
    seen, want = [], {}
    for i, t in texts:
        want[i] = []
        for k, line in enumerate(t.split("\n") if t is not None else []):
            if WORD.search(line):
                if any(line == x or min(len(line), len(x)) >= 20 and distance(line, x) <= 2 for x in seen):
                    want[i].append(k)
                seen.append(line)
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_removed for r in queries.op1_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: len(g) for i, g in want.items()} and want[2] == [1]
    rest = {r.doc_id: r.text for r in pipeline.line_dedup(spark, table(spark, texts), "").collect()}
    assert rest == {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i]) for i, t in texts}


def test_seeds_find_every_window_within_the_bound():
    def found(n, misses):
        return all(any(all(p + s not in out for p in seed) for seed in decontamination.SEEDS for s in range(n - max(seed)))
                   for out in map(set, itertools.combinations(range(n), misses)))

    assert found(decontamination.WINDOW, decontamination.MISSES)
    for n in range(decontamination.LEAST_WORDS, decontamination.WINDOW):
        assert found(n, 1 if n >= 10 else 0), n


def test_decontamination(spark):
    words = [f"b{i}" for i in range(40)]
    changed = list(words)
    for at in (3, 17, 33):
        changed[at] = "other"
    spoilt = [w if i % 4 else "other" for i, w in enumerate(words)]
    texts = [(0, None), (1, ""), (2, "a b " + " ".join(words)), (3, " ".join(changed)), (4, " ".join(spoilt)), (5, "b0 b1 b2"),
             (6, " ".join(words[10:30])), (7, " ".join(words[10:29])), (8, "s0 s1 s2 s3 s4 s5 s6"), (None, " ".join(words))]
    benchmark = spark.createDataFrame([(0, " ".join(words)), (1, None), (2, ""), (3, "b0 b1"), (4, "s0 s1 s2 s3 s4 s5 s6"), (None, "a b")], "item_id long, text string")
    got = {r.doc_id: r.n_items for r in decontamination.decontaminate(table(spark, texts), benchmark).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 0, 5: 0, 6: 1, 7: 0, 8: 1, None: 1}
    apart = {r.doc_id: r.n_items for r in decontamination.decontaminate(table(spark, texts), benchmark, broadcast_seeds=0).collect()}
    assert apart == got


def test_chat_round_trip(spark):
    texts = [chat_format.PROBE, "", None, "a\\", "<", "<|", "\\<|x|>\n", "é<\\|im_end|>", "line\nbreak"]
    rows = [(c, t, r, x) for c in (0, None) for t, (r, x) in enumerate(itertools.product(["user", "assistant", "a\nb<|", None], texts))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat_format.format_conversations(df, keep_text=True).collect():
        want = [(a or "", b or "") for c, _, a, b in rows if c == r.conv_id]
        loss = "".join(b for a, b in want if a == "assistant")
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want).encode()).hexdigest()
        assert (r.n_turns, r.loss_chars, r.formatted_chars) == (len(want), len(loss), len(r.formatted))
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted.count(chat_format.START) == len(want) == r.formatted.count(chat_format.END)


def test_template_language():
    run = lambda t, **s: "".join(p for p, _ in chat_format.compile_template(t)(s))
    assert run("{% if a == 'x' and not b %}1{% elif b %}2{% else %}3{% endif %}", a="x", b="") == "1"
    assert run("{% for m in r %}{{ m.k + '!' }}{% endfor %}", r=[{"k": "a"}, {"k": "b"}]) == "a!b!"
    assert chat_format.fold_body(chat_format.parse("a{{ 'b' + 'c' }}{% if 'x' == 'x' %}d{% endif %}"), {})[0] == ("out", ("const", "abc"))
    for wrong in ("{% for x in y %}", "{{ a( }}", "{{ a.__class__.b }}", "{% import os %}", "{{ a | nothing }}", "{% endif %}"):
        with pytest.raises(chat_format.TemplateError):
            run(wrong, a="text")


def test_ppm_code_lengths(spark):
    texts = [(i, t) for i, t in enumerate(["abracadabra", "abab abba", "öffnung über", "über alles ö", "", None, "123 !", "cab"])]
    langs = ["en", "en", "de", "de", "en", "de", None, None]
    docs = table(spark, texts, langs)
    counts = language_id.byte_counts(docs, language_id.learning_ids(docs)).toPandas()
    model = language_id.Model(counts.sort_values(["lang", "key"]))
    learned = [(t, x) for (i, t), x in zip(texts, langs) if t is not None and x and __import__("zlib").crc32(str(i).encode()) % 5]
    contexts = {}
    for text, lang in learned:
        code = [0, 0, 0, *model.code[np.frombuffer(text.encode(), np.uint8)]]
        for k in range(3, len(code)):
            for order in range(4):
                at = contexts.setdefault((order, tuple(code[k - order:k])), {}).setdefault(lang, {})
                at[code[k]] = at.get(code[k], 0) + 1

    def length(text, lang):
        code, bits = [0, 0, 0, *model.code[np.frombuffer(text.encode(), np.uint8)]], 0.0
        for k in range(3, len(code)):
            mass, out, p = 1.0, set(), None
            for order in (3, 2, 1, 0):
                seen = {s: n for s, n in contexts.get((order, tuple(code[k - order:k])), {}).get(lang, {}).items() if s not in out}
                if seen:
                    n, d = sum(seen.values()), len(seen)
                    if code[k] in seen:
                        p = mass * seen[code[k]] / (n + d)
                        break
                    mass, out = mass * d / (n + d), out | set(seen)
            bits -= np.log2(p if p is not None else mass / (model.size - 1 - len(out)))
        return bits

    from glassledger.llm.words import Texts
    for _, text in texts:
        raw = (text or "").encode()
        got = model.lengths(Texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))[0]
        assert np.allclose(got, [length(text or "", x) for x in model.langs], rtol=1e-4)
    found = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict_language(docs, model).collect()}
    assert found[4] == found[5] == found[6] == ("und", 0.0)


def test_rules_count_like_brute_force(spark):
    texts = corpus() + [(100, "a a a a a a a a a\nb #*$\n \nb #*$\nb #*$\n" * 3), (101, "[x]\r\n|<>&%\n\n")]
    docs, labels = table(spark, texts), spark.createDataFrame([(5, 1, 0), (6, 1, 0)], LABELS)
    for r in quality_rules.quality_rules(docs, labels).collect():
        text = dict(texts)[r.doc_id] or ""
        words = WORD.findall(text)
        windows = [tuple(words[k:k + 8]) for k in range(len(words) - 7)]
        again = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(words) < 20 or 100 * len(again) > 30 * len(words)
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(lines) - len(set(lines)), len(again), failed), r.doc_id
        assert r.kept == (not failed and r.log_ratio >= quality_rules.MIN_RATIO)


def test_all_trusted_documents_count(spark):
    """However many there are."""
    n = 20_500
    docs = spark.range(n).selectExpr("id AS doc_id", "'w' AS text").unionByName(spark.createDataFrame([(None, "w v"), (0, "w")], "doc_id long, text string"))
    labels = spark.range(n).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    labels = labels.unionByName(spark.createDataFrame([(None, 1, 0), (3, 1, 0)], LABELS))
    trusted = quality_rules.trusted_ids(labels)
    assert trusted.count() == n
    got = sorted((r.raw, r.trusted) for r in quality_rules.cell_counts(docs, trusted).collect())
    assert got == [(1, 0), (1, 0), (n + 2, n + 1)]  # the pair, "v", "w"


def test_machine_takes_all_pairs():
    m = quality_classifier.Machine()
    m.linear = np.random.default_rng(1).normal(size=len(m.linear))
    index, value = np.array([3, 9, 40, 7]), np.array([0.5, -1.0, 2.0, 0.25])
    want = m.bias + m.linear[index] @ value + sum(m.factors[i] @ m.factors[j] * x * y for (i, x), (j, y) in itertools.combinations(zip(index, value), 2))
    assert np.isclose(m.margins(index, np.zeros(4, int), value, 1)[0][0], want)


def test_chain_marginals():
    draw = np.random.default_rng(4)
    count = np.array([5, 1, 0, 300, 7])
    first, last = toxicity._edges(count)
    u, t = draw.normal(size=count.sum()), draw.normal(size=(2, 2))
    p, at = toxicity.chain(u, t, first, last)[2], 0
    for n in count[[0, 1, 4]]:
        at = {5: 0, 1: 5, 7: 306}[int(n)]
        scores = {y: np.exp(sum(u[at + i] * y[i] for i in range(n)) + sum(t[y[i], y[i + 1]] for i in range(n - 1))) for y in itertools.product((0, 1), repeat=int(n))}
        whole = sum(scores.values())
        assert np.allclose(p[at:at + n], [sum(s for y, s in scores.items() if y[i]) / whole for i in range(n)])


def test_models_on_odd_tables(spark):
    odd, empty = corpus() + [(None, "null id"), (5, "again"), (5, "again")], spark.createDataFrame([], SCHEMA)
    docs, labels, none = table(spark, odd), spark.createDataFrame([(5, 0, 1), (6, 1, 0), (7, None, None), (7, 1, 0), (8, 0, 1)], LABELS), spark.createDataFrame([], LABELS)
    for f in (quality_classifier.quality_scores, toxicity.toxicity_scores, quality_rules.quality_rules, mixing.mixed):
        assert f(docs, labels).count() == f(docs, none).count() == len(odd)
        assert f(empty, labels).count() == 0
    for f in (language_id.predict_language, near_dedup.near_duplicates, substring_dedup.dedup_substrings, line_dedup.dedup_lines):
        assert f(docs).count() == len(odd)
        assert f(empty).count() == 0
    assert chat_format.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert decontamination.decontaminate(empty, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_rates_meet_the_targets(spark):
    draw = random.Random(6)
    kinds = {0: "bad junk spam noise", 1: "awful idiot scum vile", 2: "calm clear sound prose", 3: "clever rude harsh words"}
    texts = [(i, " ".join(draw.choice(kinds[i % 4].split()) for _ in range(60))) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 > 1), i % 2) for i in range(0, 200)], LABELS)
    rows = mixing.mixed(table(spark, texts), labels, {"good": 0.5, "good_toxic": 0.25, "poor": 0.25, "poor_toxic": 0.0}).toPandas()
    totals = (rows["rate"] * rows["n_tokens"]).groupby(rows["domain"]).sum()
    assert np.isclose(totals["good_toxic"] / totals["good"], 0.5, atol=0.02) and totals["poor_toxic"] < 0.02 * totals["good"]


def test_pipeline_follows_the_documents(spark):
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids, columns = {r.doc_id for r in docs.collect()}, docs.columns
    for name, stage in pipeline.STAGES:
        docs = pipeline.keep(stage(spark, docs, sf), "test")
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids and docs.columns[:len(columns)] == columns and len(docs.columns) == len(columns) + 3 * (name == "mix")
        ids = now
    assert 0 < len(ids)
