"""Operators whose results follow from pairs of texts, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from orbweave.llm import common, decontaminate, simhash, substring
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, h int, fp string, spans int, copies int"


def table(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}" if k % 5 else None, len(t or ""), "x", 1, "y", 2, 3) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], SCHEMA)


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["the", "of", "é", "Ünï"]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage = text(60)
    texts = [None, "", " \t\n ", "one", "one two", "one two three four", "One TWO three four", " ".join(["a"] * 90), " ".join(["a", "b"] * 60)]
    for k in range(n):
        body = text(rng.choice((3, 30, 34, 35, 36, 80, 200)))
        if k % 4 == 0:
            body = f"{text(rng.randrange(40))} {passage}\n{text(rng.randrange(40))}"
        texts.append(body)
        if k % 6 == 0:
            texts.append(body)
        if k % 7 == 0:
            parts = body.split(" ")
            parts[len(parts) // 2] = "changed"
            texts.append("  ".join(parts))
    return texts


@pytest.fixture(scope="module")
def texts():
    return corpus()


def test_fingerprints_and_components(spark, texts):
    got = {r["doc_id"]: r for r in simhash.groups(table(spark, texts)).collect()}
    fps = {k: brute.fingerprint(t) for k, t in enumerate(texts)}
    assert {k: int(r["fingerprint"], 16) for k, r in got.items()} == fps
    assert {k: r["component_id"] for k, r in got.items()} == brute.components(fps)


@pytest.mark.parametrize("layout", simhash.LAYOUTS)
def test_covering_finds_every_link(spark, layout):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(30)]
    for fp in list(fps):
        for bits in (1, 2, 3, 4, 5):
            fps.append(fp ^ sum(1 << b for b in rng.sample(range(64), bits)))
    signed = [f - (1 << 64) if f >> 63 else f for f in dict.fromkeys(fps)]
    rows = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r["node"]: r["root"] for r in common.components(simhash.links(rows, layout=layout)).collect()}
    number = {f: k for k, f in enumerate(sorted(signed))}
    want = brute.components({number[f]: f & (1 << 64) - 1 for f in signed})
    assert {number[f]: number[roots.get(f, f)] for f in signed} == want


def test_anchors_grow_with_the_corpus():
    assert [simhash.layout_for(n).blocks for n in (0, 10**5, 10**8, 10**9, 10**12)] == [3, 3, 7, 8, 8]
    for layout in simhash.LAYOUTS:
        widths = {sum(w for _, w in join) for join in layout.joins()}
        assert min(widths) >= simhash.CODED and max(widths) - simhash.CODED + 36 <= 63 and {b for join in layout.joins() for low, w in join for b in range(low, low + w)} == set(range(64))


@pytest.mark.parametrize("layout", simhash.LAYOUTS)
def test_crowded_anchor_is_dealt_over_salts(spark, monkeypatch, layout):
    monkeypatch.setattr(simhash, "HOT_HOMES", 3)
    rng = random.Random(6)
    base = rng.getrandbits(63)
    fps = sorted({base ^ (rng.getrandbits(4) << 50) for _ in range(60)} | {rng.getrandbits(63) for _ in range(20)})
    rows = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = {r["node"]: r["root"] for r in common.components(simhash.links(rows, layout=layout)).collect()}
    number = {f: k for k, f in enumerate(fps)}
    assert {number[f]: number[roots.get(f, f)] for f in fps} == brute.components({number[f]: f for f in fps})


def test_fingerprints_of_very_long_texts_and_clashing_names(spark):
    rng = random.Random(7)
    long = " ".join(f"w{rng.randrange(500)}" for _ in range(300_000))
    docs = table(spark, [long, long.upper(), long + " x", "short", None]).withColumn("component_id", F.lit("x")).withColumn("fingerprint", F.lit(1))
    got = {r["doc_id"]: r for r in simhash.groups(docs).collect()}
    assert int(got[0]["fingerprint"], 16) == brute.fingerprint(long) == int(got[1]["fingerprint"], 16)
    assert [got[k]["component_id"] for k in range(3)] == [0, 0, 0] and simhash.keep_one(docs).columns == docs.columns


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "u long, v long")
    roots = {r["node"]: r["root"] for r in common.components(edges).collect()}
    assert roots == dict.fromkeys(range(41), 0) | {100: 100, 101: 100}


def tasks_of(spark, job):
    """What ``job`` returns, and the number of tasks that it ran."""
    sc = spark.sparkContext
    sc.setJobGroup(name := f"tasks-{random.random()}", name)
    try:
        out = job()
    finally:
        sc._jsc.clearJobGroup()
    told = sc.statusTracker()
    stages = {s for j in told.getJobIdsForGroup(name) for s in told.getJobInfo(j).stageIds}
    return out, sum(x.numCompletedTasks for x in map(told.getStageInfo, stages) if x)


def test_components_of_random_graphs_in_few_tasks(spark, monkeypatch):
    """Trees, paths, a hub, loops and repeated edges, in chunks of a few edges, joined either way; a round is few tasks."""
    rng = random.Random(8)
    names = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(3000)]
    edges = [(names[0], names[k]) for k in range(1, 800)] + [(names[k], names[k + 1]) for k in range(800, 1300)]
    edges += [(names[rng.randrange(1300, 3000)], names[rng.randrange(1300, 3000)]) for _ in range(1300)]
    edges += [(v, u) for u, v in edges[::7]] + [(u, u) for u, _ in edges[::9]]
    rng.shuffle(edges)
    top = {x: x for x in names}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for u, v in edges:
        a, b = sorted((root(u), root(v)))
        top[b] = a
    want = {x: root(x) for x in {x for u, v in edges if u != v for x in (u, v)}}
    frame = spark.createDataFrame(edges, "u long, v long").repartition(4)
    for few in (common.BROADCAST_ROWS, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", few)
        rows, tasks = tasks_of(spark, lambda: common.components(frame).collect())
        assert len(rows) == len(want) and {r["node"]: r["root"] for r in rows} == want
        if few:
            assert tasks <= 40
    monkeypatch.setattr(common, "EDGES", 5)
    assert {r["node"]: r["root"] for r in common.components(frame).collect()} == want


def test_keep_one(spark, texts):
    docs = table(spark, texts)
    kept = sorted(r["doc_id"] for r in simhash.keep_one(docs).collect())
    roots = brute.components({k: brute.fingerprint(t) for k, t in enumerate(texts)})
    assert kept == sorted(set(roots.values()))
    twice = docs.union(docs)
    assert sorted(r["doc_id"] for r in simhash.keep_one(twice).collect()) == kept
    assert simhash.keep_one(docs).columns == docs.columns


@pytest.mark.parametrize("leaves", [4096, 1, 0])
def test_substring_windows(spark, texts, monkeypatch, leaves):
    """In subtrees, with groups split by longer prefixes, and with both."""
    monkeypatch.setattr(substring, "LEAVES", leaves)
    docs = table(spark, texts).withColumn("h", F.lit(1)).withColumn("words", F.lit("x")).withColumn("n_words", F.lit("x"))
    rows = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.dedup(docs).collect()]
    assert sorted(rows) == [(k, *x) for k, x in enumerate(brute.substring(texts))]


def test_substring_of_near_copies_and_periods(spark, monkeypatch):
    """Many different leaves under one prefix, runs of few words, short windows, a very long text."""
    monkeypatch.setattr(substring, "BUILD_WORDS", 1 << 10)
    rng = random.Random(21)
    base = [f"w{rng.randrange(60)}" for _ in range(120)]
    texts = []
    for _ in range(80):
        body = list(base)
        for _ in range(rng.randrange(6)):
            body[rng.randrange(len(body))] = f"x{rng.randrange(9)}"
        texts.append(" ".join(body[rng.randrange(40) :]))
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(200))) for _ in range(40)]
    texts += [" ".join("abc"[k % 3] for k in range(300)), " ".join(f"u{rng.randrange(10**6)}" for _ in range(100_000)) + " " + " ".join(base)]
    for length, prefix in ((35, 5), (8, 3), (5, 5)):
        rows = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.dedup(table(spark, texts), length=length, prefix=prefix).collect()]
        assert sorted(rows) == [(k, *x) for k, x in enumerate(brute.substring(texts, length))]


def test_subtrees_find_maximal_repeats():
    import numpy as np

    rng = random.Random(4)
    for _ in range(30):
        sequences = [[rng.randrange(3) for _ in range(rng.randrange(1, 30))] for _ in range(rng.randrange(1, 12))]
        group = np.array([rng.randrange(2) for _ in sequences])
        bounds = np.r_[0, np.cumsum([len(x) for x in sequences])]
        tree = substring.Subtrees(np.array([w for x in sequences for w in x], np.uint64), bounds, group, 4)
        want = set()
        for k, x in enumerate(sequences):
            for i in range(len(x) - 3):
                if any((j, m) != (k, i) and group[j] == group[k] and y[m : m + 4] == x[i : i + 4] for j, y in enumerate(sequences) for m in range(len(y) - 3)):
                    want |= {(k, i + d) for d in range(4)}
        a, b = tree.repeats(4)
        assert {(int(tree.owner[s]), p - int(bounds[tree.owner[s]])) for s, e in zip(a.tolist(), b.tolist(), strict=True) for p in range(s, e)} == want


def test_substring_rows_that_repeat(spark, texts):
    some = texts[:20]
    docs = table(spark, some + some[5:15], [*range(20), *range(5, 15)])
    rows = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.dedup(docs).collect())
    assert rows == sorted((k, *x) for k, x in zip([*range(20), *range(5, 15)], brute.substring(some + some[5:15]), strict=True))


def test_substring_text(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    docs = table(spark, [f"one  two {passage}\tthree", f"four {passage}"])
    got = {r["doc_id"]: r["kept_text"] for r in substring.dedup(docs, with_text=True).collect()}
    assert got == {0: "one two three", 1: "four"}


def test_empty_tables(spark):
    docs = table(spark, [])
    items = spark.createDataFrame([], "item_id long, text string")
    assert simhash.groups(docs).count() == 0
    assert simhash.keep_one(docs).count() == 0
    assert substring.dedup(docs).count() == 0
    assert decontaminate.overlaps(docs, items).count() == 0
    assert decontaminate.overlaps(table(spark, ["a b c d e f"]), items).count() == 0
    assert decontaminate.clean(docs, items).count() == 0


def _overlap(doc, item):
    """Best share of equal tokens of a window of the item over all alignments that counts, the longest window first."""
    import re

    a, b = (re.findall(r"[^\W_]+", (x or "").lower()) for x in (doc, item))
    best = 0.0
    for most in (25, 20, 15):
        wide = min(len(b), most)
        for shift in range(-len(b), len(a)) if wide else ():
            same = [0 <= k + shift < len(a) and a[k + shift] == b[k] for k in range(len(b))]
            best = max([best, *(sum(same[s : s + wide]) / wide for s in range(len(b) - wide + 1))])
    return best


@pytest.mark.parametrize("most", [500_000, 0])
def test_decontamination(spark, monkeypatch, most):
    """Items of 1 to 40 tokens, whole and with up to a fifth substituted anywhere: found where brute force finds them."""
    monkeypatch.setattr(decontaminate, "BROADCAST_TOKENS", most)
    rng = random.Random(9)
    items = [" ".join(f"i{j}t{rng.randrange(300)}" for _ in range(n)) for j, n in enumerate((*range(1, 16), 20, 40))] + [None, "", "_ !"]
    texts = [None, "", "x", "i0"]
    for item in items[:-3]:
        tokens = item.split()
        texts += ["before, " + item.upper() + ". after", item]
        for _ in range(8):
            gone = rng.sample(range(len(tokens)), min(len(tokens), len(tokens) // 5 + rng.randrange(2)))
            texts.append("a b c " + "; ".join(f"z{rng.random()}".replace(".", "") if k in gone else t for k, t in enumerate(tokens)) + " d e")
    texts += [" ".join(f"b{rng.randrange(90)}" for _ in range(500))] * 2 + [" ".join(f"b{rng.randrange(90)}" for _ in range(60_000)) + " " + items[16]]
    bench = spark.createDataFrame([*enumerate(items), (99, items[15])], "item_id long, text string").withColumn("doc_id", F.lit(1))
    docs = table(spark, texts).withColumn("item_id", F.lit(5)).withColumn("item", F.lit(5)).withColumn("w", F.lit(5))
    got = {(r["doc_id"], r["item_id"]): r["overlap"] for r in decontaminate.overlaps(docs.union(docs.limit(9)), bench).collect()}
    want = {(k, j): s for k, t in enumerate(texts[:-1]) for j, i in [*enumerate(items), (99, items[15])] if (s := _overlap(t, i)) >= 0.8}
    assert set(got) == set(want) | {(len(texts) - 1, 16)}
    clean = {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()}
    assert clean == set(range(len(texts))) - {k for k, _ in got}
    assert decontaminate.clean(docs, bench).columns == docs.columns


@pytest.mark.parametrize("most", [500_000, 0])
def test_decontamination_of_parts_of_items(spark, monkeypatch, most):
    """A passage from anywhere in a longer item, a fifth substituted, in other text."""
    monkeypatch.setattr(decontaminate, "BROADCAST_TOKENS", most)
    rng = random.Random(10)
    items = [[f"i{j}t{rng.randrange(900)}" for _ in range(n)] for j, n in enumerate((30, 38, 59, 59, 120))]
    texts, want = [], set()
    for k in range(150):
        j, size = rng.randrange(len(items)), rng.choice((15, 20, 25))
        at = rng.choice((0, len(items[j]) - size, rng.randrange(len(items[j]) - size + 1)))
        part = items[j][at : at + size]
        for gone in rng.sample(range(size), size // 5):
            part[gone] = f"z{rng.random()}".replace(".", "")
        texts.append(" ".join([f"b{rng.randrange(900)}" for _ in range(rng.randrange(30))] + part + [f"c{rng.randrange(900)}" for _ in range(rng.randrange(30))]))
        want.add((k, j))
    texts += [" ".join(items[2][20:31]), " ".join(f"b{rng.randrange(900)}" for _ in range(99))]  # 11 tokens; none
    bench = spark.createDataFrame([(j, " ".join(t)) for j, t in enumerate(items)], "item_id long, text string")
    got = decontaminate.overlaps(table(spark, texts), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert all(r["overlap"] >= 0.8 for r in got)
