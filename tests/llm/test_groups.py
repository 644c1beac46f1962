"""Shards by differencing and hard negatives, against plain versions."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.llm import hard_negatives, queries, sharding
from tests.llm import brute

DOCS = "doc_id long, text string, shard string, slot string, digest int, bucket int, chunk int, n int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1, 2, 3, 4) for i, t in rows], DOCS)


def texts(n, seed=1):
    rng = random.Random(seed)
    rows = [(k, "é" * int(rng.lognormvariate(5, 1))) for k in range(n)]
    rows = [(k, t + str(k)) for k, t in rows]
    rows += [(n + k, rows[k][1]) for k in range(0, n, 5)]  # copies
    rows += [(5 * n + k, "hot") for k in range(n // 2)] + [(7 * n, None), (7 * n + 1, ""), (7 * n + 1, ""), (None, "lost"), (None, "lost")]
    return rows


def check(rows, got, shards):
    size = lambda t: len((t or "").encode()) + 16
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == sorted(((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    of = {}
    for i, t in rows:
        of.setdefault((i, size(t), zlib.crc32((t or "").encode())), t or "")
    places, sums = {}, [0] * shards
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None
        places.setdefault(of[(r["doc_id"], r["size"], r["text_crc32"])], set()).add(r["shard"])
        sums[r["shard"]] += r["size"]
    assert all(len(p) == 1 for p in places.values())
    for s in range(shards):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    return sums


@pytest.mark.parametrize("shards", [1, 2, 3, 7])
@pytest.mark.parametrize("n", [0, 1, 2, 5, 60])
def test_differencing_is_the_plain_one(shards, n):
    rng = random.Random(shards * 100 + n)
    sizes = sorted((rng.randrange(1, 10**6) for _ in range(n)), reverse=True)
    got = sharding.difference(np.array(sizes, np.int64), shards)
    parts = sorted(sorted(np.flatnonzero(got == s).tolist()) for s in range(shards))
    assert parts == sorted(sorted(p) for p in brute.differencing(sizes, shards))


def test_tighter_than_largest_first():
    sizes = np.array(sorted((random.Random(3).randrange(1, 1000) for _ in range(200)), reverse=True))
    got = np.bincount(sharding.difference(sizes, 8), sizes, 8)
    greedy = [0] * 8
    for s in sizes.tolist():
        greedy[greedy.index(min(greedy))] += s
    assert np.ptp(got) <= max(greedy) - min(greedy)


def test_prior_is_filled_up():
    sizes = np.array(sorted((random.Random(4).randrange(1, 100) for _ in range(900)), reverse=True))
    prior = np.array([9000, 0, 500, 0])
    got = prior + np.bincount(sharding.difference(sizes, 4, prior), sizes, 4)
    assert np.ptp(got) <= 0.005 * got.mean()


@pytest.mark.parametrize("large, bucket", [(100, 20_000), (2, 20)])
def test_shards(spark, large, bucket):
    """By large groups alone, and by many buckets and chunks of small ones: near equal but for what can't be divided."""
    rows = texts(300)
    got = sharding.shard_rows(table(spark, rows), 5, large=large, bucket=bucket, chunk=40).collect()
    sums = check(rows, got, 5)
    assert max(sums) - min(sums) <= (0.02 if large == 100 else 0.06) * sum(sums) / 5
    again = sharding.shard_rows(table(spark, rows[::-1]).repartition(3), 5, large=large, bucket=bucket, chunk=40).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(again, key=key)


def test_one_giant(spark):
    rows = [(k, "giant " * 400) for k in range(50)] + [(100 + k, f"small {k}") for k in range(400)]
    sums = sorted(check(rows, sharding.shard_rows(table(spark, rows), 4, large=2, bucket=50).collect(), 4))
    assert sums[-1] == 50 * (6 * 400 + 16) and sums[2] - sums[0] <= 80


def test_shards_of_nothing_and_of_one(spark):
    assert sharding.shard_rows(table(spark, []), 3).collect() == []
    assert check([(4, None)], sharding.shard_rows(table(spark, [(4, None)]), 3).collect(), 3).count(16) == 1


def test_written_shards(spark, tmp_path):
    rows = [(i, t) for i, t in texts(40) if i is not None]
    sharding.write_shards(table(spark, rows), f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    want = {(r["doc_id"], r["shard"]) for r in sharding.shard_rows(table(spark, rows), 4).collect()}
    assert {(r["doc_id"], r["shard"]) for r in back.collect()} == want and back.count() == len(rows)


VECTORS = "vec_id long, embedding array<float>, label int, q int, seg int, anchor int, win int, score int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], VECTORS)


def cloud(n, dim, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)) * spread
    v[::3] = v[0]  # a third of all rows is one vector
    return [(k, [float(np.float32(x)) for x in v[k]], int(rng.integers(4))) for k in range(n)]


def test_hard_negatives(spark):
    nan, inf = float("nan"), float("inf")
    rows = cloud(300, 6, 2)
    rows += [(None, [1.0] * 6, 1), (1000, None, 1), (1010, [1.0] * 6, None), (1020, [nan] + [1.0] * 5, 1), (1030, [inf] * 6, 1), (1040, [None] + [1.0] * 5, 1), (1050, [], 2), (1060, [2.0, -1.0], 3)]
    rows += [rows[40], rows[40], (40, [0.5] * 6, 1), (-20, [0.25] * 6, 2)]
    got = hard_negatives.mine(vectors(spark, rows), F.col("vec_id") % 10 == 0).collect()
    assert sorted(map(tuple, got)) == brute.hard_negatives(rows, lambda i: i % 10 == 0)


@pytest.mark.parametrize("same", [True, False])
def test_rounds_prove_results(spark, monkeypatch, same):
    """Many pivots, parts, slices and rounds: as all pairs."""
    for name, value in (("FIRST", 20), ("PART", 7), ("SLICE", 5)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 4)) * 3
    rows = [(k, [float(np.float32(x)) for x in centres[k % 12] + rng.normal(size=4) / 8], int(rng.integers(3))) for k in range(400)]
    ready = hard_negatives.prepared(vectors(spark, rows), F.col("vec_id") % 20 == 0, "vec_id", "embedding", F.col("label"), 256).cache()
    index = hard_negatives.Index(ready)
    assert len(index.annulus) >= 12
    wants = ready.where("is_anchor").select(F.col("id").alias("anchor"), "id", "label", "q", F.expr(f"array({-hard_negatives.FAR}L, -40000L)").alias("lows"), F.expr(f"array({hard_negatives.FAR}L, 30000L)").alias("highs"))
    seen = []
    for r in index.search(wants, 4, same, first=20, growth=3).collect():
        seen.append((r["id"], r["win"], r["score"], r["other"]))
    q = {r["id"]: (np.array(r["q"]), r["label"]) for r in ready.collect()}
    want = []
    for a in (k for k in q if k % 20 == 0):
        scored = sorted((-int(q[a][0] @ v), k) for k, (v, lab) in q.items() if k != a and (lab == q[a][1]) == same)
        for w, (lo, hi) in enumerate(((-1e18, 1e18), (-40000, 30000))):
            want += [(a, w, -s, k) for s, k in [x for x in scored if lo <= -x[0] <= hi][:4]]
    assert sorted(seen) == sorted(want)


def test_bounds_hold_and_prune(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 5)) * 4
    rows = [(k, [float(np.float32(x)) for x in centres[k % 40] + rng.normal(size=5) / 20], 0) for k in range(800)]
    ready = hard_negatives.prepared(vectors(spark, rows), F.lit(False), "vec_id", "embedding", F.col("label"), 256).cache()
    hard_negatives.FIRST, kept = 20, hard_negatives.FIRST
    try:
        index = hard_negatives.Index(ready)
    finally:
        hard_negatives.FIRST = kept
    a = np.array([r["q"] for r in ready.orderBy("id").limit(30).collect()], float)
    top, bottom = index.bounds(a)
    at = {k: i for i, k in enumerate(index.annulus.tolist())}
    best = np.sort(a @ np.array([r["q"] for r in ready.collect()], float).T, axis=1)[:, -5]
    for r in index.rows.collect():
        score = a @ np.array(r["q"], float)
        assert (score <= top[:, at[r["annulus"]]]).all() and (score >= bottom[:, at[r["annulus"]]]).all()
    assert ((top >= best[:, None]) * index.count).sum() < 0.5 * len(a) * 800  # under half of all pairs are compared


def test_large_components_stay_exact(spark):
    rows = [(k, [16000.0 - k, 15000.0 + k / 7, -16383.5], k % 2) for k in range(30)]
    got = hard_negatives.mine(vectors(spark, rows), F.col("vec_id") % 10 == 0).collect()
    assert sorted(map(tuple, got)) == brute.hard_negatives([(i, [float(np.float32(x)) for x in v], c) for i, v, c in rows], lambda i: i % 10 == 0)


def test_no_anchors_and_no_rows(spark):
    assert hard_negatives.mine(vectors(spark, []), F.col("vec_id") % 10 == 0).collect() == []
    assert hard_negatives.mine(vectors(spark, cloud(20, 3, 1)), F.lit(False)).collect() == []
    assert hard_negatives.mine(vectors(spark, [(0, [1.0], 1)]), F.col("vec_id") % 10 == 0).collect() == []


def test_the_query_is_its_sql(spark, sf_dir):
    import duckdb

    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = duckdb.sql(queries.oracle_sql()["op12_hard_negatives"]).fetchall()
    assert sorted(map(tuple, queries.op12_hard_negatives(spark, sf_dir).collect())) == sorted(want)
