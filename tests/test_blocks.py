"""Neighbourhoods searched by blocks: against plain NumPy, and without an exchange of pairs."""

import numpy as np
from pyspark.sql import functions as F

from orbweave.operators import descriptors, neighbors, surface


def cloud(spark, xyz, cloud_id="a"):
    return spark.createDataFrame([(cloud_id, k, *map(float, p)) for k, p in enumerate(xyz)], "cloud_id string, pid long, x double, y double, z double")


def plain(xyz, radius, knn):
    d2 = ((xyz[:, None] - xyz[None]) ** 2).sum(axis=2)
    return {(k, int(j), r + 1) for k in range(len(xyz)) for r, j in enumerate(np.lexsort((np.arange(len(xyz)), d2[k]))[:knn]) if d2[k, j] < radius * radius}


def test_crowded_and_sparse_places_of_several_clouds(spark):
    rng = np.random.default_rng(3)
    # a tight crowd, copies of one place, a sparse rest, coordinates below zero
    xyz = np.r_[rng.normal(0, 0.01, (900, 3)), np.zeros((20, 3)), rng.uniform(-1, 1, (150, 3))]
    other = rng.uniform(-5, 5, (30, 3))
    assert neighbors.crowding(cloud(spark, xyz), 0.6) > 3 * 4 * 6
    points = cloud(spark, xyz).union(cloud(spark, other, "b"))
    rows = neighbors.neighborhoods(points, 0.6, 6, carry=("x",), own=("y",)).collect()
    assert {(r["pid"], r["nbr"], r["rk"]) for r in rows if r["cloud_id"] == "a"} == plain(xyz, 0.6, 6)
    assert {(r["pid"], r["nbr"], r["rk"]) for r in rows if r["cloud_id"] == "b"} == plain(other, 0.6, 6)
    table = {"a": xyz, "b": other}
    assert all(r["x"] == table[r["cloud_id"]][r["nbr"], 0] and r["own_y"] == table[r["cloud_id"]][r["pid"], 1] for r in rows)


def test_unsound_points_take_no_part(spark):
    points = spark.createDataFrame([("a", 0, 0.0, 0.0, 0.0), ("a", 1, float("nan"), 0.0, 0.0), ("a", 2, None, 0.0, 0.0), ("a", 3, float("inf"), 0.0, 0.0), (None, 4, 0.0, 0.0, 0.0)], "cloud_id string, pid long, x double, y double, z double")
    assert [(r["pid"], r["nbr"]) for r in neighbors.neighborhoods(points, 1.0, 5).collect()] == [(0, 0)]
    assert neighbors.neighborhoods(points.limit(0), 1.0, 5).collect() == []


def test_normals_and_histograms_exchange_no_pairs(spark):
    points = cloud(spark, np.random.default_rng(4).uniform(0, 1, (80, 3)))
    near = neighbors.neighborhoods(points, 0.4, 8, carry=("x", "y", "z"))
    normals = surface.point_normals(points, near)
    ends = ("x", "y", "z", "nx", "ny", "nz")
    full = neighbors.neighborhoods(points.join(normals, ["cloud_id", "pid"]), 0.4, 8, carry=ends, own=ends)
    for frame in (normals, descriptors.spfh(full, points, normals), surface.stable_points(full, normals, 0.2)):
        assert "hashpartitioning(cloud_id, nbr" not in frame._jdf.queryExecution().toString().replace("#", " ").replace("nbr ", "nbr")
    bare = near.select("cloud_id", "pid", "nbr", "rk", "d2")
    value = lambda df: {(r["pid"], r["bin"]): r["v"] for r in df.collect()}
    one, two = value(descriptors.spfh(full, points, normals)), value(descriptors.spfh(bare, points, normals))
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-12 for k in one)


def test_fpfh_by_blocks_equals_the_joined_one(spark):
    rng = np.random.default_rng(5)
    # two copies of one place, and a point that is alone
    points = cloud(spark, np.r_[rng.uniform(0, 1, (60, 3)), np.full((2, 3), 0.5), [[9.0, 9.0, 9.0]]])
    near = neighbors.neighborhoods(points, 0.4, 8).cache()
    normals = surface.point_normals(points, near).cache()
    value = lambda df: {(r["pid"], r["bin"]): r["v"] for r in df.collect()}
    want = value(descriptors.fpfh(near, points, normals))
    got = value(descriptors.fpfh_by_blocks(points, descriptors.simple_vectors(near, points, normals), 0.4, 8))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_logs_of_orders_are_made_in_one_exchange(spark, sf_dir):
    from orbweave import queries

    plan = queries.ground_truth_parse(spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ObjectHashAggregate") + plan.count("SortAggregate") == 2  # partial and final, of one grouping


def test_covariances_and_normals_made_in_blocks(spark):
    rng = np.random.default_rng(6)
    # a wall of exactly one x, a pair, a point that is alone, and one that takes no part
    points = cloud(spark, np.r_[rng.uniform(0, 1, (70, 3)), np.c_[np.full(40, 3.3), rng.uniform(0, 1, (40, 2))], [[7, 7, 7], [7.1, 7, 7], [9, 9, 9], [np.nan, 1, 1]]])
    near = neighbors.neighborhoods(points, 0.4, 8, carry=("x", "y", "z")).cache()
    value = lambda df: {r["pid"]: tuple(r[c] for c in df.columns if c not in ("cloud_id", "pid")) for r in df.collect()}
    want = value(surface.covariance(near, "cloud_id", "pid"))
    made = surface.covariance_by_blocks(points, 0.4, 8)
    got = value(made.drop("x", "y", "z"))
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=0, atol=1e-12) for k in got)
    assert all(got[k][4] == 0 for k in range(70, 110))
    want = value(surface.point_normals(points, near))
    normals = surface.normals_by_blocks(points, 0.4, 8)
    got = value(normals.drop("x", "y", "z"))
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=0, atol=1e-9) for k in got)
    # points go to their blocks and nothing is exchanged after that
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_points_do_not_meet_under_the_key_of_their_cloud(spark):
    full = surface.normals_by_blocks(cloud(spark, np.random.default_rng(7).uniform(0, 1, (50, 3))), 0.4, 8)
    planes = full.groupBy("cloud_id").agg(*((F.avg(c)).alias(f"c{c}") for c in "xyz"), *(F.avg(f"n{c}").alias(f"n{c}") for c in "xyz")).withColumn("plane_id", F.lit(0))
    plan = descriptors.pch(planes, full, full, 1.0, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_sums_inside_a_radius_need_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    # a crowded wall, a crowd at one place, a lattice with neighbours at exactly the radius, and negative sides
    lattice = np.stack(np.meshgrid(*[np.arange(4) * 0.5] * 3), axis=-1).reshape(-1, 3) + 5
    xyz = np.r_[np.c_[rng.uniform(-1, 1, (4000, 2)), rng.normal(0, 0.001, 4000)], np.full((50, 3), 0.25), lattice, rng.uniform(-3, 3, (200, 3))]
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 512)
    d2 = sum((xyz[:, None, k] - xyz[None, :, k]) ** 2 for k in range(3))
    want = {k: ((d2[k] < 0.25).sum(), d2[k][d2[k] < 0.25].sum()) for k in range(len(xyz))}
    points = cloud(spark, xyz).union(cloud(spark, xyz[:300], "b"))
    frame = neighbors.radius_sums(points, 0.5)
    assert frame._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    rows = frame.collect()
    got = {r["pid"]: (r["n"], r["sum_d2"]) for r in rows if r["cloud_id"] == "a"}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in got)
    assert sum(r["cloud_id"] == "b" for r in rows) == 300


def test_sums_do_not_depend_on_the_size_of_the_table(spark):
    """To the last bit, beside a crowd elsewhere and a cloud of its own, and in whatever order the rows come."""
    rng = np.random.default_rng(10)
    points = cloud(spark, rng.uniform(0, 3, (1500, 3)))
    crowd = cloud(spark, rng.normal(0, 0.05, (20_000, 3)), "b")
    sums = lambda df: {r["pid"]: (r["n"], r["sum_d2"]) for r in neighbors.radius_sums(df, 0.5).where("cloud_id = 'a'").collect()}
    alone = sums(points)
    assert len(alone) == 1500 and sums(points.union(crowd)) == alone and sums(points.orderBy(F.rand(1))) == alone


def test_most_of_a_crowd_is_summed_by_cells(monkeypatch):
    xyz = np.c_[np.random.default_rng(9).uniform(0, 1, (60_000, 2)), np.zeros(60_000)]
    compared = []
    einsum = np.einsum
    monkeypatch.setattr(neighbors.np, "einsum", lambda text, a, b: compared.append(a.size) or einsum(text, a, b))
    ask = np.arange(0, 60_000, 20)
    n, _ = neighbors.sums_inside(xyz, ask, 0.3)
    assert sum(compared) < n.sum() / 2


def test_simple_histograms_counted_in_blocks(spark):
    rng = np.random.default_rng(11)
    # a lattice whose angles lie on the bounds of bins, copies of one place, a point that is alone
    lattice = np.stack(np.meshgrid(*[np.arange(4) * 0.25] * 3), axis=-1).reshape(-1, 3) + 5
    points = cloud(spark, np.r_[rng.uniform(0, 1, (120, 3)), lattice, np.full((3, 3), 0.5), [[9.0, 9.0, 9.0]]])
    full = surface.normals_by_blocks(points, 0.4, 8).cache()
    ends = ("x", "y", "z", "nx", "ny", "nz")
    near = neighbors.neighborhoods(full, 0.4, 8, carry=ends, own=ends)
    want = {r["pid"]: r["h"] for r in descriptors.simple_vectors(near, full, full).collect()}
    made = descriptors.simple_by_blocks(full, 0.4, 8)
    got = {r["pid"]: r["h"] for r in made.collect()}
    assert got.keys() == want.keys() | {187} and sum(got[187]) == 0
    assert all(np.allclose(np.divide(got[k], max(1, sum(got[k][:11]))), want[k], rtol=0, atol=1e-12) for k in want)
    # a byte a bin, and neither sums of pairs nor points are exchanged again
    assert made.schema["h"].dataType.simpleString() == "array<tinyint>"
    plan = descriptors.fpfh_by_blocks(full, made.localCheckpoint(), 0.4, 8)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    value = lambda df: {(r["pid"], r["bin"]): r["v"] for r in df.collect()}
    one, two = value(descriptors.fpfh_by_blocks(full, made, 0.4, 8)), value(descriptors.fpfh(near.select("cloud_id", "pid", "nbr", "rk", "d2"), full.select("cloud_id", "pid", "x", "y", "z"), full.select("cloud_id", "pid", "nx", "ny", "nz")))
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)


def test_pair_features_made_in_blocks(spark):
    rng = np.random.default_rng(12)
    # copies of one place, and a lattice with neighbours along a normal
    lattice = np.stack(np.meshgrid(*[np.arange(3) * 0.25] * 3), axis=-1).reshape(-1, 3) + 5
    full = surface.normals_by_blocks(cloud(spark, np.r_[rng.uniform(0, 1, (90, 3)), lattice, np.full((3, 3), 0.5), [[9.0, 9.0, 9.0]]]), 0.4, 8).cache()
    ends = ("x", "y", "z", "nx", "ny", "nz")
    near = neighbors.neighborhoods(full, 0.4, 8, carry=ends, own=ends)
    value = lambda df: {(r["pid"], r["nbr"]): (r["f1"], r["f2"], r["f3"]) for r in df.collect()}
    want, made = value(descriptors.pair_features(descriptors.pairs(near, full, full))), descriptors.features_by_blocks(full, 0.4, 8)
    got = value(made)
    same = lambda x, y: (x is None) == (y is None) and (x is None or abs(x - y) < 1e-12)
    assert got.keys() == want.keys() and all(same(x, y) for k in got for x, y in zip(got[k], want[k]))
    assert {(f[1] is None, f[2] is None) for f in got.values()} == {(False, False), (True, False), (True, True)}
    # a pair has six columns when it leaves its block
    assert made.columns == ["cloud_id", "pid", "nbr", "f1", "f2", "f3"]
