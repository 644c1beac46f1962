"""Descriptors against NumPy from their definitions, not from the expressions that the SQL shares with Spark."""

import math

import numpy as np
import pytest

from orbweave.functions import steps
from orbweave.functions.geometry import colour
from orbweave.operators import descriptors, layout, matching, neighbors, surface

N = 60


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(12)
    xyz = rng.uniform(0.5, 1.5, (N, 3))
    xyz[7] = xyz[6]  # two at one place
    points = spark.createDataFrame([("c", k, *map(float, p)) for k, p in enumerate(xyz)], "cloud_id string, pid long, x double, y double, z double").cache()
    n = rng.normal(size=(N, 3))
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    normals = spark.createDataFrame([("c", k, *map(float, p)) for k, p in enumerate(n)], "cloud_id string, pid long, nx double, ny double, nz double").cache()
    return xyz, n, points, normals, neighbors.neighborhoods(points, 0.45, 9).cache()


def features(p1, n1, p2, n2):
    u = p2 - p1
    across = np.cross(u, n1)
    length, far = np.linalg.norm(across), np.linalg.norm(u)
    if not far:
        return None
    return math.atan2(u @ n2 - (n1 @ u) * (n1 @ n2), (n1 @ n2) * length), across @ n2 / length, n1 @ u / far


def bins(f):
    if f is None:
        return 5, 0, 0  # no angle, and two features without a value
    scaled = (f[0] + math.pi) / (2 * math.pi), (f[1] + 1) / 2, (f[2] + 1) / 2
    return tuple(min(10, max(0, int(11 * s))) for s in scaled)


def near_of(near):
    out = {k: [] for k in range(N)}
    for r in near.orderBy("pid", "rk").collect():
        out[r["pid"]].append((r["nbr"], r["d2"]))
    return out


def simple(xyz, n, near):
    h = np.zeros((N, 33))
    for k, rows in near.items():
        others = [j for j, _ in rows if j != k]
        for j in others:
            for block, b in enumerate(bins(features(xyz[k], n[k], xyz[j], n[j]))):
                h[k, 11 * block + b] += 1 / len(others)
    return h


def test_pair_features(cloud):
    xyz, n, points, normals, near = cloud
    rows = descriptors.pair_features(descriptors.pairs(near, points, normals)).collect()
    assert len(rows) > 200
    for r in rows:
        want = features(xyz[r["pid"]], n[r["pid"]], xyz[r["nbr"]], n[r["nbr"]])
        if want is None:
            assert r["f2"] is None and r["f3"] is None
        else:
            assert np.allclose([r["f1"], r["f2"], r["f3"]], want, atol=1e-9)


def test_simple_and_weighted_histograms(cloud):
    xyz, n, points, normals, near = cloud
    rows, h = near_of(near), None
    h = simple(xyz, n, rows)
    got = np.zeros((N, 33))
    for r in descriptors.spfh(near, points, normals).collect():
        got[r["pid"], r["bin"]] = r["v"]
    assert np.allclose(got, h)
    want = h.copy()
    for k, around in rows.items():
        w = sum((h[j] / d2 for j, d2 in around if j != k and d2 > 0), np.zeros(33)).reshape(3, 11)
        total = w.sum(1, keepdims=True)
        want[k] += np.divide(w, total, out=np.zeros_like(w), where=total > 0).ravel()
    got[:] = 0
    for r in descriptors.fpfh(near, points, normals).collect():
        got[r["pid"], r["bin"]] = r["v"]
    assert np.allclose(got, want)
    assert {round(x, 6) for x in want.reshape(-1, 11).sum(1)} <= {0.0, 1.0, 2.0}


def test_plane_centred_histograms(spark, cloud):
    xyz, n, points, normals, _ = cloud
    planes = [(0, np.array([1.0, 1, 1]), np.array([0.0, 0, 1])), (1, np.array([0.9, 1.2, 1]), np.array([0.6, 0.8, 0])), (2, np.array([9.0, 9, 9]), np.array([1.0, 0, 0]))]
    table = spark.createDataFrame([("c", k, *map(float, c), *map(float, m)) for k, c, m in planes], "cloud_id string, plane_id long, cx double, cy double, cz double, nx double, ny double, nz double")
    reach, radius = 0.3, 0.4
    want = {}
    for k, c, m in planes:
        for kind in ("full", "restricted"):
            counts = np.zeros((16, 12))
            for p, v in zip(xyz, n):
                d = (p - c) @ m
                if abs(d) <= reach and (kind == "full" or ((p - c - d * m) ** 2).sum() <= radius**2):
                    counts[min(15, max(0, int((d + reach) * 16 / (2 * reach)))), min(11, max(0, int((v @ m + 1) * 12 / 2)))] += 1
            want |= {(k, kind, i, j): counts[i, j] / counts.sum() for i, j in zip(*np.nonzero(counts))}
    got = {(r["plane_id"], r["kind"], r["d_bin"], r["a_bin"]): r["mass"] for r in descriptors.pch(table, points, normals, reach, radius).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    assert not any(k[0] == 2 for k in got) and any(k[1] == "restricted" for k in got)


def test_planes_without_histograms_match_nothing(spark):
    hist = spark.createDataFrame([(0, 1, "full", 3, 1.0), (0, 1, "restricted", 3, 1.0), (1, 1, "full", 3, 1.0)], "pair_id int, id long, kind string, bin int, mass double")
    groups = hist.select("pair_id", "id").distinct().selectExpr("pair_id", "id", "id AS group_id")
    only = lambda df: df.where("pair_id = 0")
    assert [(r["pair_id"], r["s"], r["t"]) for r in matching.match_planes(hist, only(hist), groups, only(groups)).collect()] == [(0, 1, 1)]
    assert matching.match_planes(hist.limit(0), hist, groups.limit(0), groups).collect() == []


def test_colours_differ_and_stay_in_range(spark):
    rows = layout.palette(spark.range(40).withColumnRenamed("id", "plane_id")).collect()
    rgb = np.array([[r["red"], r["green"], r["blue"]] for r in rows])
    hue = (np.arange(40) * (math.sqrt(5) - 1) / 2)[:, None]
    assert np.allclose(rgb, 0.55 + 0.4 * np.cos(2 * math.pi * (hue + np.arange(3) / 3)), atol=1e-6) and "cos" in colour("plane_id", 0)
    assert ((rgb >= 0) & (rgb <= 1)).all() and len({tuple(x.round(3)) for x in rgb}) == 40


def test_normals_and_planes(spark, cloud):
    xyz, _, points, _, near = cloud
    rows = near_of(near)
    for r in surface.point_normals(points, near).collect():
        members = xyz[[j for j, _ in rows[r["pid"]]]]
        got = np.array([r["nx"], r["ny"], r["nz"]])
        assert got @ xyz[r["pid"]] <= 1e-12
        if len(members) >= 4:
            values, axes = np.linalg.eigh(np.cov(members.T, bias=True))
            if values[1] - values[0] > 1e-3 * values[2]:
                assert abs(got @ axes[:, 0]) > 1 - 1e-8
    assert steps.settled(points, "cloud_id", "pid").count() == N
