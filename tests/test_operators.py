"""Small cases worked out by hand, and properties."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orbweave.functions import steps
from orbweave.functions.geometry import SYMMETRIC_EIGEN, morton
from orbweave.operators import consistency, descriptors, ground, layout, matching, neighbors, pose, segmentation, surface
from orbweave.plans import registration
from orbweave.sources import ply, text
from orbweave.streaming import sliding_map

POINTS = "cloud_id string, pid long, x double, y double, z double"


def cloud(spark, xyz, name="c"):
    return spark.createDataFrame([(name, k, *map(float, p)) for k, p in enumerate(xyz)], POINTS)


def test_radius_is_strict_and_narrowing_inclusive(spark):
    points = cloud(spark, [(0, 0, 0), (1, 0, 0), (0.5, 0, 0)])
    wide = neighbors.neighborhoods(points, 1.0, 10)
    assert {(r["pid"], r["nbr"]) for r in wide.collect()} == {(0, 0), (0, 2), (1, 1), (1, 2), (2, 2), (2, 0), (2, 1)}
    assert neighbors.narrow(wide, 0.5, 10).count() == 7 and neighbors.narrow(wide, 0.49, 10).count() == 3


def test_ties_go_to_the_lowest_id(spark):
    points = cloud(spark, [(0, 0, 0), (1, 0, 0), (-1, 0, 0)])
    near = {r["rk"]: r["nbr"] for r in neighbors.neighborhoods(points, 2.0, 2).where("pid = 0").collect()}
    assert near == {1: 0, 2: 1}
    a = spark.createDataFrame([(0, 5, [0.0, 0.0])], "pair_id long, id long, v array<double>")
    b = spark.createDataFrame([(0, 8, [1.0, 0.0]), (0, 7, [0.0, 1.0])], "pair_id long, id long, v array<double>")
    assert neighbors.nearest(a, b)[0].first()["t"] == 7


def test_nan_descriptors_match_nothing(spark):
    a = spark.createDataFrame([(0, 1, [float("nan"), 0.0]), (0, 2, [1.0, 1.0])], "pair_id long, id long, v array<double>")
    b = spark.createDataFrame([(0, 1, [0.0, 0.0]), (0, 2, None)], "pair_id long, id long, v array<double>")
    assert [(r["s"], r["t"]) for r in matching.mutual_nearest(a, b).collect()] == [(2, 1)]
    assert matching.mutual_nearest(a.where("false"), b).count() == 0


def test_mutual_nearest_over_blocks(spark):
    rng = np.random.default_rng(0)
    rows = lambda n: spark.createDataFrame([(p, k, rng.normal(size=5).tolist()) for p in (0, 1) for k in range(n)], "pair_id long, id long, v array<double>")
    a, b = rows(40).cache(), rows(30).cache()
    va, vb = ({(r["pair_id"], r["id"]): np.array(r["v"]) for r in df.collect()} for df in (a, b))
    want = set()
    for p in (0, 1):
        d = np.array([[((va[p, i] - vb[p, j]) ** 2).sum() for j in range(30)] for i in range(40)])
        want |= {(p, i, int(d[i].argmin())) for i in range(40) if d[:, d[i].argmin()].argmin() == i}
    for block in (7, 2048):
        forward, backward = neighbors.nearest(a, b, block=block)
        assert {(r["pair_id"], r["s"], r["t"]) for r in forward.join(backward.drop("d2"), ["pair_id", "s", "t"]).collect()} == want


def test_morton_codes(spark):
    rows = spark.createDataFrame([(5, 0, 0), (0, 1, 0), (0, 0, 1), (2097151, 2097151, 2097151)], "i long, j long, k long")
    assert [r[0] for r in rows.select(F.expr(morton("i", "j", "k"))).collect()] == [65, 2, 4, (1 << 63) - 1]


def test_population_covariance_and_normals(spark):
    points = cloud(spark, [(1, 0, 5), (-1, 0, 5)])
    row = surface.covariance(points, "cloud_id").first()
    assert row["c11"] == 1.0 and row["n"] == 2
    near = neighbors.neighborhoods(points, 10.0, 5)
    # fewer than three neighbours: +Z, turned toward the origin
    assert {(r["nx"], r["ny"], r["nz"]) for r in surface.point_normals(points, near).collect()} == {(0.0, 0.0, -1.0)}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-3, 3), min_size=6, max_size=6))
def test_closed_form_eigen(spark, c):
    m = np.array([[c[0], c[1], c[2]], [c[1], c[3], c[4]], [c[2], c[4], c[5]]])
    m = m @ m.T
    row = steps.apply(spark.createDataFrame([tuple(float(m[i, j]) for i in range(3) for j in range(i, 3))], "c11 double, c12 double, c13 double, c22 double, c23 double, c33 double"), SYMMETRIC_EIGEN).first()
    values, vectors = np.linalg.eigh(m)
    assert np.allclose([row["l3"], row["l2"], row["l1"]], values, atol=1e-7 * max(1, values[2]))
    if values[1] - values[0] > 1e-3 * values[2] > 1e-9:
        assert abs(abs(np.dot([row["ex"], row["ey"], row["ez"]], vectors[:, 0])) - 1) < 1e-6


def test_merged_moments_equal_direct_ones(spark):
    rng = np.random.default_rng(1)
    xyz = rng.normal(size=(50, 3))
    rows = cloud(spark, xyz).withColumns({"nx": F.lit(0.6), "ny": F.lit(0.0), "nz": F.lit(0.8), "part": F.col("pid") % 3})
    model = surface.state_models(surface.merge_states(surface.plane_states(rows, "cloud_id", "part"), "cloud_id")).first()
    want = np.cov(xyz.T, bias=True)
    assert np.allclose([model["cxx"], model["cxy"], model["czz"]], [want[0, 0], want[0, 1], want[2, 2]]) and model["oxz"] == pytest.approx(0.48)


def test_descriptor_blocks_sum_to_two_and_duplicates_are_harmless(spark):
    rng = np.random.default_rng(2)
    xyz = rng.normal(size=(30, 3)).tolist()
    points = cloud(spark, xyz + xyz[:1])
    near = neighbors.neighborhoods(points, 3.0, 20)
    full = descriptors.fpfh(near, points, surface.point_normals(points, near)).cache()
    sums = full.groupBy("pid", F.floor(F.col("bin") / 11).alias("b")).agg(F.sum("v").alias("s")).collect()
    assert len(sums) == 93 and all(r["s"] == pytest.approx(2.0, abs=1e-9) for r in sums)
    wanted = spark.createDataFrame([("c", 3), ("c", 9)], "cloud_id string, pid long")
    part = descriptors.fpfh(near, points, surface.point_normals(points, near), wanted)
    assert {(r["pid"], r["bin"], round(r["v"], 9)) for r in part.collect()} == {(r["pid"], r["bin"], round(r["v"], 9)) for r in full.where("pid IN (3, 9)").collect()}


def test_degenerate_pair_falls_into_bin_zero(spark):
    points = cloud(spark, [(0, 0, 0), (0, 0, 1)])
    normals = spark.createDataFrame([("c", 0, 0.0, 0.0, 1.0), ("c", 1, 0.0, 0.0, 1.0)], "cloud_id string, pid long, nx double, ny double, nz double")
    near = neighbors.neighborhoods(points, 2.0, 5)
    bins = {r["bin"] for r in descriptors.spfh(near, points, normals).where("pid = 0").collect()}
    assert 11 in bins  # the second feature has no value


def test_plane_without_points_in_range(spark):
    points = cloud(spark, [(0, 0, 100)])
    normals = points.select("cloud_id", "pid", F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"))
    planes = spark.createDataFrame([("c", 0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)], "cloud_id string, plane_id long, cx double, cy double, cz double, nx double, ny double, nz double")
    assert descriptors.pch(planes, points, normals, 1.0, 1.0).count() == 0


def test_groups_are_no_closure(spark):
    rows = [("c", 0, 0.0), ("c", 1, 0.8), ("c", 2, 1.6)]
    planes = spark.createDataFrame([(c, k, 0.0, 0.0, z, 0.0, 0.0, 1.0) for c, k, z in rows], "cloud_id string, plane_id long, cx double, cy double, cz double, nx double, ny double, nz double")
    assert {r["plane_id"]: r["group_id"] for r in matching.plane_groups(planes, 1.0, 0.9).collect()} == {0: 0, 1: 0, 2: 1}


def test_confidence_of_a_single_cell(spark):
    got = matching.mutual_confidence(spark.createDataFrame([(0, 0, 0, 0.5)], "pair_id long, s long, t long, d double")).first()
    assert got["confidence"] == pytest.approx(0.75)


def test_hierarchical_plane_match(spark):
    hist = lambda shift: spark.createDataFrame([(0, p, kind, (p * 5 + b + shift * (kind == "full")) % 40, 0.5) for p in range(3) for kind in ("full", "restricted") for b in range(2)], "pair_id long, id long, kind string, bin int, mass double")
    groups = spark.createDataFrame([(0, 0, 0), (0, 1, 0), (0, 2, 2)], "pair_id long, id long, group_id long")
    got = {(r["s"], r["t"]): r["confidence"] for r in matching.match_planes(hist(0), hist(0), groups, groups).collect()}
    assert set(got) == {(0, 0), (1, 1), (2, 2)} and all(0 <= c <= 1 for c in got.values())


def test_weights_of_planes(spark):
    rows = spark.createDataFrame([(0.0,), (0.05,), (0.1,), (1.0,), (1.5,)], "c double")
    assert [r[0] for r in rows.select(consistency.plane_weight(F.col("c"))).collect()] == [1, 1, 2, 11, 11]


def test_cliques():
    assert consistency.heavy_clique([5], []) == ([], True)
    assert consistency.heavy_clique([1, 1, 1, 9], [(0, 1), (1, 2), (0, 2), (2, 3)]) == ([2, 3], True)
    rng = np.random.default_rng(3)
    for _ in range(20):
        n = 10
        weights = rng.integers(1, 12, n).tolist()
        edges = [(i, j) for i in range(n) for j in range(i) if rng.random() < 0.5]
        near = {frozenset(e) for e in edges}
        best = max((sum(weights[k] for k in range(n) if m >> k & 1) for m in range(1 << n) if all(frozenset((i, j)) in near for i in range(n) for j in range(i) if m >> i & 1 and m >> j & 1)), default=0)
        clique, proved = consistency.heavy_clique(weights, edges)
        assert proved and sum(weights[k] for k in clique) == best
        greedy, _ = consistency.heavy_clique(weights, edges, budget=0)
        assert all(frozenset((i, j)) in near for i in greedy for j in greedy if i < j)


def test_pose_without_data_and_errors(spark):
    zero = pose.solve({k: 0.0 for k in ["n", *(f"s{s}{a}" for s in "pq" for a in "xyz"), *(f"{m}{a}{b}" for m in "hga" for a in "xyz" for b in "xyz"), *(f"b{a}" for a in "xyz")]})
    assert np.allclose(zero @ zero.T, np.eye(4))
    c, s = math.cos(0.4), math.sin(0.4)
    m = [c, -s, 0.0, 1.0, s, c, 0.0, 2.0, 0.0, 0.0, 1.0, 3.0, 0.0, 0.0, 0.0, 1.0]
    row = spark.createDataFrame([(m,)], "m array<double>").withColumn("truth", pose.inverse(F.col("m")))
    got = pose.errors(row).first()
    assert got["te"] < 1e-12 and got["re"] < 1e-5


def test_summary_of_failures(spark):
    rows = spark.createDataFrame([("d", "s", 1.0, 1.0, 5.0, None, None)], "dataset string, sequence string, te double, re double, runtime_ms double, t_crit double, r_crit double")
    got = pose.summary(pose.succeeded(rows)).collect()
    assert [(r["sequence"], r["sr"], r["ate"], r["are"], r["runtime_ms"]) for r in got] == [("s", 0.0, None, None, 5.0), ("Total", 0.0, None, None, 5.0)]
    assert "nan" in text.summary_lines(pose.summary(pose.succeeded(rows))).first()["value"]


def test_region_merging():
    rng = np.random.default_rng(4)
    flat = np.c_[rng.uniform(0, 1, (40, 2)), rng.normal(0, 0.001, 40)]
    wall = np.c_[rng.uniform(0, 1, 40), np.full(40, 3.0), rng.uniform(0, 1, 40)]
    points = np.r_[flat, wall]
    normals = np.r_[np.tile([0, 0, 1.0], (40, 1)), np.tile([0, 1.0, 0], (40, 1))]
    edges = [[j for j in range(80) if j // 40 == k // 40] for k in range(80)]
    roots = segmentation.merge_regions(np.arange(80), points, normals, edges, 0.05, math.sin(math.radians(10)))
    assert len(set(roots[:40])) == 1 and len(set(roots[40:])) == 1 and roots[0] != roots[40]


def test_common_direction_by_search():
    """Against a dense search over directions."""
    rng = np.random.default_rng(7)
    a, b = (np.array([(m + m.T) / 2 + rng.normal() * np.eye(3) for m in rng.normal(size=(300, 3, 3))]) for _ in range(2))
    u = rng.normal(size=(60_000, 3))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    worst = np.array([np.maximum(np.einsum("ni,ij,nj->n", u, x, u), np.einsum("ni,ij,nj->n", u, y, u)).min() for x, y in zip(a, b, strict=True)])
    got = segmentation.common_direction(a, b)
    sure = np.abs(worst) > 0.01
    assert (got == (worst <= 0))[sure].all() and sure.sum() > 250
    zero, eye = np.zeros((1, 3, 3)), np.eye(3)[None]
    assert segmentation.common_direction(zero, zero).all() and not segmentation.common_direction(eye, -eye).any() and segmentation.common_direction(-eye, zero).all()


def test_region_merging_in_order():
    """Against merging edge by edge, judged by a dense search of directions."""
    rng = np.random.default_rng(9)
    points = np.r_[np.c_[rng.random((25, 2)), rng.normal(0, 0.004, 25)], np.c_[rng.normal(0, 0.004, 25), rng.random((25, 2))], rng.random((10, 3))]
    normals = np.r_[np.tile([0, 0, 1.0], (25, 1)), np.tile([1.0, 0, 0], (25, 1)), rng.normal(size=(10, 3))] + rng.normal(0, 0.03, (60, 3))
    normals /= np.linalg.norm(normals, axis=1, keepdims=True)
    apart = np.linalg.norm(points[:, None] - points[None], axis=2)
    edges = np.argsort(apart, axis=1)[:, 1:9].tolist()
    thick, sine = 0.03, math.sin(math.radians(10))
    u = rng.normal(size=(40_000, 3))
    u /= np.linalg.norm(u, axis=1, keepdims=True)

    def plane(members):
        x, n = points[members] - points[members].mean(axis=0), normals[members]
        return np.maximum(1 - sine**2 - ((u @ n.T) ** 2).mean(axis=1), ((u @ x.T) ** 2).mean(axis=1) - thick**2).min() <= 1e-5

    label = list(range(60))
    table = [(a, b) for a in range(60) for b in edges[a]]
    while True:
        merged, refused = 0, set()
        for a, b in table:
            a, b = label[a], label[b]
            if a == b:
                continue
            members = [k for k in range(60) if label[k] in (a, b)]
            if plane(members):
                merged += 1
                for k in members:
                    label[k] = a
            else:
                refused.add((a, b))
        if not merged:
            break
        table = sorted(refused)
    got = segmentation.merge_regions(np.arange(60), points, normals, edges, thick, sine)
    first = lambda x: [list(x).index(v) for v in x]
    big = [k for k in range(60) if list(got).count(got[k]) >= 10]
    assert [first(got)[k] for k in big] == [first(label)[k] for k in big] and len({got[k] for k in big}) == 2
    assert len(segmentation.merge_regions(np.arange(0), np.zeros((0, 3)), np.zeros((0, 3)), [], thick, sine)) == 0


def test_pose_is_the_best():
    """No pose near the solution has a smaller sum of squares, far from the origin, with few or no planes or points."""
    rng = np.random.default_rng(11)
    for n, m in ((8, 3), (8, 0), (3, 1), (0, 3), (40, 1)):
        turn, shift = pose._turn(rng.normal(size=3)), rng.normal(size=3) * 3
        p = rng.normal(size=(n, 3)) * 2 + 5
        q = p @ turn.T + shift + rng.normal(size=(n, 3)) * 0.05
        pc, pn, w = rng.normal(size=(m, 3)) * 3, rng.normal(size=(m, 3)), rng.random(m) * 10
        pn /= np.maximum(np.linalg.norm(pn, axis=1, keepdims=True), 1e-9)
        qc, qn = pc @ turn.T + shift, pn @ turn.T + rng.normal(size=(m, 3)) * 0.02
        offset = (qn * qc).sum(axis=1) - (pn * pc).sum(axis=1)
        row = {"n": n} | {f"s{s}{k}": x[:, i].sum() for s, x in (("p", p), ("q", q)) for i, k in enumerate("xyz")} | {f"b{k}": (w * offset * qn[:, i]).sum() for i, k in enumerate("xyz")}
        for i, k in enumerate("xyz"):
            for j, o in enumerate("xyz"):
                row |= {f"h{k}{o}": (q[:, i] * p[:, j]).sum(), f"g{k}{o}": (w * qn[:, i] * pn[:, j]).sum(), f"a{k}{o}": (w * qn[:, i] * qn[:, j]).sum()}

        def loss(r, t):
            return ((p @ r.T + t - q) ** 2).sum() + (w * ((pn @ r.T - qn) ** 2).sum(axis=1)).sum() + (w * (qn @ t - offset) ** 2).sum()

        best = pose.solve(row)
        r, t = best[:3, :3], best[:3, 3]
        assert np.allclose(r @ r.T, np.eye(3)) and np.linalg.det(r) > 0
        for _ in range(200):
            assert loss(pose._turn(rng.normal(size=3) * 0.02) @ r, t + rng.normal(size=3) * 0.02) >= loss(r, t) - 1e-9
    nothing = {"n": 0} | {f"s{s}{k}": 0 for s in "pq" for k in "xyz"} | {f"b{k}": 0 for k in "xyz"} | {f"{m}{k}{o}": 0 for m in "hga" for k in "xyz" for o in "xyz"}
    assert np.allclose(pose.solve(nothing), np.eye(4))


def test_supports_and_ground_plane(spark):
    roots = spark.createDataFrame([("c", k, 9 if k % 2 else 8) for k in range(10)] + [("c", 20, 20)], "cloud_id string, pid long, root long")
    floor = spark.createDataFrame([("c", 100 + k) for k in range(5)], "cloud_id string, pid long")
    got = segmentation.supports(roots, 5, floor).collect()
    assert {(r["plane_id"], r["pid"]) for r in got} == {(k % 2, k) for k in range(10)} | {(2, 100 + k) for k in range(5)}
    assert segmentation.supports(roots, 5, floor.limit(4)).where("plane_id = 2").count() == 0


def test_ground_of_a_step(spark):
    rng = np.random.default_rng(5)
    low = np.c_[rng.uniform(-10, 10, (600, 2)), rng.normal(0, 0.01, 600)]
    high = low[low[:, 0] > 4] + [0, 0, 3.0]
    keep = low[low[:, 0] <= 4]
    points = cloud(spark, np.r_[keep, high])
    found = {r["pid"] for r in ground.segment_ground(points).collect()}
    assert len(found & set(range(len(keep)))) > 0.6 * len(keep)
    assert ground.segment_ground(points.where("false")).count() == 0


@pytest.mark.parametrize("form", ["ascii", "little", "big"])
def test_ply(spark, tmp_path, form):
    xyz = np.array([[1.5, -2.0, 3.25], [0.0, 1e-3, 7.0]])
    if form == "big":
        blob = b"ply\nformat binary_big_endian 1.0\nelement vertex 2\nproperty uchar r\nproperty float x\nproperty float y\nproperty float z\nend_header\n" + b"".join(b"\x01" + np.array(p, ">f4").tobytes() for p in xyz)
    else:
        blob = ply.render(xyz, form == "ascii")
    (tmp_path / "cloud_bin_7.ply").write_bytes(blob)
    rows = ply.scan_indexed(spark, str(tmp_path)).orderBy("pid").collect()
    assert np.allclose([[r["x"], r["y"], r["z"]] for r in rows], xyz, atol=1e-6) and rows[0]["scan"] == 7
    back = ply.files(ply.scan(spark, str(tmp_path))).first()
    assert np.allclose(ply.parse(bytes(back["content"])), xyz, atol=1e-6)
    (tmp_path / "bad.ply").write_bytes(b"ply\n")
    with pytest.raises(Exception, match="PLY"):
        ply.scan(spark, str(tmp_path / "bad.ply")).collect()


@pytest.mark.parametrize("line", ["only", "a b/c --what", "a b/c --success-criteria 1", "a b/c --success-criteria x 1"])
def test_bad_manifests(spark, line):
    with pytest.raises(Exception, match="missing|unsupported|incomplete|number"):
        text.manifest(spark.createDataFrame([(line,)], "value string")).collect()


def test_voxel_size_must_be_positive(spark):
    good = spark.createDataFrame([("s", " 0.05\n")], "sequence string, value string")
    assert text.voxel_sizes(good).first()["voxel_size"] == 0.05
    with pytest.raises(Exception, match="positive"):
        text.voxel_sizes(good.withColumn("value", F.lit("0"))).collect()
    with pytest.raises(ValueError, match="positive"):
        registration.Parameters(0.0)


def test_trajectory_round_trip(spark, tmp_path):
    m = [0.0, -1.0, 0.0, 1.25, 1.0, 0.0, 0.0, -2.5, 0.0, 0.0, 1.0, 1e-5, 0.0, 0.0, 0.0, 1.0]
    rows = spark.createDataFrame([("s", 0, 3, 4, m)], "sequence string, record int, src int, tgt int, m array<double>")
    text.write_trajectories(rows, str(tmp_path / "out"))
    back = text.ground_truth(spark.read.text(str(tmp_path / "out"), wholetext=True).select("sequence", "value")).first()
    assert (back["src"], back["tgt"], back["meta"]) == (3, 4, 0)
    want = np.linalg.inv(np.array(m).reshape(4, 4)).ravel()
    assert np.allclose(back["m"], want)


def test_layout_pieces(spark):
    points = cloud(spark, [(0, 0, 0), (0.2, 0, 0), (1, 1, 1)])
    assert layout.voxel_downsample(points, 0.5).count() == 2
    assert [r["pid"] for r in layout.box_query(points, (0, 0, 0), (0.2, 0, 0)).collect()] == [0, 1]
    ids = spark.createDataFrame([("c", 2, 0), ("c", 0, 1), ("c", 2, 2)], "cloud_id string, pid long, ord int")
    assert [r["pid"] for r in layout.gather(ids, points).collect()] == [2, 0, 2]
    assert layout.morton_layout(points, 0.5, 2).count() == 3
    with pytest.raises(ValueError, match="positive"):
        layout.voxel_downsample(points, 0.0)


class State:
    def __init__(self):
        self.exists, self.get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def test_sliding_map():
    state = State()
    rows = pd.DataFrame([(0, "add", 1, 0.0, 0.0, 0.0), (1, "add", 2, 9.0, 0.0, 0.0), (2, "remove", 7, 0.0, 0.0, 0.0)], columns=["seq", "kind", "pid", "x", "y", "z"])
    (out,) = sliding_map.slide(("c",), iter([rows]), state, 2.0)
    assert list(out["action"]) == ["added", "added"]
    rows = pd.DataFrame([(3, "centre", 0, 8.5, 0.0, 0.0), (4, "remove", 9, 0.0, 0.0, 0.0)], columns=["seq", "kind", "pid", "x", "y", "z"])
    (out,) = sliding_map.slide(("c",), iter([rows]), state, 2.0)
    assert list(zip(out["pid"], out["action"], strict=True)) == [(1, "evicted")] and state.get[0] == [2]


def test_sliding_map_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    pd.DataFrame([("c", 0, "add", 1, 0.0, 0.0, 0.0), ("c", 1, "centre", 0, 9.0, 0.0, 0.0)], columns=["cloud_id", "seq", "kind", "pid", "x", "y", "z"]).to_parquet(tmp_path / "in/a.parquet")
    stream = spark.readStream.schema("cloud_id string, seq long, kind string, pid long, x double, y double, z double").parquet(str(tmp_path / "in"))
    run = sliding_map.sliding_map(stream, 2.0).writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert [(r["pid"], r["action"]) for r in spark.table("changes").collect()] == [(1, "added"), (1, "evicted")]


def test_registration_recovers_a_known_pose(spark):
    rng = np.random.default_rng(7)
    n = 130
    wall = lambda k: np.insert(rng.uniform(1, 2, (n, 2)), k, 1 + rng.normal(0, 1e-3, n), axis=1)
    xyz = np.r_[wall(0), wall(1), wall(2), rng.uniform(1.2, 2.2, (60, 3))]
    source = cloud(spark, xyz, "a")
    # a turn about the origin: normals are oriented toward it
    c, s = math.cos(0.3), math.sin(0.3)
    matrix = [c, -s, 0.0, 0.0, s, c, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    target = layout.rigid(source, matrix).withColumn("cloud_id", F.lit("b"))
    p = registration.Parameters(0.1, segmentation_min_support=60, normal_radius=2.5, fpfh_k=40, fpfh_radius=3.0, pch_range=10.0, pch_2l_radius=10.0)
    clouds = registration.process_clouds(source.unionByName(target), p)
    pairs = spark.createDataFrame([(0, "a", "b")], "pair_id long, source string, target string")
    got = registration.register(clouds, pairs, p)
    assert np.allclose(got.transforms.first()["m"], matrix, atol=1e-3)
    counts = {r["cloud_id"]: r.asDict() for r in registration.counts(clouds).collect()}
    assert counts["a"]["points"] == 3 * n + 60 and counts["a"]["planes"] >= 2


def test_ladder_of_radii_equals_one_radius(spark):
    rng = np.random.default_rng(9)
    points = cloud(spark, np.r_[rng.normal(0, 0.05, (600, 3)), rng.uniform(-1, 1, (60, 3))])
    assert neighbors.crowding(points, 0.5) > 64
    rows = lambda df: sorted((r["pid"], r["nbr"], r["rk"]) for r in df.collect())
    assert rows(neighbors.neighborhoods(points, 0.5, 5)) == rows(neighbors._ranked(neighbors.radius_pairs(points, 0.5), 5))
