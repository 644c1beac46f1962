"""Command lines, the step-by-step flow and the library surface on small scans."""

import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave import api, cli, demo
from orbweave.operators import neighbors, pose
from orbweave.plans import registration
from orbweave.sources import ply

TURN = np.array([[math.cos(0.3), -math.sin(0.3), 0, 0], [math.sin(0.3), math.cos(0.3), 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]])


def room(seed=7, n=130):
    """Three walls and clutter, seen from outside."""
    rng = np.random.default_rng(seed)
    wall = lambda k: np.insert(rng.uniform(1, 2, (n, 2)), k, 1 + rng.normal(0, 1e-3, n), axis=1)
    return np.r_[wall(0), wall(1), wall(2), rng.uniform(1.2, 2.2, (60, 3))]


@pytest.fixture(scope="module")
def scans(tmp_path_factory):
    """Scan 1 is scan 0 turned; scan 2 holds three points, with which nothing can be matched."""
    base = tmp_path_factory.mktemp("datasets")
    folder = base / "scans/lab/room"
    folder.mkdir(parents=True)
    source = room()
    for k, xyz in enumerate((source, source @ TURN[:3, :3].T, np.array([[50.0, 0, 0], [0, 60.0, 0], [0, 0, 70.0]]))):
        (folder / f"cloud_bin_{k}.ply").write_bytes(ply.render(xyz, k == 1))
    (folder / "voxel_size").write_text("0.1\n")
    (base / "benchmarks/lab/room").mkdir(parents=True)
    log = lambda s, t, m: f"{s}\t{t}\t3\n" + "\n".join(" ".join(map(repr, row)) for row in m.tolist()) + "\n"
    (base / "benchmarks/lab/room/gt.log").write_text(log(0, 1, np.linalg.inv(TURN)) + log(0, 2, np.linalg.inv(TURN)))
    (base / "suite.txt").write_text("scans/lab/room benchmarks/lab/room/gt.log --success-criteria 0.1 5\n\n")
    return base


def test_benchmark_counts_lost_pairs(spark, scans, tmp_path, capsys):
    out = tmp_path / "results"
    assert cli.benchmark(spark, [f"{scans}/suite.txt", str(out)]) == 0
    lines = sorted(r["value"].split() for r in spark.read.text(f"{out}/summary").collect())
    assert [x[0] for x in lines] == ["Total", "lab/room"] and all(x[1] == "50.000" for x in lines)  # one of two pairs
    assert float(lines[0][2]) < 0.1 and float(lines[0][3]) < 5
    assert "success: 1/2" in capsys.readouterr().out
    numbers = [list(map(float, r["value"].split())) for r in spark.read.text(f"{out}/lab/room").collect()]
    heads = [x for x in numbers if len(x) == 3]
    assert sorted(heads) == [[0, 1, 0], [0, 2, 0]]
    lost = numbers.index([0, 2, 0])
    assert np.array_equal(numbers[lost + 1 : lost + 5], np.eye(4))
    found = numbers.index([0, 1, 0])
    assert np.allclose(numbers[found + 1 : found + 5], np.linalg.inv(TURN), atol=0.05)


def test_register_command(spark, scans, capsys):
    folder = f"{scans}/scans/lab/room"
    assert cli.register(spark, [f"{folder}/cloud_bin_0.ply", f"{folder}/cloud_bin_1.ply", "0.1", "--raw"]) == 0
    out = capsys.readouterr().out
    assert "Preparing clouds" in out and "non_planar" in out
    matrix = np.array([list(map(float, line.split())) for line in out.strip().split("\n")[-4:]])
    assert np.allclose(matrix[:3, :3] @ matrix[:3, :3].T, np.eye(3), atol=1e-6)
    assert cli.register(spark, ["a", "b"]) == 1 and cli.register(spark, ["a", "b", "1", "--other"]) == 1
    assert cli.benchmark(spark, ["a"]) == 1 and cli.main([]) == 1 and cli.main(["fly"]) == 1


def test_steps_of_the_demo(spark):
    source = room()
    got, known = demo.run(spark, source, source @ TURN[:3, :3].T, 0.1, min_support=60)
    assert np.allclose(got, TURN, atol=0.02)
    assert known["selected_points"] + known["selected_planes"] >= 3 and known["edges"] > 0
    assert demo.main(["one"]) == 1
    nothing, known = demo.run(spark, source[:2], source[:1], 0.1)
    assert np.array_equal(nothing, np.eye(4)) and known["selected_points"] == 0


def test_library_surface():
    """The names that users import, each a function with a docstring."""
    names = {"compute_neighborhoods", "compute_normals", "compute_plane", "group_planes", "segment_planes", "compute_fpfh", "mutual_correspondences", "pch_matching", "consistent_correspondences", "maximum_weight_clique", "compute_pch", "compute_transformation"}
    assert names <= set(api.__all__)
    assert all(callable(getattr(api, n)) and getattr(api, n).__doc__ for n in api.__all__)


def test_evaluation_has_a_row_a_pair(spark):
    truth = spark.createDataFrame([(k, "d", "s", [float(x) for x in np.eye(4).ravel()] if k else [float(x) for x in TURN.ravel()], 0.1, 5.0, 1.0) for k in range(3)], "pair_id long, dataset string, sequence string, m array<double>, t_crit double, r_crit double, runtime_ms double")
    got = {r["pair_id"]: r for r in registration.evaluate(spark.createDataFrame([(1, [float(x) for x in np.eye(4).ravel()])], "pair_id long, m array<double>"), truth).collect()}
    assert sorted(got) == [0, 1, 2] and not got[0]["ok"] and got[1]["ok"] and got[2]["ok"]
    assert math.isclose(got[0]["re"], math.degrees(0.3)) and got[0]["te"] == 0
    row = pose.summary(registration.evaluate(spark.createDataFrame([], "pair_id long, m array<double>"), truth)).first()
    assert (row["pairs"], row["successful"]) == (3, 2)


@pytest.mark.parametrize("kind", ["so3", "l2_simple", "l1", "l2", "so2"])
def test_metrics(spark, kind):
    rng = np.random.default_rng(3)
    size = {"so2": 1, "so3": 4}.get(kind, 5)
    a, b = rng.uniform(-3, 3, (40, size)), rng.uniform(-3, 3, (40, size))
    rows = spark.createDataFrame([(k, x.tolist(), y.tolist()) for k, (x, y) in enumerate(zip(a, b))], "k int, a array<double>, b array<double>")
    if kind == "so2":  # columns of angles
        rows = rows.select("k", *(F.col(c)[0].alias(c) for c in "ab"))
    got = [r["distance"] for r in neighbors.distances(rows, kind).orderBy("k").collect()]
    angle = np.abs((a - b + math.pi) % (2 * math.pi) - math.pi)[:, 0]
    want = {"l1": np.abs(a - b).sum(1), "so2": angle}.get(kind, ((a - b) ** 2).sum(1))
    assert np.allclose(got, want), kind
