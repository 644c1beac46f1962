"""Saved clouds: round trip, pruning, foreign and incomplete folders."""

import json
import math
import shutil
from pathlib import Path

import numpy as np
import pytest

from orbweave.operators import neighbors
from orbweave.sources import cloud_index

SCHEMA = "cloud_id string, pid long, x double, y double, z double, block int, code int, i int, n int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA)


def cloud(n, name="a", seed=1):
    return [(name, k, *map(float, p)) for k, p in enumerate(np.random.default_rng(seed).uniform(-1, 1, (n, 3)))]


def read_folders(df):
    """How many partition folders the plan's scan of the points reads, and how many there are."""
    scan = df._jdf.queryExecution().sparkPlan().collectLeaves().apply(0)
    filters = df._jdf.queryExecution().sparkPlan().toString()
    assert "PartitionFilters: [block" in filters
    return scan.selectedPartitions().partitionCount(), scan.relation().location().partitionSpec().partitions().size()


@pytest.fixture(scope="module")
def rows():
    return cloud(2000) + cloud(300, "b", 2) + [("a", 5000 + k, 0.5, 0.5, 0.5) for k in range(900)] + [("2020-01-01", 1, 0.0, 0.0, 0.0)] * 2


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('index')}/saved"
    wrong = [(None, 1, 0.0, 0.0, 0.0), ("a", None, 0.0, 0.0, 0.0), ("a", 1, None, 0.0, 0.0), ("a", 1, math.nan, 0.0, 0.0), ("a", 1, 0.0, 0.0, -math.inf)]
    cloud_index.save(table(spark, rows + wrong), path, 0.1, per_block=100)
    return cloud_index.load(spark, path)


def test_round_trip(rows, index):
    assert sorted(map(tuple, index.points().collect())) == sorted(rows)
    assert index.header["points"] == len(rows) and index.header["cell"] == 0.1
    blocks = index.manifest().collect()
    assert len(blocks) == index.header["blocks"] > 20 and sum(b["n"] for b in blocks) == len(rows)
    assert max(b["n"] for b in blocks) < 400  # also where 900 points share a place


def test_box_reads_the_blocks_it_meets(rows, index):
    low, high = (0.2, -0.5, -0.5), (0.5, 0.0, -0.1)
    got = index.box(low, high)
    assert sorted(map(tuple, got.collect())) == sorted(r for r in rows if all(a <= v <= b for v, a, b in zip(r[2:], low, high)))
    read, there = read_folders(got)
    assert there == index.header["blocks"] and 0 < read < 0.4 * there
    one = index.box(low, high, clouds=["b"])
    assert sorted(map(tuple, one.collect())) == sorted(r for r in rows if r[0] == "b" and all(a <= v <= b for v, a, b in zip(r[2:], low, high)))
    assert read_folders(one)[0] < read
    assert index.box((5.0,) * 3, (6.0,) * 3).collect() == [] and index.box(low, high, clouds=[]).collect() == []


def test_ball_is_strict(rows, index):
    got = sorted((r["cloud_id"], r["pid"]) for r in index.near((0.5, 0.5, 0.25), 0.25).collect())
    assert got == sorted(r[:2] for r in rows if (r[2] - 0.5) ** 2 + (r[3] - 0.5) ** 2 + (r[4] - 0.25) ** 2 < 0.0625)
    assert ("a", 5000) not in got  # on the surface
    assert len(index.near((0.5, 0.5, 0.25), 0.2500001).where("pid >= 5000").collect()) == 900
    with pytest.raises(ValueError, match="radius"):
        index.near((0.0, 0.0, 0.0), 0.0)


def test_pairs_by_radius(spark, rows, index):
    asks = table(spark, [("a", 1, -0.9, -0.9, -0.9), ("a", 2, -0.8, -0.7, -0.9), ("b", 3, -0.7, -0.9, -0.9)])
    got = index.radius_pairs(asks, 0.3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, neighbors.radius_pairs(table(spark, rows), 0.3, asks).collect()))
    assert index.radius_pairs(asks.limit(0), 0.3).collect() == []


def test_foreign_and_incomplete_folders(spark, index, tmp_path):
    with pytest.raises(cloud_index.ForeignIndex, match="no complete index"):
        cloud_index.load(spark, f"{tmp_path}/nothing")
    shutil.copytree(index.path, tmp_path / "old")
    header = next(Path(tmp_path, "old", "header").glob("*.json"))
    header.write_text(json.dumps(json.loads(header.read_text()) | {"version": 99}))
    Path(header.parent, f".{header.name}.crc").unlink()
    with pytest.raises(cloud_index.ForeignIndex, match="version 99"):
        cloud_index.load(spark, f"{tmp_path}/old")
    with pytest.raises(Exception, match="already exists"):
        cloud_index.save(index.points(), index.path, 0.1)


def test_index_of_nothing(spark, tmp_path):
    cloud_index.save(table(spark, []), f"{tmp_path}/empty", 0.1)
    empty = cloud_index.load(spark, f"{tmp_path}/empty")
    assert empty.header["points"] == 0 and empty.points().collect() == [] and empty.box((0.0,) * 3, (1.0,) * 3).collect() == []
