"""A pair of clouds registered step by step with the functions of the library surface.

    python -m orbweave.demo <source.ply> <target.ply> [voxel size]

The steps are those of ``plans.registration`` one by one, without ground segmentation.  Normals come from a search of their own instead
of a narrowed one, so a neighbour at exactly the smaller radius doesn't count.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import api
from .operators import consistency, descriptors, layout, matching
from .plans.registration import plane_table
from .sources import arrays, ply
from .tables import stored

SIDES = ("source", "target")


@dataclass
class Prepared:
    """Relations of both clouds, keyed by cloud_id."""

    points: DataFrame
    planes: DataFrame
    histograms: DataFrame
    groups: DataFrame
    descriptors: DataFrame


def prepare(points: DataFrame, voxel: float, min_support: int = 100) -> Prepared:
    """Neighbours, normals, planes with histograms and groups, and descriptors of the points off all planes."""
    points = stored(layout.to_scalar(points).select("cloud_id", "pid", *(F.col(c).cast("double").alias(c) for c in "xyz")))
    close, wide = (stored(api.compute_neighborhoods(points, k * voxel, n)) for k, n in ((2, 30), (5, 100)))
    normals = stored(api.compute_normals(points, close))
    supports = stored(api.segment_planes(points, normals, close, voxel, math.sin(math.radians(10)), min_support))
    planes = stored(plane_table(points, supports))
    histograms = stored(api.compute_pch(planes, points, normals, 20 * voxel, 20 * voxel))
    groups = stored(api.group_planes(planes, 2 * voxel, math.cos(math.radians(5))))
    off = layout.uncovered(points, supports).select("cloud_id", "pid")
    return Prepared(points, planes, histograms, groups, stored(api.compute_fpfh(wide, points, normals, off)))


def register(clouds: Prepared, voxel: float) -> tuple[np.ndarray, dict[str, int]]:
    """The source-to-target transform, and how much of everything led to it."""
    of = lambda df, side: df.where(F.col("cloud_id") == side).drop("cloud_id").withColumn("pair_id", F.lit(0))
    vectors = descriptors.as_vectors(clouds.descriptors, ("cloud_id", "pid"), 33).withColumnRenamed("pid", "id")
    points = stored(api.mutual_correspondences(*(of(vectors, s) for s in SIDES)).withColumn("m", F.col("m").cast("long")))
    bins = clouds.histograms.select("cloud_id", F.col("plane_id").alias("id"), "kind", (F.col("d_bin") * descriptors.A_BINS + F.col("a_bin")).alias("bin"), "mass")
    groups = clouds.groups.withColumnRenamed("plane_id", "id")
    planes = api.pch_matching(*(of(bins, s) for s in SIDES), *(of(groups, s) for s in SIDES))
    planes = stored(planes.withColumn("m", (F.row_number().over(Window.partitionBy("pair_id").orderBy("s", "t")) - 1).cast("long")))

    ends = stored(matching.matched_points(points, *(of(clouds.points, s) for s in SIDES)))
    end = lambda s, key, c: of(clouds.planes, s).select("pair_id", F.col("plane_id").alias(key), *(F.col(f"{q}{a}").alias(f"{c}{q}{a}") for q in "cn" for a in "xyz"))
    pairs = stored(planes.join(end("source", "s", "p"), ["pair_id", "s"]).join(end("target", "t", "q"), ["pair_id", "t"]))
    edges = stored(api.consistent_correspondences(pairs.drop("s", "t", "confidence"), ends.drop("s", "t", "d2"), voxel, math.radians(5)))
    clique = api.maximum_weight_clique(edges, consistency.node_weights(planes, points))
    n_planes = planes.sparkSession.createDataFrame([(0, planes.count())], "pair_id int, n_planes long")
    chosen = stored(consistency.split_clique(clique, n_planes))
    keep = lambda df, kind: df.join(chosen.where(F.col("kind") == kind).select("pair_id", "m"), ["pair_id", "m"], "left_semi")
    pose = api.compute_transformation(keep(ends, "point"), keep(pairs, "plane").withColumn("weight", consistency.plane_weight(F.col("confidence")))).first()
    known = {"point_matches": points.count(), "plane_matches": planes.count(), "edges": edges.count(), "selected_points": keep(ends, "point").count(), "selected_planes": keep(pairs, "plane").count()}
    return np.eye(4) if pose is None else np.array(pose["m"]).reshape(4, 4), known


def run(spark: SparkSession, source: np.ndarray, target: np.ndarray, voxel: float = 0.05, min_support: int = 100) -> tuple[np.ndarray, dict[str, int]]:
    return register(prepare(arrays.points(spark, {"source": source, "target": target}), voxel, min_support), voxel)


def main(args: list[str]) -> int:
    if len(args) not in (2, 3):
        print("usage: python -m orbweave.demo <source.ply> <target.ply> [voxel size]", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("demo").getOrCreate()
    try:
        points = ply.scan(spark, args[0]).withColumn("cloud_id", F.lit("source")).unionByName(ply.scan(spark, args[1]).withColumn("cloud_id", F.lit("target")))
        voxel = float(args[2]) if args[2:] else 0.05
        matrix, known = register(prepare(points, voxel), voxel)
        print(*(f"{name}: {n}" for name, n in known.items()), sep="\n")
        print(matrix)
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
