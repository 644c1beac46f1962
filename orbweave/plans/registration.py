"""Clouds prepared and pairs registered, all clouds and pairs at once."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import consistency, descriptors, ground, layout, matching, neighbors, pose, segmentation, surface
from ..tables import stored


@dataclass(frozen=True)
class Parameters:
    """Lengths are multiples of the voxel size, angles are degrees."""

    voxel_size: float
    normal_k: int = 30
    normal_radius: float = 2.0
    fpfh_k: int = 100
    fpfh_radius: float = 5.0
    ground_segmentation: bool = False
    segmentation_thickness: float = 1.0
    segmentation_dispersion: float = 10.0
    segmentation_min_support: int = 100
    pch_range: float = 20.0
    pch_2l_radius: float = 20.0
    pch_grouping_distance: float = 2.0
    pch_grouping_angle: float = 5.0
    outlier_rejection_distance: float = 1.0
    outlier_rejection_angle: float = 5.0
    ground: ground.GroundParameters = field(default_factory=ground.GroundParameters)

    def __post_init__(self) -> None:
        if not self.voxel_size > 0:
            raise ValueError("voxel size must be positive")


@dataclass
class ProcessedClouds:
    """Relations of prepared clouds, keyed by cloud_id."""

    points: DataFrame
    normals: DataFrame
    supports: DataFrame
    planes: DataFrame
    pch: DataFrame
    non_planar: DataFrame
    fpfh: DataFrame


@dataclass
class Registration:
    """Relations of registered pairs, keyed by pair_id.

    transforms (pair_id, m, optimal) has a row for each pair; optimal tells whether its clique is proved to be the heaviest.
    """

    point_matches: DataFrame
    plane_matches: DataFrame
    clique: DataFrame
    transforms: DataFrame


def process_clouds(points: DataFrame, p: Parameters) -> ProcessedClouds:
    """Normals, planes, plane histograms and descriptors of every cloud in ``points`` (cloud_id, pid, x, y, z).

    What several later steps read is stored, so that no plan holds another one's plan many times over.
    """
    keep = stored
    points = layout.to_scalar(points)
    points = keep(points.select("cloud_id", "pid", *(F.col(c).cast("double").alias(c) for c in "xyz")))
    v = p.voxel_size
    floor = keep(ground.segment_ground(points, p.ground)) if p.ground_segmentation else None
    wide = keep(neighbors.neighborhoods(points, p.fpfh_radius * v, p.fpfh_k))
    near = neighbors.narrow(wide, p.normal_radius * v, p.normal_k)
    normals = keep(surface.point_normals(points, near))
    dispersion = math.sin(math.radians(p.segmentation_dispersion))
    stable = keep(surface.stable_points(near, normals, dispersion, floor))
    roots = segmentation.region_roots(points, normals, near, stable, p.segmentation_thickness * v, dispersion)
    supports = keep(segmentation.supports(roots, p.segmentation_min_support, floor))
    planes = keep(plane_table(points, supports))
    pch = keep(descriptors.pch(planes, points, normals, p.pch_range * v, p.pch_2l_radius * v))
    non_planar = keep(layout.uncovered(points, supports))
    fpfh = keep(descriptors.fpfh(wide, points, normals, non_planar.select("cloud_id", "pid")))
    return ProcessedClouds(points, normals, supports, planes, pch, non_planar, fpfh)


def plane_table(points: DataFrame, supports: DataFrame) -> DataFrame:
    """(cloud_id, plane_id, n, c?, n?) of supports."""
    fitted = surface.fit_planes(supports.join(points, ["cloud_id", "pid"]), "cloud_id", "plane_id")
    return fitted.select("cloud_id", "plane_id", "n", *(F.col(f"m{a}").alias(f"c{a}") for a in "xyz"), "nx", "ny", "nz")


def register(clouds: ProcessedClouds, pairs: DataFrame, p: Parameters) -> Registration:
    """Poses of ``pairs`` (pair_id, source, target: cloud ids); each cloud is prepared once, however many pairs it is in."""
    v = p.voxel_size
    side = lambda df, end: df.join(pairs.select("pair_id", F.col(end).alias("cloud_id")), "cloud_id").drop("cloud_id")
    vectors = descriptors.as_vectors(clouds.fpfh, ("cloud_id", "pid"), 33).withColumnRenamed("pid", "id")
    matches = matching.mutual_nearest(side(vectors, "source"), side(vectors, "target"))
    matches = stored(matches.withColumn("m", F.col("m").cast("long")))

    groups = matching.plane_groups(clouds.planes, p.pch_grouping_distance * v, math.cos(math.radians(p.pch_grouping_angle))).withColumnRenamed("plane_id", "id")
    hist = clouds.pch.select("cloud_id", F.col("plane_id").alias("id"), "kind", (F.col("d_bin") * descriptors.A_BINS + F.col("a_bin")).alias("bin"), "mass")
    plane_matches = matching.match_planes(side(hist, "source"), side(hist, "target"), side(groups, "source"), side(groups, "target"))
    number = Window.partitionBy("pair_id").orderBy("s", "t")
    plane_matches = stored(plane_matches.withColumn("m", (F.row_number().over(number) - 1).cast("long")))

    ends = matching.matched_points(matches, side(clouds.points, "source"), side(clouds.points, "target"))
    plane_end = lambda end, key, c: side(clouds.planes, end).select("pair_id", F.col("plane_id").alias(key), *(F.col(f"{q}{a}").alias(f"{c}{q}{a}") for q in "cn" for a in "xyz"))
    planes = plane_matches.join(plane_end("source", "s", "p"), ["pair_id", "s"]).join(plane_end("target", "t", "q"), ["pair_id", "t"])
    nodes = consistency.node_weights(plane_matches, matches)
    corners = planes.select("pair_id", "m", *(f"{c}{q}{a}" for c in "pq" for q in "cn" for a in "xyz"))
    clique = consistency.consistent_clique(corners, ends.select("pair_id", "m", *(f"{c}{a}" for c in "pq" for a in "xyz")), nodes, p.outlier_rejection_distance * v, math.radians(p.outlier_rejection_angle))
    n_planes = pairs.select("pair_id").join(plane_matches.groupBy("pair_id").agg(F.count("*").alias("n")), "pair_id", "left").select("pair_id", F.coalesce("n", F.lit(0)).alias("n_planes"))
    chosen = stored(consistency.split_clique(clique, n_planes))
    good_points = ends.join(chosen.where("kind = 'point'").select("pair_id", "m"), ["pair_id", "m"])
    good_planes = planes.join(chosen.where("kind = 'plane'").select("pair_id", "m"), ["pair_id", "m"]).withColumn("weight", consistency.plane_weight(F.col("confidence")))
    # a pair without a clique stays where it is; of no nodes, the clique is the best
    proved = chosen.groupBy("pair_id").agg(F.every("optimal").alias("optimal"))
    transforms = pairs.select("pair_id").join(pose.estimate(good_points, good_planes), "pair_id", "left").join(proved, "pair_id", "left")
    transforms = transforms.select("pair_id", F.coalesce("m", pose.identity()).alias("m"), F.coalesce("optimal", F.lit(True)).alias("optimal"))
    return Registration(matches, plane_matches, chosen, transforms)


def counts(clouds: ProcessedClouds) -> DataFrame:
    """(cloud_id, points, planes, non_planar) of each cloud."""
    count = lambda df, name: df.groupBy("cloud_id").agg(F.count("*").alias(name))
    out = count(clouds.points, "points").join(count(clouds.planes, "planes"), "cloud_id", "left").join(count(clouds.non_planar, "non_planar"), "cloud_id", "left")
    return out.fillna(0)


def evaluate(transforms: DataFrame, truth: DataFrame) -> DataFrame:
    """Results (pair_id, dataset, sequence, runtime_ms, te, re, ok) from poses and truth (pair_id, dataset, sequence, m,
    t_crit, r_crit, runtime_ms): one for each row of the truth; a pair without a pose counts as left where it was."""
    rows = truth.withColumnRenamed("m", "truth").join(transforms.select("pair_id", "m"), "pair_id", "left")
    rows = rows.withColumn("m", F.coalesce("m", pose.identity()))
    return pose.succeeded(pose.errors(rows)).drop("m", "truth")
