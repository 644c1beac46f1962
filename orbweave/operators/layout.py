"""Gather, masks, casts, Morton order, voxel grids, boxes and rigid motion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import colour, morton


def gather(indices: DataFrame, data: DataFrame, keys: tuple[str, ...] = ("cloud_id", "pid"), order: str = "ord") -> DataFrame:
    """Rows of ``data`` in the order of the index list (keys, ord); a key that is listed twice comes twice."""
    return indices.select(*keys, order).join(data, list(keys)).orderBy(order)


def to_scalar(points: DataFrame) -> DataFrame:
    """Coordinates narrowed to single precision."""
    return points.select(*(F.col(c).cast("float").alias(c) if c in ("x", "y", "z") else F.col(c) for c in points.columns))


def covered(supports: DataFrame) -> DataFrame:
    """Points that any plane covers."""
    return supports.select("cloud_id", "pid").distinct()


def uncovered(points: DataFrame, supports: DataFrame) -> DataFrame:
    """Points that no plane covers."""
    return points.join(supports.select("cloud_id", "pid"), ["cloud_id", "pid"], "left_anti")


def _voxels(points: DataFrame, voxel: float, half: float) -> DataFrame:
    """Points with voxel numbers i, j, k from their cloud's minimum; the minima are one row a cloud."""
    if not voxel > 0:
        raise ValueError("voxel size must be positive")
    low = points.groupBy("cloud_id").agg(*(F.min(c).alias(f"_{c}") for c in "xyz"))
    cell = [F.floor((F.col(c) - F.col(f"_{c}")) / F.lit(voxel) + F.lit(half)).alias(k) for c, k in zip("xyz", "ijk", strict=True)]
    return points.join(low, "cloud_id").select(*points.columns, *cell)


def morton_order(points: DataFrame, voxel: float) -> DataFrame:
    """Points with their Morton code and rank, sorted by code, then id."""
    coded = _voxels(points, voxel, 0.0).withColumn("code", F.expr(morton("i", "j", "k"))).drop("i", "j", "k")
    return coded.orderBy("cloud_id", "code", "pid")


def morton_layout(points: DataFrame, voxel: float, partitions: int) -> DataFrame:
    """The same order as a physical layout: ranges of codes in partitions, sorted inside; for writing tables."""
    coded = _voxels(points, voxel, 0.0).withColumn("code", F.expr(morton("i", "j", "k"))).drop("i", "j", "k")
    return coded.repartitionByRange(partitions, "cloud_id", "code", "pid").sortWithinPartitions("cloud_id", "code", "pid")


def voxel_downsample(points: DataFrame, voxel: float) -> DataFrame:
    """The mean point of each voxel; voxels are centred on the minimum corner."""
    cells = _voxels(points, voxel, 0.5).groupBy("cloud_id", "i", "j", "k")
    return cells.agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in "xyz"))


def box_query(points: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
    """Points inside an axis-aligned box, faces included; plain ranges that reach the scan."""
    for c, a, b in zip("xyz", low, high, strict=True):
        points = points.where(F.col(c).between(a, b))
    return points


def rigid(points: DataFrame, matrix: list[float], columns: tuple[str, str, str] = ("x", "y", "z"), shift: bool = True) -> DataFrame:
    """R p + t for a row-major 4 x 4 matrix; without ``shift``, R p alone (normals)."""
    moved = {}
    for k, c in enumerate(columns):
        moved[c] = sum((F.lit(matrix[4 * k + j]) * F.col(d) for j, d in enumerate(columns)), F.lit(matrix[4 * k + 3] if shift else 0.0))
    return points.withColumns(moved)


def palette(planes: DataFrame) -> DataFrame:
    """A colour for each plane_id."""
    return planes.select("*", *(F.expr(colour("plane_id", k)).alias(c) for k, c in enumerate(("red", "green", "blue"))))
