"""Clouds saved as an index on disk, and read in part.

``save`` sorts points into Morton order over all clouds and writes them as Parquet in blocks of about ``per_block`` rows, one folder a
block, with a manifest of each block's bounds and a header.  A block is a range of (cloud, code, id), so a location of very many points
fills several blocks.  The header is written last: an index without one is incomplete, one of another format or version is
foreign, and neither is read.

``load`` gives an ``Index``, whose box and radius searches read the folders of those blocks alone whose bounds the search meets.

Points without a cloud, an id or a coordinate, and those with a NaN or infinite one, are not saved.  Repeated rows stay.  An
empty cloud makes an index without blocks.  Other columns are not saved.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout, neighbors

FORMAT, VERSION = "orbweave cloud index", 1
POINTS = "cloud_id string, pid long, x double, y double, z double, block int"
BOUNDS = "block int, n long, " + ", ".join(f"low_{c} double, high_{c} double" for c in "xyz") + ", first_cloud string, last_cloud string"
HEADER = "format string, version int, cell double, per_block long, points long, blocks long"


class ForeignIndex(ValueError):
    """A folder that holds no index of this format and version."""


def save(points: DataFrame, path: str, cell: float, per_block: int = 1_000_000) -> None:
    """Write an index of points (cloud_id, pid, x, y, z) into a new folder; cells of width ``cell`` are in Morton order."""
    spark = points.sparkSession
    sound = points.where("cloud_id IS NOT NULL AND pid IS NOT NULL AND " + " AND ".join(f"abs({c}) < double('inf')" for c in "xyz")).select(F.col("cloud_id").cast("string").alias("cloud_id"), F.col("pid").cast("long").alias("pid"), *(F.col(c).cast("double").alias(c) for c in "xyz"))
    blocks = max(1, math.ceil(sound.count() / per_block))
    # each task of the range exchange is a block
    sorted_ = layout.morton_layout(sound, cell, blocks).withColumn("block", F.spark_partition_id())
    sorted_.select("cloud_id", "pid", "x", "y", "z", "block").write.partitionBy("block").parquet(f"{path}/points")
    saved = spark.read.schema(POINTS).parquet(f"{path}/points")
    bounds = saved.groupBy("block").agg(F.count("*").alias("n"), *(f(c).alias(f"{name}_{c}") for c in "xyz" for name, f in (("low", F.min), ("high", F.max))), F.min("cloud_id").alias("first_cloud"), F.max("cloud_id").alias("last_cloud"))
    bounds.write.parquet(f"{path}/manifest")
    known = spark.read.schema(BOUNDS).parquet(f"{path}/manifest").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("points"), F.count("*").alias("blocks"))
    known.select(F.lit(FORMAT).alias("format"), F.lit(VERSION).alias("version"), F.lit(float(cell)).alias("cell"), F.lit(per_block).cast("long").alias("per_block"), "points", "blocks").coalesce(1).write.json(f"{path}/header")


class Index:
    """A saved index; ``header`` says what it holds."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        try:
            rows = spark.read.schema(HEADER).json(f"{path}/header").collect()  # one row
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = []
        if len(rows) != 1:
            raise ForeignIndex(f"{path} holds no complete index")
        self.header = rows[0]
        if (self.header["format"], self.header["version"]) != (FORMAT, VERSION):
            raise ForeignIndex(f"{path} holds {self.header['format']!r} of version {self.header['version']}; {FORMAT!r} of version {VERSION} is read")

    def points(self) -> DataFrame:
        """All points."""
        return self.spark.read.schema(POINTS).parquet(f"{self.path}/points").drop("block")

    def manifest(self) -> DataFrame:
        return self.spark.read.schema(BOUNDS).parquet(f"{self.path}/manifest")

    def _meeting(self, low: tuple, high: tuple, clouds: list[str] | None) -> DataFrame:
        """Points of the blocks that meet a box, of some clouds or all."""
        hit = self.manifest()
        for c, a, b in zip("xyz", low, high, strict=True):
            hit = hit.where((F.col(f"low_{c}") <= b) & (F.col(f"high_{c}") >= a))
        if clouds is not None:
            # a block holds a range of clouds
            hit = hit.where(F.exists(F.array(*(F.lit(c) for c in clouds)).cast("array<string>"), lambda c: c.between(F.col("first_cloud"), F.col("last_cloud"))))
        numbers = [r["block"] for r in hit.select("block").collect()]  # the folders that are read, no more than the header's blocks
        found = self.spark.read.schema(POINTS).parquet(f"{self.path}/points").where(F.col("block").isin(numbers)).drop("block")
        return found if clouds is None else found.where(F.col("cloud_id").isin(clouds))

    def box(self, low: tuple[float, float, float], high: tuple[float, float, float], clouds: list[str] | None = None) -> DataFrame:
        """Points inside an axis-aligned box, faces included."""
        return layout.box_query(self._meeting(low, high, clouds), low, high)

    def near(self, centre: tuple[float, float, float], radius: float, clouds: list[str] | None = None) -> DataFrame:
        """Points strictly inside a ball, with d2."""
        if not radius > 0:
            raise ValueError("radius must be positive")
        d2 = sum(((F.col(c) - v) * (F.col(c) - v) for c, v in zip("yz", centre[1:], strict=True)), (F.col("x") - centre[0]) * (F.col("x") - centre[0]))
        return self.box(tuple(v - radius for v in centre), tuple(v + radius for v in centre), clouds).withColumn("d2", d2).where(F.col("d2") < radius * radius)

    def radius_pairs(self, queries: DataFrame, radius: float) -> DataFrame:
        """(cloud_id, pid, nbr, d2) of the points strictly inside the radius of each query; blocks away from all queries are not read."""
        of = queries.agg(*(f(c).alias(f"{name}_{c}") for c in "xyz" for name, f in (("low", F.min), ("high", F.max)))).first()
        if of["low_x"] is None:
            return neighbors.radius_pairs(self.points().limit(0), radius, queries)
        found = self._meeting(tuple(of[f"low_{c}"] - radius for c in "xyz"), tuple(of[f"high_{c}"] + radius for c in "xyz"), None)
        return neighbors.radius_pairs(found, radius, queries)


def load(spark: SparkSession, path: str) -> Index:
    return Index(spark, path)
