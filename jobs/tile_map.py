"""A tiled map of scans, ready to be registered: down-sampled points in Morton order, and the plane of each tile.

Registration begins alike for every pair that a scan is part of: the raw scan is thinned to one mean point a voxel, put in Morton
order and searched for planes.  This job does so once for each scan.  It reads a table of points (columns and coordinates are
SQL expressions of the configuration), thins each cloud, cuts it into cubic tiles of ``tile`` voxels a side, fits a plane to every
tile, and writes one folder a cloud, whose files hold ranges of tiles, so that readers of a box skip files by their statistics.

A run replaces whole clouds and leaves all others alone, so it can be repeated and can be given some clouds only (``clouds``).
A tile has at most tile^3 rows whatever the scan, and voxels are summed before the shuffle, so no cell of a scan is a crowded key.

Rows without an id or with a coordinate that is null or not finite take no part.  A tile of under three points, or without a
direction of least spread, has the normal +Z.  An empty table writes nothing.

    python -m jobs.tile_map <folder of tables> <output> [configuration.json]
"""

from __future__ import annotations

import json
import logging
import sys
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from orbweave.functions import steps
from orbweave.functions.geometry import morton
from orbweave.operators import layout, surface

CONFIG = json.loads(Path(__file__).with_suffix(".json").read_text())
SCHEMA = "tile long, code long, x double, y double, z double, n long, nx double, ny double, nz double, planar boolean, cloud_id string"
log = logging.getLogger("jobs.tile_map")


def points(spark: SparkSession, tables: str, config: dict) -> DataFrame:
    """(cloud_id, pid, x, y, z) of the table that the configuration names."""
    rows = steps.apply(spark.read.parquet(f"{tables}/{config['table']}.parquet"), config["levels"], drop=False)
    rows = rows.selectExpr(f"CAST({config['cloud_id']} AS STRING) AS cloud_id", f"{config['pid']} AS pid", "x", "y", "z")
    rows = rows.where("pid IS NOT NULL AND " + " AND ".join(f"abs({c}) < double('inf')" for c in "xyz"))  # a NaN is above infinity
    return rows if config.get("clouds") is None else rows.where(F.col("cloud_id").isin(config["clouds"]))


def tiles(cloud: DataFrame, voxel: float, tile: int, thickness: float) -> DataFrame:
    """Mean points of voxels with their Morton codes, their tiles, and the tiles' planes."""
    cells = layout.voxel_downsample(cloud, voxel).withColumns({f"_{c}": F.expr(f"{c} div {tile}") for c in "ijk"})
    cells = cells.withColumns({"code": F.expr(morton("i", "j", "k")), "tile": F.expr(morton("_i", "_j", "_k"))})
    cells = cells.select("cloud_id", "tile", "code", "x", "y", "z", "n")
    planes = surface.fit_planes(cells, "cloud_id", "tile").selectExpr(
        "cloud_id", "tile", *(f"CASE WHEN n >= 3 THEN n{a} ELSE {d} END AS n{a}" for a, d in zip("xyz", ("0e0", "0e0", "1e0"), strict=True)), f"n >= 3 AND l3 <= {thickness!r} * {thickness!r} AS planar"
    )
    return cells.join(planes, ["cloud_id", "tile"]).select("tile", "code", "x", "y", "z", "n", "nx", "ny", "nz", "planar", "cloud_id")


def read_map(spark: SparkSession, output: str) -> DataFrame:
    """The map as it stands; cloud_id stays a string, whatever it looks like."""
    return spark.read.schema(SCHEMA).parquet(output)


def run(spark: SparkSession, tables: str, output: str, config: dict = CONFIG) -> DataFrame:
    """Build or rebuild the clouds of a table, and return the whole map."""
    read, wrote = Observation("read"), Observation("wrote")
    cloud = points(spark, tables, config)
    empty = cloud.isEmpty()  # Spark leaves out what it knows to be empty, observations with it
    made = tiles(cloud if empty else cloud.observe(read, F.count("*").alias("rows")), config["voxel"], config["tile"], config["thickness"])
    made = made.repartitionByRange(*([config["files"]] if config.get("files") else []), "cloud_id", "tile", "code").sortWithinPartitions("cloud_id", "tile", "code")
    made = made if empty else made.observe(wrote, F.count("*").alias("rows"), F.count_if("planar").alias("planar"))
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cloud_id").parquet(output)
    log.info("read %s points of %s/%s", 0 if empty else read.get["rows"], tables, config["table"])
    log.info("wrote %s points to %s, %s of them in planar tiles", *((0, output, 0) if empty else (wrote.get["rows"], output, wrote.get["planar"])))
    return read_map(spark, output)


def main(args: list[str]) -> int:
    if len(args) not in (2, 3):
        print("usage: python -m jobs.tile_map <folder of tables> <output> [configuration.json]", file=sys.stderr)
        return 1
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = CONFIG | json.loads(Path(args[2]).read_text()) if args[2:] else CONFIG
    spark = SparkSession.builder.appName("tile_map").getOrCreate()
    try:
        run(spark, args[0], args[1], config)
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
