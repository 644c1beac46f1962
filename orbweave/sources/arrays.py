"""NumPy arrays to keyed relations and back, for clouds that a caller holds or wants in memory."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def points(spark: SparkSession, clouds: Mapping[str, np.ndarray]) -> DataFrame:
    """points (cloud_id, pid, x, y, z) of arrays of n rows of three; pid is the row's number.  Anything but numbers is an error."""
    parts = []
    for name, xyz in clouds.items():
        xyz = np.asarray(xyz, float)
        if xyz.size == 0:
            xyz = xyz.reshape(0, 3)
        if xyz.ndim != 2 or xyz.shape[1] != 3:
            raise ValueError(f"{name}: n rows of x, y, z are expected, not {xyz.shape}")
        parts.append(pa.table({"cloud_id": pa.array([name], pa.string()).take(pa.array(np.zeros(len(xyz), np.int32))), "pid": np.arange(len(xyz)), **{c: np.ascontiguousarray(xyz[:, k]) for k, c in enumerate("xyz")}}))
    empty = pa.table({"cloud_id": pa.array([], pa.string()), "pid": pa.array([], pa.int64()), **{c: pa.array([], pa.float64()) for c in "xyz"}})
    return spark.createDataFrame(pa.concat_tables([empty, *parts]))


def vectors(spark: SparkSession, sides: Mapping[object, np.ndarray], pair_id: int = 0) -> DataFrame:
    """Descriptors (pair_id, side, id, v) of arrays of n rows each; id is the row's number."""
    rows = []
    for side, values in sides.items():
        values = np.asarray(values, float)
        flat, width = values.ravel(), values.shape[1] if values.ndim == 2 else 0
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width or 1, dtype=np.int32)[: len(values) + 1]), pa.array(flat))
        rows.append(pa.table({"pair_id": np.full(len(values), pair_id), "side": pa.array([str(side)] * len(values), pa.string()), "id": np.arange(len(values)), "v": lists}))
    return spark.createDataFrame(pa.concat_tables(rows))


def arrays(points: DataFrame, columns: tuple[str, ...] = ("x", "y", "z")) -> dict[str, np.ndarray]:
    """Columns of each cloud as an array of rows in order of pid.  All of it comes to the caller's memory."""
    pdf = points.select("cloud_id", "pid", *columns).orderBy("cloud_id", "pid").toPandas()
    return {name: part[list(columns)].to_numpy(float) for name, part in pdf.groupby("cloud_id", sort=True)}


def neighbor_lists(neighbors: DataFrame, sizes: Mapping[str, int]) -> dict[str, list[list[int]]]:
    """The neighbours of every point 0 .. size - 1 of each cloud in order of rank; all of it comes to the caller's memory."""
    held = neighbors.groupBy("cloud_id", "pid").agg(F.sort_array(F.collect_list(F.struct("rk", "nbr"))).alias("l")).select("cloud_id", "pid", F.col("l.nbr").alias("l"))
    out = {name: [[] for _ in range(n)] for name, n in sizes.items()}
    for r in held.collect():
        out[r["cloud_id"]][r["pid"]] = list(r["l"])
    return out
