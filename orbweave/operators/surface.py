"""Covariances, normals, planes, mergeable plane moments and the stability test."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import steps
from ..functions.geometry import COVARIANCE, SYMMETRIC_EIGEN, TOWARD_ORIGIN
from .neighbors import SOUND, by_blocks

FIT = SYMMETRIC_EIGEN + TOWARD_ORIGIN


def around(neighbors: DataFrame, points: DataFrame, columns: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Neighbour rows with columns of the neighbour, joined to them unless they carry them."""
    if set(columns) <= set(neighbors.columns):
        return neighbors.select("cloud_id", "pid", "nbr", *columns)
    return neighbors.join(points.select("cloud_id", F.col("pid").alias("nbr"), *columns), ["cloud_id", "nbr"])


def covariance(rows: DataFrame, *keys: str) -> DataFrame:
    """Number, mean and population covariance of x, y, z in each group."""
    return rows.groupBy(*keys).agg(*(F.expr(text).alias(name) for name, text in COVARIANCE.items()))


def covariance_by_blocks(points: DataFrame, radius: float, knn: int) -> DataFrame:
    """(cloud_id, pid, x, y, z, n, m?, c??): what ``covariance`` gives for the ``knn`` nearest inside the radius, summed in the blocks of the
    search, so that a point leaves its block as one row and no pair does."""
    kind = {f.name: f.dataType for f in points.schema}
    out = T.StructType([T.StructField(c, kind[c]) for c in ("cloud_id", "pid", "x", "y", "z")])
    for c in COVARIANCE:
        out.add(c, T.LongType() if c == "n" else T.DoubleType())

    def summed(table: pa.Table, who: np.ndarray, to: np.ndarray, rank: np.ndarray, d2: np.ndarray) -> list[pa.Array]:
        first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.zeros(0, np.int64)
        at, n = who[first], np.diff(np.r_[first, len(who)])
        xyz = [table[c].to_numpy() for c in "xyz"]
        total, mean, moment = np.zeros((3, len(n))), np.zeros((3, len(n))), np.zeros((6, len(n)))
        # neighbour after neighbour, as the engines' covar_pop goes on: a column of one value has exactly zero
        for k in range(int(n.max(initial=0))):
            on = np.flatnonzero(n > k)
            v = np.array([c[to[first[on] + k]] for c in xyz])
            off = v - mean[:, on]
            mean[:, on] += off / (k + 1)
            total[:, on] += v
            for row, (i, j) in enumerate((i, j) for i in range(3) for j in range(i, 3)):
                moment[row, on] += off[i] * (v[j] - mean[j, on])
        return [*(table[c].take(pa.array(at)) for c in ("cloud_id", "pid", "x", "y", "z")), *map(pa.array, (n, *(total / n), *(moment / n)))]

    return by_blocks(points, radius, knn, (), summed, out)


def fit_planes(rows: DataFrame, *keys: str) -> DataFrame:
    """Mean and unit normal (turned toward the origin) of each group, with covariance and eigenvalues."""
    return steps.settled(steps.apply(covariance(rows, *keys), FIT).drop("ex", "ey", "ez"), *keys)


def point_normals(points: DataFrame, neighbors: DataFrame) -> DataFrame:
    """(cloud_id, pid, nx, ny, nz): +Z below three neighbours, and always turned toward the origin."""
    fitted = fit_planes(around(neighbors, points), "cloud_id", "pid").select("cloud_id", "pid", "n", *(F.col(c).alias(f"_{c}") for c in ("nx", "ny", "nz")))
    return _turned(points.join(fitted, ["cloud_id", "pid"], "left")).select("cloud_id", "pid", "nx", "ny", "nz")


def normals_by_blocks(points: DataFrame, radius: float, knn: int) -> DataFrame:
    """(cloud_id, pid, x, y, z, nx, ny, nz): points with what ``point_normals`` gives for the ``knn`` nearest inside the radius, without
    an exchange after the search."""
    fitted = steps.apply(covariance_by_blocks(points, radius, knn), FIT)
    keep = ["cloud_id", "pid", "x", "y", "z", "n", *(F.col(c).alias(f"_{c}") for c in ("nx", "ny", "nz"))]
    lost = points.where(f"NOT coalesce({SOUND}, false)").select(*keep[:5], F.lit(0).cast("long").alias("n"), *(F.lit(None).cast("double").alias(f"_{c}") for c in ("nx", "ny", "nz")))
    return _turned(fitted.select(*keep).unionByName(lost))


def _turned(raw: DataFrame) -> DataFrame:
    """Points with fitted normals (n, _n?) turned toward the origin, +Z below three neighbours."""
    enough = F.col("n") >= 3
    raw = raw.select("cloud_id", "pid", "x", "y", "z", *(F.when(enough, F.col(f"_{c}")).otherwise(F.lit(d)).alias(c) for c, d in (("nx", 0.0), ("ny", 0.0), ("nz", 1.0))))
    turn = F.when(F.col("nx") * F.col("x") + F.col("ny") * F.col("y") + F.col("nz") * F.col("z") > 0, -1.0).otherwise(1.0)
    return raw.select("cloud_id", "pid", "x", "y", "z", *((F.col(c) * turn).alias(c) for c in ("nx", "ny", "nz")))


#: Sums that plane states are made of; adding them merges states.
MOMENTS = {
    "n": "CAST(count(*) AS BIGINT)", "sx": "sum(x)", "sy": "sum(y)", "sz": "sum(z)",
    "sxx": "sum(x * x)", "sxy": "sum(x * y)", "sxz": "sum(x * z)", "syy": "sum(y * y)", "syz": "sum(y * z)", "szz": "sum(z * z)",
    "qxx": "sum(nx * nx)", "qxy": "sum(nx * ny)", "qxz": "sum(nx * nz)", "qyy": "sum(ny * ny)", "qyz": "sum(ny * nz)", "qzz": "sum(nz * nz)",
}
_PAIRS = ("xx", "xy", "xz", "yy", "yz", "zz")


def plane_states(rows: DataFrame, *keys: str) -> DataFrame:
    """Mergeable state of each group of points with normals."""
    return rows.groupBy(*keys).agg(*(F.expr(text).alias(name) for name, text in MOMENTS.items()))


def merge_states(states: DataFrame, *keys: str) -> DataFrame:
    """States of larger groups."""
    return states.groupBy(*keys).agg(*(F.sum(name).alias(name) for name in MOMENTS))


#: Mean, covariance (c..) and mean outer product of normals (o..) of a state.
STATE_MODEL: steps.Levels = [
    {**{f"m{a}": f"s{a} / n" for a in "xyz"}},
    {**{f"c{p}": f"s{p} / n - m{p[0]} * m{p[1]}" for p in _PAIRS}, **{f"o{p}": f"q{p} / n" for p in _PAIRS}},
]


def state_models(states: DataFrame) -> DataFrame:
    return steps.apply(states, STATE_MODEL)


def stable_points(neighbors: DataFrame, normals: DataFrame, dispersion_sin: float, excluded: DataFrame | None = None) -> DataFrame:
    """(cloud_id, pid, lambda_max): points whose neighbours' normals agree.

    The mean outer product of the neighbours' normals (excluded neighbours included) has its largest eigenvalue at
    1 - sin^2 of the dispersion at least, and the point itself is not excluded.
    """
    rows = around(neighbors, normals, ("nx", "ny", "nz"))
    q = rows.groupBy("cloud_id", "pid").agg(*(F.avg(F.col(f"n{a}") * F.col(f"n{b}")).alias(f"c{i}{j}") for i, a in enumerate("xyz", 1) for j, b in enumerate("xyz", 1) if i <= j))
    out = steps.settled(steps.apply(q, SYMMETRIC_EIGEN).select("cloud_id", "pid", F.col("l1").alias("lambda_max")), "cloud_id", "pid").where(F.col("lambda_max") >= 1 - dispersion_sin * dispersion_sin)
    return out if excluded is None else out.join(excluded.select("cloud_id", "pid"), ["cloud_id", "pid"], "left_anti")
