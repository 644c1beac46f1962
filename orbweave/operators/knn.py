"""k nearest neighbours without a radius: blocks of points along a curve, visited only where their boxes can hold a neighbour.

The search needs no radius because boxes bound the distances for each place it is asked about:

1. Points of a cloud are put in Morton order and cut into blocks of about ``BLOCK``, so blocks are small where the cloud is dense; of a block its
   box and its number of points are known.  Places are cut into tiles of ``TILE`` alike.  A tile keeps the blocks that can hold a neighbour of any
   of its places, found from boxes alone.
2. Each place visits the nearest blocks that hold k points; the k-th distance that it finds there bounds its search.
3. It then visits those other blocks whose boxes are not farther than that, and no more.

Places go to blocks, a row a visit, and only up to k rows come out of one; pairs are not exchanged, and points travel once for each
``SLICE`` visitors of their block.

Points at one location count once for each place in the result: a location offers its k smallest ids, and queries at one location
are answered once.  So crowds at one location, even a third of all points, cost nothing extra.

Distances are Euclidean, ties go to the smaller id, and a point is its own neighbour as in a search by radius.  A cloud of fewer
points gives them all.  Points and queries with a null id or a coordinate that is null, NaN or beyond 1e150 take no part, nor do queries
of clouds without points.  Queries may lie outside the cloud.  Where 2^20 units along a cloud's longest side don't tell points apart, their
blocks overlap and all of them are compared.  Repeated rows repeat.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import morton
from ..tables import stored
from .neighbors import SOUND, _parts

#: The curve has 2^BITS units along the longest side.
BITS = 20
#: Points of a block, places of a tile, visitors of a block in one task, pairs compared at once.
BLOCK, TILE, SLICE, PAIRS = 2048, 1024, 1 << 16, 1 << 18
PLACE = ["cloud_id", "x", "y", "z"]
_SLACK = 1 + 1e-9
_BOX = [f"{end}{c}" for end in ("l", "h") for c in "xyz"]


def _sound(df: DataFrame) -> DataFrame:
    return df.where(SOUND).select("cloud_id", "pid", "x", "y", "z")


def _runs(df: DataFrame, rows: int, name: str) -> DataFrame:
    """``df`` with the number of its run: about ``rows`` that follow each other on the curve of their cloud."""
    longest = F.greatest(*(F.max(c) - F.min(c) for c in "xyz"))
    low = stored(df.groupBy("cloud_id").agg(*(F.min(c).alias(f"_l{c}") for c in "xyz"), F.when(longest > 0, F.greatest(longest / 2**BITS, F.lit(1e-300))).otherwise(1.0).alias("_unit")))
    at = df.join(low, "cloud_id").withColumns({f"_g{c}": F.floor(F.least((F.col(c) - F.col(f"_l{c}")) / F.col("_unit"), F.lit(2.0**BITS - 1))).cast("long") for c in "xyz"})
    coded = at.select(*df.columns, F.expr(morton("_gx", "_gy", "_gz")).alias("_code"))
    ordered = coded.repartitionByRange(_parts(df), "cloud_id", "_code").sortWithinPartitions("cloud_id", "_code").select(*df.columns, F.spark_partition_id().cast("long").alias(name))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, run, used = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cloud = batch.column(0).dictionary_encode()
            index, names = cloud.indices.to_numpy(), cloud.dictionary
            cuts = [0, *(np.flatnonzero(np.diff(index)) + 1).tolist(), len(index)]
            numbers = np.empty(len(index), np.int64)
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                here = names[int(index[lo])].as_py()
                if here != last:
                    last, run, used = here, run + 1, 0
                numbers[lo:hi] = run + (used + np.arange(hi - lo)) // rows
                run, used = run + (used + hi - lo) // rows, (used + hi - lo) % rows
            part = batch.column(batch.num_columns - 1).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array((part << 32) + numbers)], names=batch.schema.names)

    return stored(ordered.mapInArrow(number, ordered.schema))


def _boxes(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("cloud_id", name).agg(*(F.min(c).alias(f"l{c}") for c in "xyz"), *(F.max(c).alias(f"h{c}") for c in "xyz"), F.count("*").alias("n"))


def _candidates(tiles: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(cloud_id, tile, block, box, n, want): blocks that may hold one of the nearest of any place in the tile."""
    held = stored(_boxes(blocks, "block"))
    want = held.groupBy("cloud_id").agg(F.least(F.sum("n"), F.lit(k)).alias("want"))
    ask = _boxes(tiles, "tile").drop("n").join(want, "cloud_id").select("cloud_id", "tile", "want", *(F.col(c).alias(f"_{c}") for c in _BOX))
    gap = [F.greatest(F.col(f"l{c}") - F.col(f"_h{c}"), F.col(f"_l{c}") - F.col(f"h{c}"), F.lit(0.0)) for c in "xyz"]
    reach = [F.greatest(F.col(f"h{c}") - F.col(f"_l{c}"), F.col(f"_h{c}") - F.col(f"l{c}")) for c in "xyz"]
    both = stored(ask).join(held, "cloud_id").withColumns({"_near": gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2], "_far": reach[0] * reach[0] + reach[1] * reach[1] + reach[2] * reach[2]})
    # a block that holds enough bounds all of the tile's searches by its farthest corner
    bound = stored(both.where("n >= want").groupBy("cloud_id", "tile").agg(F.min("_far").alias("_bound")))
    kept = both.join(bound, ["cloud_id", "tile"], "left").where((F.col("_near") <= F.col("_bound") * _SLACK) | F.col("_bound").isNull())
    return stored(kept.select("cloud_id", "tile", "block", *_BOX, "n", "want"))


def _visits(places: DataFrame, candidates: DataFrame) -> DataFrame:
    """(cloud_id, block, x, y, z, want, far): the nearest blocks that hold enough for each place (cloud_id, tile, x, y, z, far), or, where
    ``far`` is the squared distance that those gave, the others that are not farther."""
    kind = {c: places.schema[c].dataType.simpleString() for c in PLACE}

    def choose(ask: pa.Table, held: pa.Table) -> pa.Table:
        names = ["cloud_id", "block", "x", "y", "z", "want", "far"]
        if not ask.num_rows or not held.num_rows:
            return pa.Table.from_arrays([ask["cloud_id"][:0], pa.array([], pa.int64()), *(ask[c][:0] for c in "xyz"), pa.array([], pa.int64()), ask["far"][:0]], names=names)
        held = held.sort_by("block")
        low, high = (np.column_stack([held[f"{end}{c}"].to_numpy() for c in "xyz"]) for end in ("l", "h"))
        n, want = held["n"].to_numpy(), int(held["want"][0].as_py())
        xyz, far = np.column_stack([ask[c].to_numpy() for c in "xyz"]), ask["far"].to_numpy(zero_copy_only=False).astype(float)
        who, to = [], []
        step = max(1, PAIRS // len(n))
        for lo in range(0, len(xyz), step):
            q = xyz[lo : lo + step]
            gap = sum(np.maximum(np.maximum(low[:, k] - q[:, k, None], q[:, k, None] - high[:, k]), 0.0) ** 2 for k in range(3))
            order = np.argsort(gap, axis=1, kind="stable")
            held_before = np.cumsum(n[order], axis=1) - n[order]
            first = np.zeros(gap.shape, bool)
            np.put_along_axis(first, order, held_before < want, axis=1)
            bound = far[lo : lo + step, None]
            i, j = np.nonzero(np.where(np.isnan(bound), first, (gap <= bound * _SLACK) & ~first))
            who.append(i + lo)
            to.append(j)
        at, block = pa.array(np.concatenate(who)), pa.array(np.concatenate(to))
        return pa.Table.from_arrays([ask["cloud_id"].take(at), held["block"].take(block), *(ask[c].take(at) for c in "xyz"), held["want"].take(block), ask["far"].take(at)], names=names)

    out = f"cloud_id {kind['cloud_id']}, block long, x {kind['x']}, y {kind['y']}, z {kind['z']}, want long, far double"
    at = ["cloud_id", "tile"]
    return stored(places.groupBy(*at).cogroup(candidates.groupBy(*at)).applyInArrow(choose, out))


def _compare(visits: DataFrame, blocks: DataFrame) -> DataFrame:
    """(place, nbr, d2): the nearest of each visited block to each visitor, as many as it wants and none beyond its ``far``."""
    sizes = stored(visits.groupBy("cloud_id", "block").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices")))
    ask = visits.join(sizes, ["cloud_id", "block"]).withColumn("slice", F.pmod(F.xxhash64("x", "y", "z"), F.col("slices")).cast("int")).drop("slices")
    have = blocks.join(sizes, ["cloud_id", "block"]).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    kind = {f.name: f.dataType.simpleString() for f in blocks.schema}

    def nearest(seekers: pa.Table, points: pa.Table) -> pa.Table:
        points = points.sort_by("pid")
        q, p = (np.column_stack([t[c].to_numpy() for c in "xyz"]).reshape(-1, 3) for t in (seekers, points))
        who, to, gaps = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(q) and len(p):
            want = min(int(seekers["want"][0].as_py()), len(p))
            far = seekers["far"].to_numpy(zero_copy_only=False).astype(float)
            step = max(1, PAIRS // len(p))
            for lo in range(0, len(q), step):
                d = [q[lo : lo + step, k, None] - p[:, k] for k in range(3)]
                d2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
                last = np.partition(d2, want - 1, axis=1)[:, want - 1]
                i, j = np.nonzero(d2 <= np.fmin(last, far[lo : lo + step])[:, None])
                by = np.lexsort((j, d2[i, j], i))
                i, j = i[by], j[by]
                begin = np.searchsorted(i, i)
                keep = np.arange(len(i)) - begin < want
                i, j = i[keep], j[keep]
                who.append(i + lo)
                to.append(j)
                gaps.append(d2[i, j])
        at, end = pa.array(np.concatenate(who)), pa.array(np.concatenate(to))
        return pa.Table.from_arrays([*(seekers[c].take(at) for c in PLACE), points["pid"].take(end), pa.array(np.concatenate(gaps))], names=[*PLACE, "nbr", "d2"])

    at = ["cloud_id", "block", "slice"]
    out = f"cloud_id {kind['cloud_id']}, x {kind['x']}, y {kind['y']}, z {kind['z']}, nbr {kind['pid']}, d2 double"
    return ask.groupBy(*at).cogroup(have.groupBy(*at)).applyInArrow(nearest, out)


def _first(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy(*PLACE).orderBy("d2", "nbr")
    return rows.select(*PLACE, "nbr", "d2").withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k)


def knn(points: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """(cloud_id, pid, nbr, rk, d2): the k nearest points of every query (of every point, if no queries are given).

    points and queries: (cloud_id, pid, x, y, z).
    """
    if k < 1:
        raise ValueError("one neighbour at least")
    have = _sound(points).withColumns({c: F.col(c).cast("double") for c in "xyz"})
    ask = have if queries is None else _sound(queries).withColumns({c: F.col(c).cast("double") for c in "xyz"})
    order = Window.partitionBy(*PLACE).orderBy("pid")
    blocks = _runs(have.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r"), max(BLOCK, 4 * k), "block")
    tiles = _runs(ask.select(*PLACE).distinct(), TILE, "tile")
    candidates = _candidates(tiles, blocks, k)
    near = stored(_first(_compare(_visits(tiles.withColumn("far", F.lit(None).cast("double")), candidates), blocks), k))
    far = near.groupBy(*PLACE).agg(F.max("d2").alias("far"))
    more = _compare(_visits(tiles.join(far, PLACE), candidates), blocks)
    return ask.join(_first(near.unionByName(more, allowMissingColumns=True), k), PLACE).select("cloud_id", "pid", "nbr", "rk", "d2")


def reverse_knn(points: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """(cloud_id, pid, asker, rk, d2): for each point, the queries that have it among their k nearest, and at which rank."""
    return knn(points, k, queries).select("cloud_id", F.col("nbr").alias("pid"), F.col("pid").alias("asker"), "rk", "d2")
