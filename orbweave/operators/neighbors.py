"""Neighbour joins: bounded k nearest by grid cells, narrowing, nearest in descriptor space, existence."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import metric
from ..tables import stored
from .descriptor_search import BLOCK, search

#: Cells of a block along each side, and those that are added around it.
SIDE, MARGIN = 8, 2
#: Pairs that a block's search holds at once.
PAIRS = 1 << 20
#: Of sums inside a radius: cells of a block along each side, points of a narrow cell, about, rows that are given back and pairs that are compared at once.
SUM_SIDE, CELL_ROWS, BLOCK_ROWS, RIM_PAIRS = 2, 16, 1 << 14, 1 << 16
#: Points that take part in a search.
SOUND = "cloud_id IS NOT NULL AND pid IS NOT NULL AND " + " AND ".join(f"abs({c}) <= 1e150" for c in "xyz")


def _cells(radius: float) -> list:
    return [F.floor(F.col(c) / F.lit(radius)).alias(f"_{c}") for c in "xyz"]


def radius_pairs(points: DataFrame, radius: float, queries: DataFrame | None = None) -> DataFrame:
    """(cloud_id, pid, nbr, d2) of all points strictly inside the radius of each query, the query included.

    Cells are as wide as the radius, so the 27 cells around a query hold all its neighbours: the join is an equi-join on
    the cell, which AQE can split where a cell is crowded.
    """
    if not radius > 0:
        raise ValueError("radius must be positive")
    side = F.explode(F.array(*(F.lit(k) for k in (-1, 0, 1))))
    # dealt by point first: a small file is one partition, and the pairs it grows into shouldn't be
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ask = (points if queries is None else queries).repartition(parts, "cloud_id", "pid").select("cloud_id", "pid", "x", "y", "z", *_cells(radius))
    for c in "xyz":
        ask = ask.withColumn("_o", side).withColumn(f"_{c}", F.col(f"_{c}") + F.col("_o")).drop("_o")
    have = points.select("cloud_id", F.col("pid").alias("nbr"), *(F.col(c).alias(f"n{c}") for c in "xyz"), *_cells(radius))
    d2 = sum(((F.col(c) - F.col(f"n{c}")) * (F.col(c) - F.col(f"n{c}")) for c in "yz"), (F.col("x") - F.col("nx")) * (F.col("x") - F.col("nx")))
    return ask.join(have, ["cloud_id", "_x", "_y", "_z"]).withColumn("d2", d2).where(F.col("d2") < F.lit(radius * radius)).select("cloud_id", "pid", "nbr", "d2")


def sums_inside(xyz: np.ndarray, ask: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """How many rows of ``xyz`` lie strictly inside the radius of each of its rows ``ask``, and the sum of their squared distances.

    Rows are dealt to narrow cells.  A cell that is inside for all askers of a cell adds its count and moments, one outside for all adds
    nothing, and only rows of cells on the rim are compared one by one.
    """
    count, total = np.zeros(len(ask), np.int64), np.zeros(len(ask))
    if not len(ask):
        return count, total
    width = radius
    while True:
        cell = np.floor((xyz - xyz.min(axis=0)) / width).astype(np.int64)
        _, ny, nz = (int(n) for n in cell.max(axis=0) + 1)
        keys, own, held = np.unique((cell[:, 0] * ny + cell[:, 1]) * nz + cell[:, 2], return_inverse=True, return_counts=True)
        if len(xyz) <= CELL_ROWS * len(keys) or width < radius / 128:
            break
        width /= 2
    order = np.argsort(own, kind="stable")
    begin, points = np.r_[0, np.cumsum(held)], np.ascontiguousarray(xyz[order])
    first = begin[:-1]
    low, high = np.minimum.reduceat(points, first), np.maximum.reduceat(points, first)
    middle = (low + high) / 2
    off = points - np.repeat(middle, held, axis=0)
    shift, square = np.add.reduceat(off, first), np.add.reduceat((off * off).sum(axis=1), first)
    # keys go up with x: askers look at cells of a range of them
    left, right = np.maximum.accumulate(high[:, 0]), np.minimum.accumulate(low[::-1, 0])[::-1]
    ask_cell = own[ask]
    by_cell = np.argsort(ask_cell, kind="stable")
    cells, at = np.unique(ask_cell[by_cell], return_index=True)
    inner, outer = radius * radius * (1 - 1e-9), radius * radius * (1 + 1e-9)
    for c, who in zip(cells.tolist(), np.split(by_cell, at[1:]), strict=True):
        q = xyz[ask[who]]
        ql, qh = q.min(axis=0), q.max(axis=0)
        span = slice(int(np.searchsorted(left, ql[0] - radius * (1 + 1e-9))), int(np.searchsorted(right, qh[0] + radius * (1 + 1e-9), side="right")))
        a, b = low[span] - qh, ql - high[span]
        gap = np.maximum(np.maximum(a, b), 0.0)
        reach = np.maximum(high[span] - ql, qh - low[span])
        near = (gap * gap).sum(axis=1) < outer
        inside = near & ((reach * reach).sum(axis=1) < inner)
        n, s = np.zeros(len(q), np.int64), np.zeros(len(q))
        full = np.flatnonzero(inside) + span.start
        if len(full):
            to = middle[full] - middle[c]
            many = held[full]
            moment = (shift[full] + many[:, None] * to).sum(axis=0)
            squares = (square[full] + 2 * (shift[full] * to).sum(axis=1) + many * (to * to).sum(axis=1)).sum()
            seen = q - middle[c]
            n += many.sum()
            s += many.sum() * (seen * seen).sum(axis=1) - 2 * seen @ moment + squares
        rim = np.flatnonzero(near & ~inside) + span.start
        many = held[rim]
        rows = points[np.arange(many.sum()) + np.repeat(first[rim] - np.cumsum(many) + many, many)].T.copy()
        step = max(1, RIM_PAIRS // max(1, rows.shape[1]))
        for lo in range(0, len(q), step):
            d2 = 0.0
            for k in range(3):
                d = q[lo : lo + step, k, None] - rows[k]
                d *= d
                d2 = d2 + d if k else d
            hit = d2 < radius * radius
            n[lo : lo + step] += np.count_nonzero(hit, axis=1)
            s[lo : lo + step] += np.einsum("ij,ij->i", d2, hit)
        count[who], total[who] = n, s
    return count, total


def radius_sums(points: DataFrame, radius: float) -> DataFrame:
    """(cloud_id, pid, n, sum_d2): how many points lie strictly inside the radius of each point, itself included, and the sum of their squared
    distances; what ``radius_pairs`` grouped by point gives, without its pairs.

    Points are dealt to blocks with a margin of the radius, and each block is summed by itself, in order of id: a point's sum follows from the points of
    its block and the margin alone, to the last bit, whatever else the table holds.
    """
    if not radius > 0:
        raise ValueError("radius must be positive")
    kind = {f.name: f.dataType for f in points.schema}
    dealt = points.where(SOUND).select("cloud_id", "pid", "x", "y", "z", *_cells(radius))
    home = F.lit(True)
    for c in "xyz":
        # as a grid's cell is as wide as the radius, what lies inside it is a cell away at most
        dealt = dealt.withColumn(f"_b{c}", F.explode(F.array_distinct(F.array(*(F.floor((F.col(f"_{c}") + k) / SUM_SIDE) for k in (-1, 1))))))
        home = home & (F.col(f"_b{c}") == F.floor(F.col(f"_{c}") / SUM_SIDE))
    block = ["cloud_id", "_bx", "_by", "_bz"]
    dealt = dealt.select(*block, "pid", "x", "y", "z", home.alias("_home")).repartition(_parts(points), *block)
    out = T.StructType([T.StructField(c, kind[c]) for c in ("cloud_id", "pid")]).add("n", T.LongType()).add("sum_d2", T.DoubleType())

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).sort_by("pid").combine_chunks()
        ask = np.flatnonzero(table["_home"].to_numpy())
        if not len(ask):
            return
        n, s = sums_inside(np.column_stack([table[c].to_numpy() for c in "xyz"]), ask, radius)
        at = pa.array(ask)
        yield from pa.table([table["cloud_id"].take(at), table["pid"].take(at), pa.array(n), pa.array(s)], names=out.names).to_batches(max_chunksize=BLOCK_ROWS)

    return dealt.groupBy(*block).applyInArrow(summed, out)


def _ranked(near: DataFrame, knn: int) -> DataFrame:
    order = Window.partitionBy("cloud_id", "pid").orderBy("d2", "nbr")
    return near.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= knn).select("cloud_id", "pid", "nbr", "rk", "d2")


def crowding(points: DataFrame, radius: float) -> float:
    """The number of points in a point's cell, averaged over points."""
    cells = points.select("cloud_id", *_cells(radius)).groupBy("cloud_id", "_x", "_y", "_z").count()
    row = cells.agg(F.sum(F.col("count") * F.col("count")).alias("s"), F.sum("count").alias("n")).first()
    return (row["s"] or 0) / (row["n"] or 1)


def _levelled(points: DataFrame, radius: float, knn: int, top: int) -> DataFrame:
    """Sound points with their finest cell (_x, _y, _z) and ``lvl``, the level whose radius holds ``knn`` of them.

    The radius of level k is ``radius`` / 2^(top - k), and its cells are so narrow that all of a cell is strictly inside that radius of each
    of its points: the level is the first whose cell holds ``knn``, else the last.
    """
    width = radius / 2**top / math.sqrt(3) * (1 - 1e-6)
    sound = points.where(SOUND)
    placed = sound.select("*", *_cells(width))
    if not top:
        return placed.withColumn("lvl", F.lit(0))
    finest = ["cloud_id", "_x", "_y", "_z"]
    up = lambda k: [F.shiftright(c, k) for c in finest[1:]]
    # dealt by the coarsest cell, so that the counts of all levels need one exchange
    cells = placed.groupBy(*finest).agg(F.count("*").alias("_n")).withColumns(dict(zip(("_tx", "_ty", "_tz"), up(top), strict=True)))
    cells = cells.repartition(_parts(points), "cloud_id", "_tx", "_ty", "_tz")
    for k in range(top):
        cells = cells.withColumn(f"_n{k}", F.sum("_n").over(Window.partitionBy("cloud_id", "_tx", "_ty", "_tz", *up(k))))
    level = F.coalesce(*(F.when(F.col(f"_n{k}") >= knn, k) for k in range(top)), F.lit(top))
    return placed.join(cells.select(*finest, level.alias("lvl")), finest)


def _parts(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * df.sparkSession.sparkContext.defaultParallelism)


def _first(who: np.ndarray, to: np.ndarray, d2: np.ndarray, count: np.ndarray, knn: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and ranks from 0 of the ``knn`` least by (d2, to) of each asker, whose ``count`` rows stand together.

    Askers of about as many rows are sorted side by side, by id and then by distance, which leaves ties as they are.
    """
    start, rows = np.cumsum(count) - count, np.flatnonzero(count)
    width = int(count.max(initial=0))
    column = np.arange(len(who)) - start[who]
    if len(rows) * width > 4 * len(who):
        by = np.lexsort((to, d2, who))
        least = column < knn
        return by[least], column[least]
    few = min(knn, width)
    at = (np.repeat(np.arange(len(rows)), count[rows]), column)
    ids, far = np.full((len(rows), width), np.iinfo(np.int64).max), np.full((len(rows), width), np.inf)
    ids[at], far[at] = to, d2
    by_id = np.argsort(ids, axis=1)
    by = np.argsort(np.take_along_axis(far, by_id, axis=1), axis=1, kind="stable")[:, :few]
    places = start[rows][:, None] + np.take_along_axis(by_id, by, axis=1)
    held = np.arange(few) < count[rows][:, None]
    return places[held], np.broadcast_to(np.arange(few), held.shape)[held]


def nearest_few(xyz: np.ndarray, ask: np.ndarray, radius: float, knn: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(asker, neighbour, rank, squared distance): up to ``knn`` rows of ``xyz`` nearest to each of its rows ``ask``, strictly inside the radius, of ties the lower row.

    Parts of the radius are tried first: who has ``knn`` inside of one needs no more.
    """
    for share in (4, 2, 1):
        if not len(ask):
            return
        reach = radius / share
        cell = np.floor((xyz - xyz.min(axis=0)) / reach).astype(np.int64) + 1
        _, ny, nz = (int(n) for n in cell.max(axis=0) + 2)
        key = (cell[:, 0] * ny + cell[:, 1]) * nz + cell[:, 2]
        order = np.argsort(key, kind="stable")
        by_key = key[order]
        rows = key[ask][:, None] + np.array([(i * ny + j) * nz for i in (-1, 0, 1) for j in (-1, 0, 1)])
        low, high = np.searchsorted(by_key, rows - 1), np.searchsorted(by_key, rows + 1, side="right")
        size = (high - low).sum(axis=1)
        todo, total, at = [], np.cumsum(size), 0
        while at < len(ask):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
            many = (high - low)[at:end].ravel()
            to = order[np.arange(many.sum()) + np.repeat(low[at:end].ravel() - np.cumsum(many) + many, many)]
            who = np.repeat(np.arange(end - at), size[at:end])
            gap = xyz[ask[at:end]][who] - xyz[to]
            d2 = gap[:, 0] * gap[:, 0] + gap[:, 1] * gap[:, 1] + gap[:, 2] * gap[:, 2]
            inside = d2 < reach * reach
            found = np.bincount(who[inside], minlength=end - at)
            done = found >= (knn if share > 1 else 0)
            todo.append(ask[at:end][~done])
            inside &= done[who]
            who, to, d2 = who[inside], to[inside], d2[inside]
            first, rank = _first(who, to, d2, np.where(done, found, 0), knn)
            yield ask[at:end][who[first]], to[first], rank + 1, d2[first]
            at = end
        ask = np.concatenate(todo)


#: Of a block's points, sorted by id: columns made of (asker, neighbour, rank, squared distance), rows of an asker in one call.
Made = Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray], list[pa.Array]]


def by_blocks(points: DataFrame, radius: float, knn: int, columns: tuple[str, ...], made: Made, out: T.StructType) -> DataFrame:
    """What ``made`` makes of the neighbourhoods: up to ``knn`` nearest inside the radius, itself included, ties by id.

    Where a cloud is crowded a point is searched inside a part of the radius that is sure to hold ``knn`` points.  Points are dealt to blocks of cells of that
    size, with the margin that their neighbours may lie in, and each block is searched by itself: points are exchanged, pairs are not,
    and the number of pairs looked at grows with the number of points.
    """
    if not radius > 0:
        raise ValueError("radius must be positive")
    top = max(0, math.floor(math.log2(max(1.0, crowding(points, radius) / (3 * knn))) / 2))
    columns = list(dict.fromkeys(["cloud_id", "pid", "x", "y", "z", *columns]))
    placed = _levelled(points.select(*columns), radius, knn, top)
    block = ["cloud_id", "lvl", "_bx", "_by", "_bz"]
    if top:
        placed = stored(placed)
    dealt = placed.withColumnRenamed("lvl", "_own").withColumn("lvl", F.explode(F.array(*(F.lit(k) for k in range(top + 1)))))
    home = F.col("lvl") == F.col("_own")
    for c in "xyz":
        at = F.expr(f"shiftright(_{c}, lvl)")
        # a radius is less than two cells
        dealt = dealt.withColumn(f"_b{c}", F.explode(F.array_distinct(F.array(*(F.floor((at + k) / SIDE) for k in (-MARGIN, MARGIN))))))
        home = home & (F.col(f"_b{c}") == F.floor(at / SIDE))
    dealt = dealt.withColumn("_home", home)
    if top:
        asked = [F.floor(F.expr(f"shiftright(_{c}, lvl)") / SIDE).alias(f"_b{c}") for c in "xyz"]
        dealt = dealt.join(stored(placed.select("cloud_id", "lvl", *asked).distinct()), block, "left_semi")
    dealt = dealt.select(*block, "_home", *columns[1:]).repartition(_parts(points), *block)

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).sort_by("pid").combine_chunks()
        ask = np.flatnonzero(table["_home"].to_numpy())
        reach = radius / 2 ** (top - table["lvl"][0].as_py())
        for who, to, rank, d2 in nearest_few(np.column_stack([table[c].to_numpy() for c in "xyz"]), ask, reach, knn):
            yield from pa.table(made(table, who, to, rank, d2), names=out.names).to_batches(max_chunksize=1 << 16)

    return dealt.groupBy(*block).applyInArrow(few, out)


def neighborhoods(points: DataFrame, radius: float, knn: int, carry: tuple[str, ...] = (), own: tuple[str, ...] = ()) -> DataFrame:
    """(cloud_id, pid, nbr, rk, d2): up to ``knn`` nearest inside the radius, itself included, ties by id.

    ``carry`` adds columns of the neighbour by their names, ``own`` those of the point behind ``own_``, so that what follows needs no join by
    pairs; a point's rows come from one task.
    """
    kind = {f.name: f.dataType for f in points.schema}
    fields = {"cloud_id": kind["cloud_id"], "pid": kind["pid"], "nbr": kind["pid"], "rk": T.IntegerType(), "d2": T.DoubleType()}
    fields |= {c: kind[c] for c in carry} | {f"own_{c}": kind[c] for c in own}

    def rows(table: pa.Table, who: np.ndarray, to: np.ndarray, rank: np.ndarray, d2: np.ndarray) -> list[pa.Array]:
        at, end = pa.array(who), pa.array(to)
        ids = [table["cloud_id"].take(at), table["pid"].take(at), table["pid"].take(end)]
        return [*ids, pa.array(rank.astype(np.int32)), pa.array(d2), *(table[c].take(end) for c in carry), *(table[c].take(at) for c in own)]

    return by_blocks(points, radius, knn, (*carry, *own), rows, T.StructType([T.StructField(c, t) for c, t in fields.items()]))


def narrow(neighbors: DataFrame, radius: float, knn: int) -> DataFrame:
    """A smaller neighbourhood out of a wider one: a prefix of its ranks up to and including the radius."""
    return neighbors.where((F.col("rk") <= knn) & (F.col("d2") <= F.lit(radius * radius)))


def nearest(source: DataFrame, target: DataFrame, vector: str = "v", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Nearest targets of sources and nearest sources of targets, (pair_id, s, t, d2) each, from (pair_id, id, vector).

    Descriptors with a null or NaN component have no match; ties go to the smallest id.
    """
    backward = search(target, source, vector, block=block).rows
    return nearest_targets(source, target, vector, block), backward.select("pair_id", F.col("nbr").alias("s"), F.col("id").alias("t"), "d2")


def nearest_targets(source: DataFrame, target: DataFrame, vector: str = "v", block: int = BLOCK) -> DataFrame:
    """The first of the two that ``nearest`` gives."""
    return search(source, target, vector, block=block).rows.select("pair_id", F.col("id").alias("s"), F.col("nbr").alias("t"), "d2")


def exists_within(source: DataFrame, target: DataFrame, radius: float, vector: str = "v", block: int = BLOCK) -> DataFrame:
    """Sources with a target strictly inside the radius in descriptor space; a source leaves the search as soon as it has one."""
    found = search(source, target, vector, within=radius, block=block).rows
    return source.join(found.select("pair_id", "id"), ["pair_id", "id"], "left_semi")


def approximate_nearest(source: DataFrame, target: DataFrame, eps: float, vector: str = "v", block: int = BLOCK) -> DataFrame:
    """(pair_id, s, t, d2): for each source a target at most 1 + eps times as far as its nearest."""
    return search(source, target, vector, eps=eps, block=block).rows.select("pair_id", F.col("id").alias("s"), F.col("nbr").alias("t"), "d2")


def distances(pairs: DataFrame, kind: str, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs with the distance of two columns under a metric: l1, l2, l2_simple (squared), so2, so3."""
    return pairs.withColumn("distance", F.expr(metric(kind, a, b)))
