"""Hard negatives by one-dimensional distance keys.

Vectors are integers, floor(scale * x).  With one more component that makes every vector as long as the longest, M, the rows with the
largest inner products with an anchor (augmented by 0) are its nearest: |a - x|^2 = |a|^2 + M^2 - 2 a.x.  Each row is keyed
by its nearest pivot and its distance from it, and rows are stored sorted by (pivot, distance).  By the triangle inequality a row
in an annulus, an interval of keys, lies no nearer to the anchor than the anchor's own distance from the pivot lets it, so
an annulus has a largest possible score.

A search visits annuli in the order of that bound, in rounds whose number of rows grows ``GROWTH`` fold, and compares whole
annuli with blocks of anchors.  After a round each anchor knows its k-th best score; where no annulus is left whose bound reaches it,
the result is proved and the anchor is done.  The last round visits whatever is still open, so results are exact.  Positives are the
first rows of an anchor's label; negatives are the first rows of other labels in a window of scores below each positive.

Pivots are fitted on a sample of about ``SAMPLE`` components (at least 256 rows, at most twice the rate); all rows are indexed.  There
are at most ``PIVOTS`` times ``RINGS`` annuli, the only relation that comes to the driver.  Annuli of many rows, as equal vectors make, are
dealt over parts of about ``PART`` rows by a hash of id and vector.

Rows with a null id, label or vector, or with any null or non-finite component take no part.  Shorter vectors end in zeros; components beyond
+-2^22 are cut to it, so that sums fit 64 bits.  Rows repeated in id, label and vector are one row; rows that share
an id otherwise are rows of their own, but never partners of each other.  Ties go to the smaller id.  An empty table, or one
without anchors, gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SAMPLE, PIVOTS, RINGS, PART, SLICE = 1 << 19, 256, 32, 2048, 16_384
FIRST, GROWTH = 4096, 16
MOST = 1 << 22  # of a component
FAR = 1 << 61  # beyond any score
FOUND = "anchor long, id long, win int, score long, other long"


def prepared(rows: DataFrame, anchors: Column, id_col: str, vector_col: str, label_col: Column, scale: int) -> DataFrame:
    """(id, label, q, is_anchor) of the rows that take part."""
    v, inf = F.col(vector_col), float("inf")
    fine = F.col(id_col).isNotNull() & label_col.isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < inf))
    whole = F.transform(v, lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-float(MOST))), F.lit(float(MOST)))).cast("int"))
    return rows.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), label_col.cast("long").alias("label"), whole.alias("q"), F.coalesce(anchors, F.lit(False)).alias("is_anchor")).distinct()


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Integer vectors as rows of doubles, short ones ended by zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    length = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    if len(flat) == dim * len(column) and (length == dim).all():
        return flat.reshape(-1, dim).astype(float)
    out = np.zeros((len(column), dim))
    out[np.repeat(np.arange(len(column)), length), np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    return out


def fit_pivots(sample: np.ndarray, count: int, rounds: int = 5) -> np.ndarray:
    """Means of ``count`` clusters, begun at rows evenly spread over the sample."""
    pivots = sample[np.linspace(0, len(sample) - 1, count).astype(int)].copy()
    for _ in range(rounds):
        own = ((pivots * pivots).sum(1) - 2 * sample @ pivots.T).argmin(1)
        size = np.bincount(own, minlength=count)
        sums = np.zeros_like(pivots)
        np.add.at(sums, own, sample)
        pivots[size > 0] = sums[size > 0] / size[size > 0, None]
    return pivots


class Index:
    """Rows keyed by (pivot, distance), and what is known of each annulus."""

    def __init__(self, rows: DataFrame):
        """rows: (id, label, q)."""
        norm = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x.cast("long"))
        known = rows.agg(F.count("*").alias("n"), F.max(norm).alias("top"), F.max(F.size("q")).alias("dim")).first()
        self.n, self.dim, self.longest = known["n"], max(1, known["dim"] or 1), math.sqrt(known["top"] or 0)
        dim, longest = self.dim, self.longest
        want = max(256, SAMPLE // dim)
        near = F.pmod(F.xxhash64("id", "q"), F.lit(1 << 30)) <= int((1 << 30) * min(1.0, want / max(1, self.n)))
        got = rows.where(near).select("id", "q").limit(2 * want).toPandas().sort_values("id", kind="stable")
        sample = np.zeros((max(1, len(got)), dim))
        for k, q in enumerate(got["q"]):
            sample[k, : len(q)] = q
        last = np.sqrt(np.maximum(longest**2 - (sample**2).sum(1), 0))
        self.pivots = pivots = fit_pivots(np.c_[sample, last], min(PIVOTS, max(1, math.ceil(self.n / FIRST)), len(sample)))
        length, width = (pivots * pivots).sum(1), max(2 * longest / RINGS, 1e-9)

        def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column(2), dim)
                last = np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0))
                d2 = longest**2 + length - 2 * (x @ pivots[:, :-1].T + last[:, None] * pivots[:, -1])
                own = d2.argmin(1)
                d = np.sqrt(np.maximum(d2[np.arange(len(own)), own], 0))
                ring = np.minimum((d / width).astype(np.int64), RINGS - 1)
                yield pa.RecordBatch.from_arrays([pa.array(own * RINGS + ring), pa.array(d), *batch.columns], names=["annulus", "distance", "id", "label", "q"])

        keyed = rows.select("id", "label", "q").mapInArrow(key, "annulus long, distance double, id long, label long, q array<int>")
        self.rows = stored(keyed.repartitionByRange("annulus", "distance", "id").sortWithinPartitions("annulus", "distance", "id"))
        shells = self.rows.groupBy("annulus").agg(F.count("*").alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high")).orderBy("annulus").toPandas()  # PIVOTS * RINGS at most
        self.annulus, self.count = shells["annulus"].to_numpy(np.int64), shells["n"].to_numpy(np.int64)
        self.low, self.high = shells["low"].to_numpy(float), shells["high"].to_numpy(float)
        self.parts = -(-self.count // PART)

    def parted(self) -> DataFrame:
        """The rows with seg, the number of their part of an annulus."""
        parts = self.rows.sparkSession.createDataFrame(list(zip(self.annulus.tolist(), self.parts.tolist(), strict=True)), "annulus long, parts int")
        seg = F.shiftleft("annulus", 32) + F.pmod(F.xxhash64("id", "q"), F.col("parts"))
        return self.rows.join(F.broadcast(parts), "annulus").select(seg.alias("seg"), "id", "label", "q")

    def bounds(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest and the smallest score that any row of each annulus can have with each anchor."""
        square = (a * a).sum(1)
        d2 = square[:, None] + (self.pivots * self.pivots).sum(1) - 2 * a @ self.pivots[:, :-1].T
        d = np.sqrt(np.maximum(d2, 0))[:, self.annulus // RINGS]
        slack = 1e-5 * (self.longest + np.sqrt(square))[:, None] + 1e-9  # of rounding
        near = np.maximum(np.maximum(d - self.high, self.low - d) - slack, 0)
        base = (square + self.longest**2)[:, None]
        return (base - near**2) / 2 + 1, (base - (d + self.high + slack) ** 2) / 2 - 1

    def _plan(self) -> Index:
        """Without the rows, for tasks."""
        out = object.__new__(Index)
        out.__dict__ = {k: v for k, v in self.__dict__.items() if k != "rows"}
        return out

    def search(self, wants: DataFrame, k: int, same: bool, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
        """(anchor, id, win, score, other): the first k rows of each anchor's windows, of its label or of any other.

        wants: (anchor, id, label, q, lows, highs), the windows' limits, faces included; (id, anchor) is a key.
        """
        plan, dim, spark = self._plan(), self.dim, wants.sparkSession
        slices = max(1, math.ceil(wants.count() / SLICE))
        found, begin, end = spark.createDataFrame([], FOUND), 0, first
        best = Window.partitionBy("id", "anchor", "win").orderBy(F.desc("score"), "other")
        parted = self.parted().withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

        while True:
            full = found.groupBy("id", "anchor", "win").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
            full = full.groupBy("id", "anchor").agg(F.map_from_entries(F.collect_list(F.struct("win", "least"))).alias("least"))  # one entry a window
            # where k rows are known, a window ends at the last of them
            now = F.expr("transform(lows, (x, i) -> coalesce(try_element_at(least, i), x))")
            open_ = wants.join(full, ["id", "anchor"], "left").select("anchor", "id", "label", "q", now.alias("lows"), "highs", F.pmod("anchor", F.lit(slices)).cast("int").alias("slice"))
            last = end >= self.n
            visits = stored(open_.mapInArrow(lambda b, lo=begin, hi=None if last else end: _visits(b, plan, lo, hi), "seg long, slice int, anchor long, id long, label long, q array<int>, lows array<long>, highs array<long>"))
            if not visits.isEmpty():
                needed = parted.join(visits.select("seg", "slice").distinct(), ["seg", "slice"], "left_semi")
                hits = visits.groupBy("seg", "slice").cogroup(needed.groupBy("seg", "slice")).applyInArrow(lambda a, b: _scan(a, b, dim, k, same), FOUND)
                found = stored(found.unionByName(hits).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r"))
            if last:
                return found
            begin, end = end, end * growth


def _visits(batches: Iterator[pa.RecordBatch], plan: Index, begin: int, end: int | None) -> Iterator[pa.RecordBatch]:
    """A row for each anchor and part of an annulus that is due: behind the first ``begin`` rows of its order, before ``end``."""
    for whole in batches:
        for lo in range(0, whole.num_rows, 128):
            batch = whole.slice(lo, 128)
            anchor, id_, label, q, lows, highs, piece = batch.columns
            top, bottom = plan.bounds(matrix(q, plan.dim))
            who, seg = [], []
            for i, (l, h) in enumerate(zip(lows.to_pylist(), highs.to_pylist(), strict=True)):
                reach = np.zeros(len(plan.annulus), bool)
                due = np.zeros(len(plan.annulus), bool)
                for a, b in zip(l, h, strict=True):
                    if a <= b:
                        reach |= bottom[i] <= b
                        due |= (bottom[i] <= b) & (top[i] >= a)
                order = np.flatnonzero(reach)
                order = order[np.lexsort((order, -np.minimum(top[i][order], float(max(h, default=0)))))]
                before = np.cumsum(plan.count[order]) - plan.count[order]
                order = order[(before >= begin) & due[order] if end is None else (before >= begin) & (before < end) & due[order]]
                parts = plan.parts[order]
                seg.append((np.repeat(plan.annulus[order], parts) << 32) + np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
                who.append(np.full(int(parts.sum()), i))
            who, seg = np.concatenate(who), np.concatenate(seg)
            for at in range(0, len(who), 4096):
                take = pa.array(who[at : at + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(seg[at : at + 4096].astype(np.int64)), *(c.take(take) for c in (piece, anchor, id_, label, q, lows, highs))], names=["seg", "slice", "anchor", "id", "label", "q", "lows", "highs"])


def _scan(visits: pa.Table, part: pa.Table, dim: int, k: int, same: bool) -> pa.Table:
    """The first k rows of a part for each window of its visitors."""
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    if visits.num_rows and part.num_rows:
        part = part.select(["id", "label", "q"]).sort_by("id")
        ids, labels = part["id"].to_numpy(), part["label"].to_numpy()
        x, a = matrix(part["q"], dim), matrix(visits["q"], dim)
        exact = np.abs(x).max(initial=0) * np.abs(a).max(initial=0) * dim < 2.0**52
        anchor, own, label = (visits[c].to_numpy() for c in ("anchor", "id", "label"))
        lows, highs = visits["lows"].to_pylist(), visits["highs"].to_pylist()
        step = max(1, (1 << 21) // len(ids))
        for lo in range(0, len(own), step):
            block = a[lo : lo + step]
            scores = np.rint(block @ x.T).astype(np.int64) if exact else block.astype(np.int64) @ x.astype(np.int64).T
            for i, score in enumerate(scores, lo):
                able = np.flatnonzero(((labels == label[i]) == same) & (ids != own[i]))
                score = score[able]
                for win, (least, most) in enumerate(zip(lows[i], highs[i], strict=True)):
                    at = np.flatnonzero((score >= least) & (score <= most))
                    if len(at) > k:
                        edge = np.partition(score[at], len(at) - k)[len(at) - k]
                        over = at[score[at] > edge]
                        at = np.r_[over, at[score[at] == edge][: k - len(over)]]  # in order of ids
                    if len(at):
                        for column, value in zip(out, (np.full(len(at), anchor[i]), np.full(len(at), own[i]), np.full(len(at), win), score[at], ids[able[at]]), strict=True):
                            column.append(value)
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    return pa.table({n: pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), t) for n, c, t in zip(("anchor", "id", "win", "score", "other"), out, kinds, strict=True)})


def mine(rows: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchors tells which rows are anchors; label is their class (column label if none is given).  For each of an anchor's first
    ``positives`` other rows of its label: the first ``negatives`` rows of other labels whose scores are between ``low`` and ``high`` per
    cent of the positive's.
    """
    ready = stored(prepared(rows, anchors, id_col, vector_col, F.col("label") if label is None else label, scale))
    index = Index(ready)
    wants = stored(ready.where("is_anchor").select(F.xxhash64("id", "label", "q").alias("anchor"), "id", "label", "q"))
    every = lambda x: F.array(F.lit(x).cast("long"))
    near = stored(index.search(wants.withColumns({"lows": every(-FAR), "highs": every(FAR)}), positives, same=True))
    order = F.row_number().over(Window.partitionBy("id", "anchor").orderBy(F.desc("score"), "other"))
    near = near.select("anchor", "id", (order - 1).alias("win"), F.col("score").alias("positive_score"), F.col("other").alias("positive_id"))
    # whole quotients, rounded into the window
    near = stored(near.withColumns({"lo": F.expr(f"({low} * positive_score + pmod(-{low} * positive_score, 100)) div 100"), "hi": F.expr(f"({high} * positive_score - pmod({high} * positive_score, 100)) div 100")}))
    windows = near.groupBy("id", "anchor").agg(F.sort_array(F.collect_list(F.struct("win", "lo", "hi"))).alias("w"))  # ``positives`` at most
    windows = wants.join(windows, ["id", "anchor"]).select("anchor", "id", "label", "q", F.col("w.lo").alias("lows"), F.col("w.hi").alias("highs"))
    far = index.search(windows, negatives, same=False)
    rank = F.row_number().over(Window.partitionBy("id", "anchor", "win").orderBy(F.desc("score"), "other"))
    far = far.withColumn("rank", rank).join(near, ["id", "anchor", "win"])
    return far.select(F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: The same for the driver's table, all pairs of anchors and rows.
SQL = """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS n FROM s WHERE same) AS o WHERE n <= 5),
w AS (SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
 FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same WHERE 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM w WHERE rank <= 10"""
