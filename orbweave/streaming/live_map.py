"""A live map of points: a stream of points that come, move and go, and of boxes that are cleared or kept.

The state of a cloud is dealt over ``buckets`` keys by a hash of the point's id, so that a cloud is held and changed by many tasks,
and a point that moves or goes is found where it was put.  In a bucket, points lie in cubic cells, each an entry of a map state
of its own, and a directory of ids, in entries of up to ``SLOT`` neighbouring ids, tells a point's cell.  A batch reads and writes only
the entries that it touches: a box that is cleared those that it meets, a box that is kept those that are not inside it.  A box that comes again in
a batch looks only at points that came since it did, as it has judged all others.

Rows of the stream: (cloud_id, seq, kind, pid, x, y, z, x2, y2, z2).

* ``add``: the point pid is at x, y, z from now on, also if it was elsewhere before.
* ``remove``: the point pid goes; nothing happens if there is none.
* ``remove_inside``: points in the box from (x, y, z) to (x2, y2, z2) go, faces included.
* ``remove_outside``: points outside that box go.

Rows act in the order of seq in a batch, ties by kind and pid, and batches in the order in which they come, so that a stream in order of seq has
one result however it is cut into batches.  Rows of another kind, without a cloud, without a seq, with a null or NaN coordinate that they need, and
points without an id do nothing.  Changes are (cloud_id, pid, x, y, z, seq, action): ``added`` and ``moved`` with the new place, ``removed`` and
``evicted`` with the last one.  Repeated additions at the same place change nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

OUT = "cloud_id string, pid long, x double, y double, z double, seq long, action string"
SLOT = 1 << 14
#: Rows that are looked at or given back at a time, and points that came since a box, beyond which it is forgotten.
ROWS, CAME = 1 << 14, 1 << 17
KINDS = ["add", "remove", "remove_inside", "remove_outside"]
_STORE = "spark.sql.streaming.stateStore.providerClass"


class Keeper(StatefulProcessor):
    """The map of one bucket of a cloud."""

    def __init__(self, cell: float):
        if not cell > 0:
            raise ValueError("cells must have a width")
        self.cell = cell

    def init(self, handle) -> None:
        self.cells = handle.getMapState("cells", "cx long, cy long, cz long", "pids array<long>, xs array<double>, ys array<double>, zs array<double>")
        self.slots = handle.getMapState("slots", "slot long", "pids array<long>, cx array<long>, cy array<long>, cz array<long>")

    def close(self) -> None:
        pass

    # entries are read when they are touched and written at the end of a batch

    def _points(self, cell: tuple) -> dict:
        if cell not in self.held:
            got = self.cells.getValue(cell) if self.cells.containsKey(cell) else None
            self.held[cell] = {p: tuple(xyz) for p, *xyz in zip(*got, strict=True)} if got else {}
            self.was_held[cell] = got is not None
        return self.held[cell]

    def _cell(self, cell: tuple) -> tuple:
        """The same cell, held once however many points lie in it."""
        return self.names.setdefault(cell, cell)

    def _directory(self, pid: int) -> dict:
        slot = pid // SLOT
        if slot not in self.known:
            got = self.slots.getValue((slot,)) if self.slots.containsKey((slot,)) else None
            self.known[slot] = {p: self._cell(tuple(c)) for p, *c in zip(*got, strict=True)} if got else {}
            self.was_known[slot] = got is not None
        return self.known[slot]

    def _write(self) -> None:
        for held, was, state, key in ((self.held, self.was_held, self.cells, lambda k: k), (self.known, self.was_known, self.slots, lambda k: (k,))):
            for k, entry in held.items():
                if entry:
                    state.updateValue(key(k), (list(entry), *(list(c) for c in zip(*entry.values(), strict=True))))
                elif was[k]:
                    state.removeKey(key(k))

    def _every_cell(self) -> list[tuple]:
        """The cells that have points now, those of this batch included."""
        if self.stored is None:
            self.stored = [tuple(k) for k in self.cells.keys()]  # noqa: SIM118
        return [*(c for c in self.stored if c not in self.held), *(c for c, entry in self.held.items() if entry)]

    @staticmethod
    def _in_order(rows: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, int, tuple, tuple]]:
        """(kind, seq, pid, place, far corner) of a batch's rows by seq, kind and pid; held as columns, and only boxes with a far corner."""
        seq, kind, pid, place, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int8)], [np.zeros(0, np.int64)], [np.zeros((0, 3))], [np.zeros((0, 3))]
        for part in rows:
            seq.append(part["seq"].to_numpy(np.int64))
            kind.append(pd.Categorical(part["kind"], categories=KINDS).codes)
            pid.append(part["pid"].to_numpy(np.int64))
            place.append(part[["x", "y", "z"]].to_numpy(np.float64))
            far.append(part[["x2", "y2", "z2"]].to_numpy(np.float64)[kind[-1] >= 2])
        seq, kind, pid, place, far = map(np.concatenate, (seq, kind, pid, place, far))
        boxes, order = np.flatnonzero(kind >= 2), np.lexsort((pid, kind, seq))
        for lo in range(0, len(order), ROWS):
            at = order[lo : lo + ROWS]
            box = np.searchsorted(boxes, at).tolist()
            for k, s, p, here, b in zip(kind[at].tolist(), seq[at].tolist(), pid[at].tolist(), place[at].tolist(), box, strict=True):
                yield KINDS[k], s, p, tuple(here), tuple(far[b].tolist()) if k >= 2 else ()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.held, self.was_held, self.known, self.was_known, self.stored, self.names = {}, {}, {}, {}, None, {}
        cloud, out, w = key[0], [], self.cell
        changes = lambda: pd.DataFrame(out, columns=["cloud_id", "pid", "x", "y", "z", "seq", "action"])
        # cells and ids of points that came in this batch, without the first ``gone``; how many had come when a box was last looked at
        came, gone, judged = [], 0, {}
        for kind, seq, pid, here, far in self._in_order(rows):
            if len(out) >= ROWS:
                yield changes()
                out = []
            if len(came) >= CAME:
                # boxes of long ago are looked at in full when they come again
                del came[: CAME // 2]
                gone += CAME // 2
                judged = {b: k for b, k in judged.items() if k >= gone}
            if kind == "add":
                cell = self._cell(tuple(math.floor(v / w) for v in here))
                places = self._directory(pid)
                old = places.get(pid)
                if old is not None:
                    if self._points(old)[pid] == here:
                        continue
                    del self._points(old)[pid]
                self._points(cell)[pid] = here
                places[pid] = cell
                came.append((cell, pid))
                out.append((cloud, pid, *here, seq, "added" if old is None else "moved"))
            elif kind == "remove":
                old = self._directory(pid).pop(pid, None)
                if old is not None:
                    out.append((cloud, pid, *self._points(old).pop(pid), seq, "removed"))
            else:
                low, high, inside = here, far, kind == "remove_inside"
                box, hit = (inside, low, high), lambda xyz: all(a <= v <= b for v, a, b in zip(xyz, low, high, strict=True)) == inside  # noqa: B023
                seen, judged[box] = judged.get(box), gone + len(came)
                if seen is not None:
                    for cell, pid in came[seen - gone :]:
                        points = self._points(cell)
                        if pid in points and hit(points[pid]):
                            out.append((cloud, pid, *points.pop(pid), seq, "evicted"))
                            del self._directory(pid)[pid]
                    continue
                for cell in self._every_cell():
                    # widened by a little, for coordinates that rounding puts into the next cell
                    apart = any((c + 1) * w + 1e-9 * w < a or c * w - 1e-9 * w > b for c, a, b in zip(cell, low, high, strict=True))
                    within = all(c * w - 1e-9 * w >= a and (c + 1) * w + 1e-9 * w <= b for c, a, b in zip(cell, low, high, strict=True))
                    if apart if inside else within:
                        continue
                    points = self._points(cell)
                    for pid, xyz in list(points.items()):
                        if hit(xyz):
                            out.append((cloud, pid, *points.pop(pid), seq, "evicted"))
                            del self._directory(pid)[pid]
        self._write()
        yield changes()


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Map states need the RocksDB store; a query keeps the store that it was started with."""
    old = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, old)


def live_map(stream: DataFrame, cell: float, buckets: int = 64) -> DataFrame:
    """Changes of each cloud's map.  Boxes go to every bucket, other rows to the one of their point."""
    numbers = lambda *names: F.expr(" AND ".join(f"{n} IS NOT NULL AND NOT isnan({n})" for n in names))
    box = F.col("kind").isin("remove_inside", "remove_outside")
    sound = F.col("cloud_id").isNotNull() & F.col("seq").isNotNull() & F.when(box, numbers("x", "y", "z", "x2", "y2", "z2")).when(F.col("kind") == "add", F.col("pid").isNotNull() & numbers("x", "y", "z") & F.expr("greatest(abs(x), abs(y), abs(z)) < 1e15")).when(F.col("kind") == "remove", F.col("pid").isNotNull()).otherwise(False)
    rows = stream.where(F.coalesce(sound, F.lit(False))).select(F.col("cloud_id").cast("string").alias("cloud_id"), F.col("seq").cast("long").alias("seq"), "kind", F.coalesce(F.col("pid").cast("long"), F.lit(0).cast("long")).alias("pid"), *(F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "x2", "y2", "z2")))
    own = F.array(F.pmod(F.xxhash64("pid"), F.lit(buckets)).cast("int"))
    dealt = rows.withColumn("bucket", F.explode(F.when(box, F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(own)))
    return dealt.groupBy("cloud_id", "bucket").transformWithStateInPandas(Keeper(cell), OUT, "append", "none")


def standing(changes: DataFrame) -> DataFrame:
    """(cloud_id, pid, x, y, z): the map that a table of changes leads to.

    A point has several changes of one seq only if rows of the stream share a seq; a removal is then the last.
    """
    gone = F.col("action").isin("removed", "evicted")
    last = changes.groupBy("cloud_id", "pid").agg(F.max_by(F.struct("x", "y", "z", "action"), F.struct("seq", gone.alias("gone"), "x", "y", "z")).alias("m"))
    return last.where(~F.col("m.action").isin("removed", "evicted")).select("cloud_id", "pid", "m.x", "m.y", "m.z")
