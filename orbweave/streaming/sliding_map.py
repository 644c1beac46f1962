"""A sliding map over a stream of points: kept near a moving centre, dropped outside a box around it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "cloud_id string, pid long, x double, y double, z double, action string"
STATE = "pids array<long>, xs array<double>, ys array<double>, zs array<double>"


def slide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, half: float) -> Iterator[pd.DataFrame]:
    """Adds a batch's points, takes away removed ones and those outside the box about the batch's last centre.

    Rows: kind 'add', 'remove' or 'centre'; a point that is added again moves.
    """
    held = {p: xyz for p, *xyz in zip(*state.get, strict=True)} if state.exists else {}
    out = []
    rows = pd.concat(list(frames)).sort_values("seq")
    for r in rows.itertuples():
        if r.kind == "add":
            held[r.pid] = [r.x, r.y, r.z]
            out.append((key[0], r.pid, r.x, r.y, r.z, "added"))
        elif r.kind == "remove" and r.pid in held:
            out.append((key[0], r.pid, *held.pop(r.pid), "removed"))
    centres = rows[rows["kind"] == "centre"]
    if len(centres):
        at = centres.iloc[-1][["x", "y", "z"]].to_list()
        for p in [p for p, xyz in held.items() if max(abs(a - b) for a, b in zip(xyz, at, strict=True)) > half]:
            out.append((key[0], p, *held.pop(p), "evicted"))
    ids = sorted(held)
    state.update((ids, *([held[p][k] for p in ids] for k in range(3))))
    yield pd.DataFrame(out, columns=["cloud_id", "pid", "x", "y", "z", "action"])


def sliding_map(stream: DataFrame, half: float) -> DataFrame:
    """Changes of each cloud's map, from a stream (cloud_id, seq, kind, pid, x, y, z); state is what lies in the box."""
    return stream.groupBy("cloud_id").applyInPandasWithState(lambda k, f, s: slide(k, f, s, half), OUT, STATE, "append", GroupStateTimeout.NoTimeout)
