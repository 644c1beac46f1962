"""Shared parts: checkpoints, Arrow text views, word hashing and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import cut, stored  # noqa: F401

#: A word, as the contracts define it: a run of characters other than space, \t, \n, \v, \f and \r.
WORD = r"[^\x20\x09-\x0D]+"

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; a null is an empty row.  No copy of the text is made."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n, at = len(column), column.offset
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[at : at + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(offsets: np.ndarray, most: int = 1 << 21):
    """Row ranges of about ``most`` bytes (one row at least), so that temporaries stay small."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


_POW: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POW.get(int(base))
    if have is None or len(have) < n:
        grown = np.full(max(n, 1 << 12), base, np.uint64)
        grown[0] = 1
        have = _POW[int(base)] = np.cumprod(grown, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _MULT
    h = h ^ (h >> np.uint64(29))
    h = h * _STEP
    return h ^ (h >> np.uint64(32))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words of some rows, and each row's first word number (one more at the end)."""
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    before = np.empty_like(solid)
    after = np.empty_like(solid)
    if len(solid):
        before[0], before[1:] = False, solid[:-1]
        after[-1], after[:-1] = False, solid[1:]
        edges = offsets[:-1][np.diff(offsets) > 0]
        before[edges] = False
        after[offsets[1:][np.diff(offsets) > 0] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    total = int(length.sum())
    first = np.cumsum(length) - length
    inside = np.arange(total) - np.repeat(first, length)
    at = inside + np.repeat(starts, length)
    terms = (data[at].astype(np.uint64) + np.uint64(1)) * powers(_BASE, int(length.max()))[inside]
    return mix(np.add.reduceat(terms, first) + length.astype(np.uint64) * _MULT)


class Rolling:
    """Hashes of word ranges of one sequence from prefix sums, each in constant time."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.up = powers(_STEP, n + 1)
        self.down = powers(np.uint64(pow(int(_STEP), -1, 1 << 64)), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * self.up[:n], out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.down[lo] + (hi - lo).astype(np.uint64) * _MULT)


def other_key(column: str) -> Column:
    """A long column under another name and value: a join by it deals both sides anew, also where one is an aggregate by
    the column itself, and adaptive execution can then split a crowded key."""
    return F.col(column).bitwiseXOR(F.lit(1).cast("long")).alias("key")


#: A key of at most so many rows is never dealt over salts.
EVEN = 100


def hot_keys(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame | None:
    """(keys, salts) of the keys that hold more rows than an even share of a shuffle partition; None if there are none.

    counts: one row for each key, with its number of rows.  There are fewer hot keys than shuffle partitions, whatever the
    input, so they can be broadcast.
    """
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    even = max(EVEN, (counts.agg(F.sum(n)).first()[0] or 0) // parts)
    hot = stored(counts.where(F.col(n) > even).select(*keys, F.ceil(F.col(n) / even).cast("int").alias("__salts")))
    return None if hot.isEmpty() else hot


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], hot: DataFrame | None, spread: list[str], how: str = "inner") -> DataFrame:
    """``many`` joined to ``one``, the rows of a hot key dealt over its salts by a hash of ``spread`` and the rows of ``one`` given
    to each salt.  The columns of ``hot`` but the last are among ``keys``."""
    if hot is None:
        return many.join(one, keys, how)
    by = hot.columns[:-1]
    own = F.pmod(F.xxhash64(*spread), F.coalesce("__salts", F.lit(1))).cast("int")
    left = many.join(F.broadcast(hot), by, "left").withColumn("__salt", own).drop("__salts")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))
    right = one.join(F.broadcast(hot), by, "left").withColumn("__salt", every).drop("__salts")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def least_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of some edges, sorted, and the smallest node that each reaches along them."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    left, right = at[: len(u)], at[len(u) :]
    labels = np.arange(len(names))
    while True:
        low = np.minimum(labels[left], labels[right])
        if (low == labels[left]).all() and (low == labels[right]).all():
            return names, names[labels]
        for side in (left, right):  # also the label itself gets the lower one, so that whole trees are hung up
            np.minimum.at(labels, labels[side], low)
            np.minimum.at(labels, side, low)
        labels = labels[labels]


#: Edges that a task joins at a time before they are dealt out, and rows of two longs up to which a side of a join is broadcast.
EDGES, BROADCAST_ROWS = 1 << 20, 1_000_000


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (u, v, longs) reaches.

    Each task first joins what it has of the edges, so that it sends a node once, however many edges the node has.  A round
    replaces each node's parent by the parent's own (a join that adaptive execution can split at a parent of very many
    nodes), deals the rows by node and joins the trees that meet in a task, always to the smaller root.  A row that a task makes for
    a node dealt elsewhere is a link for the next round.  Parents are smaller than their nodes, so when nothing moves each node
    hangs on the smallest of its component.  The number of rounds grows with the logarithm of a component's diameter.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out():
            names, roots = least_labels(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(roots), pa.array(np.zeros(len(names), bool))], names=["node", "root", "moved"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(u) for u, _ in held) >= EDGES:
                yield out()
                held = []
        if held:
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if not held:
            return
        node, root, moved = (np.concatenate(x) for x in zip(*held, strict=True))
        names, roots = least_labels(node, root)
        changed = np.zeros(len(names), bool)
        changed[np.searchsorted(names, node[moved | (roots[np.searchsorted(names, node)] != root)])] = True
        own = np.zeros(len(names), bool)
        own[np.searchsorted(names, node)] = True
        keep = own | (names != roots)
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (names, roots, own, changed | ~own)], names=["node", "root", "own", "moved"])

    kind = "node long, root long, own boolean, moved boolean"
    # stored, so that a task that makes edges in Python doesn't keep a second worker for them
    rows = stored(edges.select("u", "v").where("u != v")).mapInArrow(gather, "node long, root long, moved boolean")
    forest = stored(rows.repartition("node").mapInArrow(merge, kind))
    few = forest.count() <= BROADCAST_ROWS
    for _ in range(rounds):
        parents = forest.where("own").select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = forest.join(F.broadcast(parents) if few else parents, "root")
        jumped = jumped.select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved"))
        forest = stored(jumped.repartition("node").mapInArrow(merge, kind))
        if forest.where("moved").isEmpty():
            return forest.select("node", "root")
    raise RuntimeError(f"components: no fixpoint after {rounds} rounds")
