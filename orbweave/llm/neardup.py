"""Near-duplicate groups by word shingles: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

SimHash fingerprints differ in about ten of 64 bits at that similarity, far beyond what a covering reaches, so candidates
come from MinHash bands: ``BANDS`` bands of ``ROWS`` minima.  A pair at the threshold is missed with probability
(1 - 0.8**ROWS)**BANDS, about 3 in a million, a closer pair less.  Texts that share a band are joined to candidate groups, and
within a group the shingle sets themselves are compared, so no pair below the threshold is linked.

Words and shingles are those of SimHash: ASCII lower case, and a text of fewer words than a shingle is one shingle.  Texts
with equal sets, also those without words, are one node.  Null is an empty text.

A candidate group of up to ``GROUP_WORDS`` shingles (or four even shares of a partition, if that is less) is compared in one
task.  A larger one is first thinned out by pivots, a few of its sets: sets similar to a pivot are linked to it.  As one minus
the similarity is a metric, a set that is closer to a pivot than the nearest set not similar to it by more than the
threshold has partners only among those linked to that pivot, and is done with.  What is left after ``ROUNDS`` rounds, or after
one that was done with less than a quarter of the shingles, and still too large is dealt to blocks, and each pair of blocks is compared in a task of its own.  No link is lost by either.

An empty table has no groups; of a group the smallest id stays, of rows that repeat an id and a text one; very long texts are read whole; extra
columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Rolling, components, hot_keys, mix, other_key, pieces, salted_join, stored, utf8, word_hashes, word_spans
from .simhash import rows_of_least

SHINGLE, SHARE = 5, (4, 5)  #: similarity of at least SHARE[0] / SHARE[1]
BANDS, ROWS = 24, 4
GROUP_WORDS, LEAST_WORDS = 1 << 22, 1 << 16  #: shingles of a group that one task compares: at most, and at least
PIVOTS, ROUNDS = 4, 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingle_sets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and the rows' offsets."""
    low = _LOWER[data]
    starts, ends, first = word_spans(low, off)
    words = np.diff(first)
    count = np.where(words > 0, np.maximum(words - SHINGLE + 1, 1), 0)
    owner = np.repeat(np.arange(len(words)), count)
    lo = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[:-1][owner]
    h = Rolling(word_hashes(low, starts, ends)).of(lo, np.minimum(lo + SHINGLE, first[1:][owner]))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.r_[0, np.cumsum(np.bincount(owner[new], minlength=len(words)))].astype(np.int64)


def nodes_of(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(mix(h), dtype=np.uint64)]
    return mix(sums[off[1:]] - sums[off[:-1]] + np.diff(off).astype(np.uint64)).view(np.int64)


def bands_of(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(rows, BANDS) keys; zero where a set is empty."""
    full = np.flatnonzero(np.diff(off))
    out = np.zeros((len(off) - 1, BANDS), np.uint64)
    for band in range(BANDS if len(full) else 0):
        key = np.full(len(full), band + 1, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            key = mix(key ^ np.minimum.reduceat(h * _TIMES[k] + _PLUS[k], off[full]))
        out[full, band] = key
    return out.view(np.int64)


def similar(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each set, the first set of its component under the threshold.

    Each set is compared once with all sets not yet reached, by counting shared shingles; sets reached leave the index when
    half are gone."""
    n, size = len(off) - 1, np.diff(off)
    label = np.full(n, -1)
    left, live = n, 0

    def index() -> tuple[np.ndarray, np.ndarray]:
        open_ = np.repeat(label < 0, size)
        keys, who = h[open_], np.repeat(np.arange(n), size)[open_]
        order = np.argsort(keys, kind="stable")
        return keys[order], who[order]

    for seed in range(n):
        if label[seed] >= 0:
            continue
        label[seed], queue = seed, [seed]
        left -= 1
        while queue and left:
            if 2 * left <= live or not live:
                keys, who = index()
                live = left
            k = queue.pop()
            mine = h[off[k] : off[k + 1]]
            lo, hi = np.searchsorted(keys, mine), np.searchsorted(keys, mine, side="right")
            count = hi - lo
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
            other, shared = np.unique(who[at], return_counts=True)
            near = (label[other] < 0) & (shared * sum(SHARE) >= SHARE[0] * (size[other] + size[k]))
            label[other[near]] = seed
            left -= int(near.sum())
            queue.extend(other[near].tolist())
    return label


def _compare(table: pa.Table) -> pa.Table:
    names, pick = np.unique(table["node"].to_numpy(), return_index=True)
    chosen = table["shingles"].combine_chunks().take(pa.array(pick))
    off = chosen.offsets.to_numpy().astype(np.int64)
    h = chosen.values.to_numpy().view(np.uint64)[off[0] : off[-1]]
    label = similar(h, off - off[0])
    return pa.table({"node": names, "root": names[label]})


def settled(rows: DataFrame, hot: DataFrame | None, turn: int) -> tuple[DataFrame, DataFrame]:
    """Links (node, root) of sets to the pivots of their group, and the rows that may have partners that no pivot connects.

    What is broadcast has one row for each group, of at most PIVOTS longs or doubles; sets themselves are never broadcast."""
    every = range(PIVOTS)
    bucket = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(PIVOTS))
    rank = F.struct(F.xxhash64(F.lit(turn), "node").alias("rank"), "node")
    chosen = rows.groupBy("near").agg(*(F.min(F.when(bucket == k, rank)).alias(f"p{k}") for k in every))
    chosen = chosen.select("near", F.array(*(F.col(f"p{k}.node") for k in every)).alias("chosen"))
    pivots = rows.join(F.broadcast(chosen), "near").where(F.coalesce(F.array_contains("chosen", F.col("node")), F.lit(False)))
    pivots = pivots.groupBy("near").agg(F.collect_set(F.struct("node", "shingles")).alias("pivots"))  # PIVOTS rows a group; repeated rows are one

    def mark(p):
        shared, total = F.size(F.array_intersect("shingles", p["shingles"])), F.size("shingles") + F.size(p["shingles"])
        return F.struct(p["node"].alias("pivot"), (shared * sum(SHARE) >= total * SHARE[0]).alias("close"), (1 - shared / (total - shared)).alias("far"))

    marked = stored(salted_join(rows, stored(pivots), ["near"], hot, ["node"]).select("near", "node", "shingles", F.transform("pivots", mark).alias("marks")))
    at = lambda k: F.get("marks", F.lit(k))
    rings = marked.groupBy("near").agg(*(F.min(F.when(~at(k)["close"], at(k)["far"])).alias(f"r{k}") for k in every))
    ringed = marked.join(F.broadcast(rings), "near")
    closed = [at(k)["close"] & (F.col(f"r{k}").isNull() | (at(k)["far"] + 1 - SHARE[0] / SHARE[1] + 1e-9 < F.col(f"r{k}"))) for k in every]
    left = stored(ringed.where(~F.greatest(*(F.coalesce(x, F.lit(False)) for x in closed))).select("near", "node", "shingles"))
    links = marked.select("node", F.explode("marks").alias("mark")).where(F.col("mark.close") & (F.col("mark.pivot") != F.col("node")))
    return links.select("node", F.col("mark.pivot").alias("root")), left


def linked(held: DataFrame) -> DataFrame:
    """(node, root): the components of similar sets; held: (node, shingles, near), near a set's candidate group."""
    weighed = lambda rows: stored(rows.groupBy("near").agg(F.count("*").alias("n"), F.sum(F.size("shingles")).alias("words")))
    kind = "node long, root long"
    held = stored(held)
    weights = weighed(held)
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = min(GROUP_WORDS, max(LEAST_WORDS, 4 * (weights.agg(F.sum("words")).first()[0] or 0) // parts))
    rest, rows, found, before = [], held, [], 0
    for turn in range(ROUNDS + 1):
        large = weights.where(F.col("words") > limit)
        total = large.agg(F.sum("words")).first()[0] or 0
        if not total:
            rest.append(rows)
            break
        # groups above the limit are fewer than the shares of the whole that it allows, so a broadcast of them is small
        rest.append(rows.join(F.broadcast(large.select("near")), "near", "left_anti"))
        rows = rows.join(F.broadcast(large.select("near", "words")), "near")
        if turn < ROUNDS and (turn == 0 or 4 * total <= 3 * before):
            links, rows = settled(rows, hot_keys(large, ["near"]), turn)
            found.append(links)
            weights, before = weighed(rows), total
            continue
        blocks = F.ceil(2 * F.col("words") / limit).cast("int")
        own = F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own")
        dealt = rows.select("node", "shingles", "near", own, F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        dealt = dealt.select("node", "shingles", "near", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
        found.append(dealt.groupBy("near", "lo", "hi").applyInArrow(_compare, kind))
        break
    compared = lambda some: reduce(DataFrame.union, (x.select("node", "shingles", "near") for x in some)).groupBy("near").applyInArrow(_compare, kind)
    whole = compared(rest[:1])  # groups that one task has compared have their roots
    if rest[1:]:
        found.append(compared(rest[1:]))
    return whole.union(components(reduce(DataFrame.union, found).toDF("u", "v"))) if found else whole


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) for every row; component_id is the smallest id reachable."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            for lo, hi in pieces(off, 1 << 20):
                h, ends = shingle_sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                bands = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * BANDS), pa.array(bands_of(h, ends).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(nodes_of(h, ends)), bands], names=[id_col, "node", "bands"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(0))
            for lo, hi in pieces(off, 1 << 20):
                h, ends = shingle_sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                yield pa.RecordBatch.from_arrays([pa.array(nodes_of(h, ends)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h.view(np.int64)))], names=["node", "shingles"])

    kind = docs.schema[id_col].dataType.simpleString()
    marked = stored(docs.select(id_col, text_col).mapInArrow(marks, f"`{id_col}` {kind}, node long, bands array<long>"))
    nodes = stored(marked.groupBy("node").agg(F.min(id_col).alias("first"), F.first("bands").alias("bands")))
    keys = nodes.select("node", F.explode("bands").alias("band"))
    least = keys.groupBy("band").agg(F.min("node").alias("v"), F.count("*").alias("n")).where("n > 1").select("band", "v")
    pairs = keys.join(least, "band").where("node != v").select(F.col("node").alias("u"), "v").distinct()
    # one link for each node and few among the lowest of the buckets, which join the same nodes
    stars = stored(pairs.groupBy("u").agg(F.min("v").alias("low"), F.collect_set("v").alias("all")))
    lows = stars.select(F.explode("all").alias("u"), F.col("low").alias("v")).where("u != v").distinct()
    near = stored(components(stars.select("u", F.col("low").alias("v")).union(lows)))
    few = near.count() <= BROADCAST_ROWS
    side = (lambda frame: F.broadcast(frame)) if few else (lambda frame: frame)
    wanted = nodes.join(side(near.select("node")), "node", "left_semi").select(F.col("first").alias("__first")).distinct()
    texts = docs.join(side(wanted), docs[id_col].eqNullSafe(wanted["__first"]), "left_semi").select(text_col)
    held = texts.mapInArrow(sets, "node long, shingles array<long>").join(side(near.withColumnRenamed("root", "near")), "node")
    roots = linked(held.select("node", "shingles", "near"))
    named = stored(nodes.select("node", "first").join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")))
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.select("node", other_key("root")).join(lowest.select(other_key("root"), "component_id"), "key").select("node", "component_id")
    return marked.select(id_col, "node").join(named, "node").select(id_col, "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is its group's smallest; repeated ids as in SimHash."""
    return rows_of_least(docs, groups(docs, id_col, text_col), id_col, text_col)
