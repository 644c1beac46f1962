"""SimHash near-duplicate groups through anchor-point covering.

Fingerprints: 64 bits over the XXH64 of word shingles, whole texts.  Search: the 64 bits fall into blocks, of which some are
joined so that two fingerprints which differ in at most four bits differ in at most ``threshold`` bits of some join.  The low 15
bits of a join are covered by the perfect [15,11] Hamming code (covering radius 1), its other bits by themselves.
Codewords are the anchors: a fingerprint is at home at the one anchor within the covering radius, and is replicated to every
anchor within radius plus threshold, where the home of any partner in that join must be.  Homes are compared with replicas
per anchor by XOR and popcount, and only a spanning star of each local component is emitted.

Anchors grow with the corpus (``layout_for``): three single blocks with threshold 1 have 2^17 anchors each; of seven blocks
each three joined, and of eight each four, differ nowhere for some join (threshold 0), with 2^23 and 2^28 anchors, so that
about ``HOMES`` fingerprints are at home at an anchor up to 10^10.  All layouts find the same links.

Nulls, empty texts and texts without words get fingerprint zero and are linked like any other.  A bit that half of the
hashes set is 0.  Very long texts are read whole, about 1 MB of texts or one longer text at a time.  Repeated rows keep their
rows and share a fingerprint.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, fresh, other_key, stored, utf8

CODED = 15
HOMES = 64


class Layout(NamedTuple):
    """Blocks of the 64 bits, how many are joined, and in how many bits partners may differ in a join."""

    blocks: int
    joined: int
    threshold: int

    def joins(self) -> list[list[tuple[int, int]]]:
        """(low bit, width) of the blocks of each join; every join has ``CODED`` bits at least."""
        cuts = [64 * k // self.blocks for k in range(self.blocks + 1)]
        return [list(x) for x in itertools.combinations([(a, b - a) for a, b in itertools.pairwise(cuts)], self.joined)]

    def anchors(self) -> int:
        """Of the smallest join."""
        return 1 << (min(sum(w for _, w in join) for join in self.joins()) - 4)


#: Up to four differing bits leave a block of three with at most one, and three of seven or four of eight with none.
LAYOUTS = (Layout(3, 1, 1), Layout(7, 3, 0), Layout(8, 4, 0))


def layout_for(n: int) -> Layout:
    """The first with few enough homes an anchor, else the last."""
    return next((x for x in LAYOUTS if n <= HOMES * x.anchors()), LAYOUTS[-1])


#: Homes of an anchor beyond this number are dealt over salts; replicas go to each salt.
HOT_HOMES = 4096


def fingerprint_batch(texts: list[bytes], shingle: int) -> np.ndarray:
    """Fingerprints of a few whole texts."""
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for k, text in enumerate(texts):
        words = text.lower().split()  # ASCII only: A-Z, and white space as in WORD
        if not words:
            continue
        whole = b" ".join(words)
        if len(words) <= shingle:
            hashes.append(digest(whole, 42))
            counts[k] = 1
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-shingle]))
        hashes += [digest(whole[a:b], 42) for a, b in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)]
        counts[k] = len(words) - shingle + 1
    out = np.zeros(len(texts), np.uint64)
    if hashes:
        bits = np.unpackbits(np.array(hashes, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        full = np.flatnonzero(counts)
        sums = np.add.reduceat(bits, np.cumsum(counts[full]) - counts[full], axis=0, dtype=np.int64)
        out[full] = np.packbits(2 * sums > counts[full, None], axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            fps = np.zeros(len(off) - 1, np.uint64)
            lo = 0
            while lo < len(fps):  # texts of about 1 MB at a time
                hi = min(max(lo + 1, int(np.searchsorted(off, off[lo] + (1 << 20), side="right")) - 1), len(fps))
                fps[lo:hi] = fingerprint_batch([data[off[k] : off[k + 1]].tobytes() for k in range(lo, hi)], shingle)
                lo = hi
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def hamming_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each 15-bit value: its nearest codeword, all codewords within distance two, and their number."""
    values = np.arange(1 << CODED, dtype=np.int64)
    syndrome = np.zeros(len(values), np.int64)
    for bit in range(CODED):
        syndrome ^= ((values >> bit) & 1) * (bit + 1)
    nearest = np.where(syndrome > 0, values ^ (1 << np.maximum(syndrome - 1, 0)), values)
    near = np.zeros((len(values), 8), np.int64)
    near[:, 0] = nearest
    count = np.ones(len(values), np.int64)
    # two flips i < j reach a codeword where (i + 1) ^ (j + 1) is the syndrome
    for i in range(CODED):
        j = (syndrome ^ (i + 1)) - 1
        rows = np.flatnonzero((j > i) & (j < CODED) & (syndrome > 0))
        near[rows, count[rows]] = values[rows] ^ (1 << i) ^ (1 << j[rows])
        count[rows] += 1
    return nearest, near, count


def placed(fps: np.ndarray, tables=None, layout: Layout = LAYOUTS[0]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor keys, fingerprint index and home flag of every copy of the given fingerprints."""
    nearest, near, count = tables or hamming_tables()
    keys, owner, home = [], [], []
    every = np.arange(len(fps))
    for number, join in enumerate(layout.joins()):
        value = np.zeros(len(fps), np.int64)
        for low, width in join:
            value = (value << width) | ((fps >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)
        coded, free = value & ((1 << CODED) - 1), value >> CODED
        tag = number << 36

        def put(anchor, rest, who, at_home):
            keys.append(tag | (rest << CODED) | anchor)
            owner.append(who)
            home.append(np.full(len(who), at_home))

        put(nearest[coded], free, every, True)
        if not layout.threshold:  # a perfect code has no other anchor within its radius
            continue
        for k in range(1, 8):
            who = np.flatnonzero(count[coded] > k)
            put(near[coded[who], k], free[who], who, False)
        for bit in range(sum(width for _, width in join) - CODED):
            put(nearest[coded], free ^ (1 << bit), every, False)
    return np.concatenate(keys), np.concatenate(owner), np.concatenate(home)


def _settle(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Make labels equal along the links (indices), each the smallest of its component."""
    while True:
        low = np.minimum(labels[left], labels[right])
        if (low == labels[left]).all() and (low == labels[right]).all():
            return
        np.minimum.at(labels, left, low)
        np.minimum.at(labels, right, low)
        labels[:] = labels[labels]


def stars(key: np.ndarray, fp: np.ndarray, home: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole anchor groups (rows sorted by key, homes first): each member to its local component's first."""
    n = len(key)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, n])
    homes = np.add.reduceat(home.astype(np.int64), first)
    labels = np.arange(n)
    small = (homes > 0) & (size > 1) & (homes * size <= 1 << 14)
    groups = np.flatnonzero(small)
    lo = 0
    work = np.cumsum((homes * size)[groups])
    while lo < len(groups):
        base = work[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(work, base + (1 << 20), side="right")))
        g = groups[lo:hi]
        rows = np.repeat(first[g], homes[g]) + np.arange(homes[g].sum()) - np.repeat(np.cumsum(homes[g]) - homes[g], homes[g])
        span = np.repeat(size[g], homes[g])
        a = np.repeat(rows, span)
        b = np.repeat(np.repeat(first[g], homes[g]), span) + np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)
        hit = (np.bitwise_count(fp[a] ^ fp[b]) <= bits) & (a != b)
        _settle(labels, a[hit], b[hit])
        lo = hi
    for g in np.flatnonzero((homes > 0) & (size > 1) & ~small):
        s, e, h = first[g], first[g] + size[g], homes[g]
        own, lab = fp[s:e], np.arange(size[g])
        step = max(1, (1 << 21) // size[g])
        changed = True
        while changed:
            was = lab.copy()
            for at in range(0, h, step):
                near = np.bitwise_count(own[at : min(at + step, h), None] ^ own[None, :]) <= bits
                top = np.where(near, lab[None, :], size[g]).min(axis=1)
                lab = np.minimum(lab, np.where(near, top[:, None], size[g]).min(axis=0))
            lab = lab[lab]
            changed = bool((lab != was).any())
        labels[s:e] = s + lab
    out = np.flatnonzero(labels != np.arange(n))
    u, v = fp[out], fp[labels[out]]
    keep = u != v
    return u[keep], v[keep]


def links(fps: DataFrame, bits: int = 4, layout: Layout | None = None) -> DataFrame:
    """(u, v): links that connect all distinct fingerprints (column fp) at ``bits`` or fewer differing bits."""
    if not 0 <= bits <= 4:
        raise ValueError("the covering is built for at most four differing bits")
    tables = hamming_tables()
    layout = layout or layout_for(fps.count())

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
            for lo in range(0, len(fp), 4096):
                part = fp[lo : lo + 4096]
                key, who, home = placed(part, tables, layout)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[who].view(np.int64)), pa.array(home)], names=["key", "fp", "home"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key, fp, home):
            u, v = stars(key, fp.view(np.uint64), home, bits)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            held.append([np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)])
            rows += batch.num_rows
            if rows < 200_000:
                continue
            key, fp, home = (np.concatenate(x) for x in zip(*held, strict=True))
            end = int(np.searchsorted(key, key[-1]))  # the last group may go on
            if end:
                yield out(key[:end], fp[:end], home[:end])
            held, rows = [[key[end:], fp[end:], home[end:]]], len(key) - end
        if rows:
            yield out(*(np.concatenate(x) for x in zip(*held, strict=True)))

    copies = fps.select("fp").mapInArrow(spread, "key long, fp long, home boolean")
    hot = copies.where("home").groupBy("key").count().where(F.col("count") > HOT_HOMES).select("key", F.ceil(F.col("count") / HOT_HOMES).cast("int").alias("salts"))
    hot = stored(hot)
    n_hot = hot.count()
    if n_hot:
        side = F.broadcast(hot) if n_hot <= 10_000 else hot
        # the salted key: at home in one salt, replicated to each
        dealt = copies.join(side, "key", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("salts"))
        dealt = dealt.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        dealt = dealt.withColumn("home", F.col("home") & (F.col("salt") == own))
        copies = dealt.select((F.col("key") + F.col("salt").cast("long") * F.lit(1 << 43)).alias("key"), "fp", "home")
    copies = copies.repartition("key").sortWithinPartitions("key", F.desc("home"))
    return copies.mapInArrow(compare, "u long, v long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, bits: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; component_id is the smallest id reachable."""
    fps = stored(fingerprints(docs, id_col, text_col, shingle))
    nodes = stored(fps.groupBy("fp").agg(F.min(id_col).alias("first")))
    roots = components(links(nodes, bits))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.select("fp", other_key("root")).join(least.select(other_key("root"), "component_id"), "key").select("fp", "component_id")
    return fps.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is its group's smallest.  If ids repeat, rows that repeat an id and its text are
    one row; rows that share the smallest id but differ in text all stay."""
    return rows_of_least(docs, groups(docs, id_col, text_col), id_col, text_col)


def rows_of_least(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose id is the component_id that ``found`` gives it."""
    found, name = stored(found), fresh(docs, "__keep")
    keep = found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias(name))
    repeated = not found.groupBy(id_col).count().where("count > 1").isEmpty()
    if repeated:
        keep = keep.distinct()
    kept = docs.join(keep, docs[id_col].eqNullSafe(keep[name]), "left_semi")
    return kept.dropDuplicates([id_col, text_col]) if repeated else kept
