"""Substring dedup: prefix-partitioned suffix trees over word sequences.

Every word position starts a suffix.  A window of ``length`` words that occurs twice is the head of two suffixes that meet in a
node of string depth ``length`` or more, a deep internal node, and the words under such nodes are removed.

* Prefixes.  Suffixes are grouped by ``prefix`` words, taken where they hash lowest in the suffix's first ``length`` words, so that
  suffixes that can meet in a deep node are in one group, neighbours stay together, and one entry stands for all suffixes of
  a run (one word in 16 is shuffled).  An entry's extension is all the words that the windows of its suffixes cover, up to twice the window.
  Entries are counted by prefix (partial sums first); a prefix with one entry cannot lead to a deep node and is pruned.
* Weighted leaves.  Equal extensions under a prefix are collapsed to one leaf with their number, so that a passage that a
  third of all documents share is one leaf.  A leaf of two or more entries repeats throughout and needs no tree itself.
* Subtrees.  A group with up to ``LEAVES`` leaves is built in memory: the suffixes of its extensions in order (ranks by prefix
  doubling), the depth at which neighbours part, and so the internal nodes.  Suffixes under a node of depth ``length`` repeat up to
  the deepest node above them; joined along an extension these are its maximal repeats.
* Longer prefixes.  A group with more leaves is split by lengthening the prefix to ``length`` words: such a group is a
  single deep node, of which only the number of its places is needed (partial sums first).

Joins by prefix, extension or window deal the rows of a hot key over salts.

Prefixes and extensions are told apart by 64-bit hashes, an extension within its prefix; in the trees words are.

Nulls and empty texts have no words.  Rows are told apart by a 64-bit hash of id and text; a row that is repeated whole
repeats all its windows.  Ties of prefixes inside a window go to the first.  Very long texts are read whole, a task holding one
at a time; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, hot_keys, pieces, salted_join, stored, utf8, word_hashes, word_spans

LENGTH, PREFIX = 35, 5
LEAVES = 4096  #: leaves of a group that is built in memory
BROADCAST_GROUPS = 100_000  #: at most so many crowded prefixes are broadcast
BUILD_WORDS = 1 << 19  #: small groups are built together up to about so many words


def _rolled(column: pa.Array):
    """Pieces of a text column as (first row, words' row bounds, rolling hashes, starts, ends, bytes)."""
    data, off = utf8(column)
    for lo, hi in pieces(off):
        part, own = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        starts, ends, bounds = word_spans(part, own)
        yield lo, bounds, starts, ends, part


def representatives(prefixes: np.ndarray, bounds: np.ndarray, length: int, prefix: int) -> tuple[np.ndarray, ...]:
    """Of one piece: for each run of windows that share a representative, its row, the representative's position, and
    the first and last window starts."""
    wide = length - prefix + 1
    n = len(prefixes)
    if n < wide:
        return (np.zeros(0, np.int64),) * 4
    start = np.arange(n - wide + 1)
    row = np.searchsorted(bounds, start, side="right") - 1
    start = start[start + length <= bounds[row + 1]]
    if not len(start):
        return (np.zeros(0, np.int64),) * 4
    lowest = np.empty(len(start), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(prefixes, wide)
    for a in range(0, len(start), 1 << 16):
        s = start[a : a + (1 << 16)]
        lowest[a : a + (1 << 16)] = s + view[s].argmin(axis=1)
    row = np.searchsorted(bounds, start, side="right") - 1
    new = np.flatnonzero(np.r_[True, (lowest[1:] != lowest[:-1]) | (row[1:] != row[:-1])])
    return row[new], lowest[new], start[new], start[np.r_[new[1:], len(start)] - 1]


def _prefix_rows(length: int, prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = np.asarray(batch.column(0))
            for lo, bounds, starts, ends, data in _rolled(batch.column(1).field(1)):
                words = word_hashes(data, starts, ends)
                if len(words) < length:
                    continue
                roll = Rolling(words)
                at = np.arange(len(words) - prefix + 1)
                heads = roll.of(at, at + prefix)
                row, lowest, first, last = representatives(heads, bounds, length, prefix)
                h = heads[lowest]
                # the place of the representative in its extension is part of the extension's identity
                s = roll.of(first, last + length) ^ ((lowest - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(s.view(np.int64)), pa.array(rid[lo + row]), pa.array((first - bounds[row]).astype(np.int32)), pa.array((last - bounds[row] + length).astype(np.int32))],
                    names=["h", "s", "rid", "lo", "hi"],
                )

    return run


def _window_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, spots = np.asarray(batch.column(0)), batch.column(2)
            begin = np.asarray(spots.offsets)
            flat = spots.values
            h, a, b = (np.asarray(flat.field(k)) for k in range(3))
            for lo, bounds, starts, ends, data in _rolled(batch.column(1).field(1)):
                roll = Rolling(word_hashes(data, starts, ends))
                mine = np.arange(begin[lo], begin[lo + len(bounds) - 1])
                if not len(mine):
                    continue
                row = np.searchsorted(begin, mine, side="right") - 1
                n = (b[mine] - a[mine] - length + 1).astype(np.int64)
                each = np.repeat(np.arange(len(mine)), n)
                at = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n) + a[mine][each]
                place = at + bounds[row[each] - lo]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[mine][each]), pa.array(roll.of(place, place + length).view(np.int64)), pa.array(rid[row[each]]), pa.array(at.astype(np.int32))],
                    names=["h", "w", "rid", "lo"],
                )

    return run


def _leaf_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each leaf's extension."""
    for batch in batches:
        rid, spots = np.asarray(batch.column(0)), batch.column(2)
        begin = np.asarray(spots.offsets)
        h, n, a, b = (np.asarray(spots.values.field(k)) for k in range(4))
        for lo, bounds, starts, ends, data in _rolled(batch.column(1).field(1)):
            mine = np.arange(begin[lo], begin[lo + len(bounds) - 1])
            if not len(mine):
                continue
            row = np.searchsorted(begin, mine, side="right") - 1
            base, raw = bounds[row - lo], data.tobytes()
            words = [raw[x:y] for x, y in zip(starts[base + a[mine]].tolist(), ends[base + b[mine] - 1].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[mine]), pa.array(n[mine]), pa.array(rid[row]), pa.array(a[mine]), pa.array(words, pa.binary()).cast(pa.string())], names=["h", "n", "rid", "lo", "words"]
            )


class Subtrees:
    """Suffix trees of groups of word sequences, as suffixes in order and the depths at which neighbours part.

    words: hashes of all sequences' words; bounds: where each sequence begins, one more at the end; group: of each sequence.
    Suffixes of different groups meet nowhere.
    """

    def __init__(self, words: np.ndarray, bounds: np.ndarray, group: np.ndarray, length: int):
        n = len(words)
        self.owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        self.left = bounds[self.owner + 1] - np.arange(n)  # words from here to the end
        word = np.unique(words, return_inverse=True)[1]
        # names of the first 1, 2, 4, .. words from each position on, in order; a sequence's end comes before any word
        names = [np.unique(group[self.owner].astype(np.int64) * (n + 1) + word, return_inverse=True)[1]]
        size = 1
        while size < int(self.left.max(initial=0)):
            after = np.zeros(n, np.int64)
            after[:-size] = np.where(self.left[:-size] > size, names[-1][size:] + 1, 0)
            names.append(np.unique(names[-1].astype(np.int64) * (n + 1) + after, return_inverse=True)[1])
            size *= 2
        deep = np.flatnonzero(self.left >= length)
        #: suffixes that are long enough, in order
        self.suffix = deep[np.argsort(names[-1][deep], kind="stable")]
        #: how many words each shares with the one before it
        self.common = np.zeros(len(self.suffix), np.int64)
        x, y = self.suffix[:-1], self.suffix[1:]
        shared = np.zeros(len(y), np.int64)
        most = np.minimum(self.left[x], self.left[y])
        for k in range(len(names) - 1, -1, -1):
            fits = shared + (1 << k) <= most
            i, j = np.minimum(x + shared, n - 1), np.minimum(y + shared, n - 1)
            shared += np.where(fits & (names[k][i] == names[k][j]), 1 << k, 0)
        self.common[1:] = shared

    def repeats(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the maximal repeats of at least ``length`` words, joined where they overlap."""
        deepest = np.maximum(self.common, np.r_[self.common[1:], 0][: len(self.common)])
        under = deepest >= length  # under an internal node that is deep enough
        start, depth = self.suffix[under], deepest[under]
        order = np.argsort(start)
        start, end = start[order], (start + depth)[order]
        if not len(start):
            return start, end
        reach = np.maximum.accumulate(end)  # never past the sequence's end
        new = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]] | np.r_[True, self.owner[start[1:]] != self.owner[start[:-1]]])
        return start[new], reach[np.r_[new[1:], len(start)] - 1]


def _subtree_spans(length: int):
    def build(table: pa.Table) -> pa.RecordBatch:
        h, n, rid, lo = (np.asarray(table.column(k)) for k in range(4))
        data, off = utf8(table.column(4))
        starts, ends, bounds = word_spans(data, off)
        tree = Subtrees(word_hashes(data, starts, ends), bounds, np.unique(h, return_inverse=True)[1], length)
        a, b = tree.repeats(length)
        leaf = tree.owner[a]
        once = n[leaf] == 1  # the others repeat as a whole
        a, b, leaf = a[once], b[once], leaf[once]
        shift = lo[leaf] - bounds[leaf]
        return pa.RecordBatch.from_arrays([pa.array(rid[leaf]), pa.array((a + shift).astype(np.int32)), pa.array((b + shift).astype(np.int32))], names=["rid", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                held.append(batch)
                size += batch.num_rows * 2 * length
                if size < 2 * BUILD_WORDS:
                    continue
                table = pa.Table.from_batches(held).combine_chunks()
                h = np.asarray(table.column(0))
                end = int(np.flatnonzero(h != h[-1])[-1]) + 1 if h[0] != h[-1] else 0  # the last group may go on
                if end:
                    yield build(table.slice(0, end).combine_chunks())
                held = table.slice(end).to_batches()
                size = (len(h) - end) * 2 * length
        if held:
            yield build(pa.Table.from_batches(held).combine_chunks())

    return run


def _merge(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1]])
    return list(zip(lo[new].tolist(), hi[np.r_[new[1:], len(lo)] - 1].tolist(), strict=True))


def _kept(id_col: str, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(0).field(1))
            spans, text, n_words, n_removed, digest = batch.column(1), [], [], [], []
            for k in range(batch.num_rows):
                words = data[off[k] : off[k + 1]].tobytes().split()
                n, keep = len(words), words
                if spans[k].is_valid:
                    got = spans[k].values
                    keep, at = [], 0
                    for a, b in _merge(np.asarray(got.field(0)), np.asarray(got.field(1))):
                        keep += words[at:a]
                        at = b
                    keep += words[at:]
                joined = b" ".join(keep)
                n_words.append(n)
                n_removed.append(n - len(keep))
                digest.append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    text.append(joined.decode())
            columns = [batch.column(0).field(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
            names = [id_col, "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns.append(pa.array(text, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def repeated_spans(rows: DataFrame, length: int = LENGTH, prefix: int = PREFIX) -> DataFrame:
    """(rid, lo, hi): word spans of ``rows`` (rid, doc (id, text)) that windows which repeat cover; spans may overlap."""
    leaves = rows.mapInArrow(_prefix_rows(length, prefix), "h long, s long, rid long, lo int, hi int")
    # one extension only: every leaf under the prefix reads alike
    shared = leaves.groupBy("h").agg(F.count("*").alias("n"), F.min("s").alias("s0"), F.max("s").alias("s1")).where("n > 1")
    shared = stored(shared.select("h", "n", (F.col("s0") == F.col("s1")).alias("alike")))
    leaves = stored(salted_join(leaves, shared.drop("n"), ["h"], hot_keys(shared, ["h"]), ["rid", "lo"]))
    alike = leaves.where("alike").select("rid", "lo", "hi")
    mixed = leaves.where("NOT alike")
    nodes = stored(mixed.groupBy("h", "s").agg(F.count("*").alias("n"), F.min(F.struct("rid", "lo", "hi")).alias("leaf")))
    many = nodes.where("n > 1").select("h", "s", "n")
    deep = salted_join(mixed, many.drop("n"), ["h", "s"], hot_keys(many, ["h", "s"]), ["rid", "lo"], "left_semi").select("rid", "lo", "hi")
    groups = stored(nodes.groupBy("h").agg(F.count("*").alias("leaves"), F.min("n").alias("least")).where("least = 1").select("h", (F.col("leaves") > LEAVES).alias("crowded")))
    crowded = groups.where("crowded").select("h")
    n_crowded = crowded.count()
    held = nodes.join(groups.where("NOT crowded").select("h"), "h")
    spots = held.groupBy(F.col("leaf.rid").alias("rid")).agg(F.collect_list(F.struct("h", "n", "leaf.lo", "leaf.hi")).alias("spots"))
    leaf_rows = rows.join(spots, "rid").select("rid", "doc", "spots").mapInArrow(_leaf_rows, "h long, n long, rid long, lo int, words string")
    built = leaf_rows.repartition("h").sortWithinPartitions("h").mapInArrow(_subtree_spans(length), "rid long, lo int, hi int")
    found = alike.unionByName(deep).unionByName(built)
    if not n_crowded:
        return found
    split = nodes.join(F.broadcast(crowded) if n_crowded <= BROADCAST_GROUPS else crowded, "h")
    spots = split.groupBy(F.col("leaf.rid").alias("rid")).agg(F.collect_list(F.struct("h", "leaf.lo", "leaf.hi")).alias("spots"))
    windows = rows.join(spots, "rid").select("rid", "doc", "spots").mapInArrow(_window_rows(length), "h long, w long, rid long, lo int")
    # a row that is repeated whole shows each leaf twice; two leaves must be two places
    place = F.xxhash64("rid", "lo")
    twice = stored(windows.groupBy("h", "w").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("n")).where("a != b").select("h", "w", "n"))
    cross = salted_join(windows, twice.drop("n"), ["h", "w"], hot_keys(twice, ["h", "w"]), ["rid", "lo"], "left_semi").select("rid", "lo", (F.col("lo") + length).alias("hi"))
    return found.unionByName(cross)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, prefix: int = PREFIX, with_text: bool = False) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256 and, if asked for, kept_text."""
    # the same two columns on both sides below, so that one exchange of the texts serves both
    rows = docs.select(F.xxhash64(id_col, text_col).alias("rid"), F.struct(F.col(id_col).alias("id"), F.col(text_col).alias("text")).alias("doc"))
    spans = repeated_spans(rows, length, prefix).groupBy("rid").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return rows.join(spans, "rid", "left").select("doc", "spans").mapInArrow(_kept(id_col, with_text), out)
