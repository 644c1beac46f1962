"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources a document belongs to).  Token capacity flows from
patterns to source quotas: the k-th copy of a pattern's tokens costs (k - 1) squared, so repetition is convex and spread
evenly, and ``REPEATS`` copies bound it.  The flow says how many tokens each pattern gives; whole copies of all its
documents and a seeded selection for the rest give them.  The selection takes the documents whose id hash lies below a
threshold, found by three rounds of sums over hash buckets (1,024 each, the last round's buckets are 2**-30 of a pattern),
so no pattern is ever sorted or collected, however large.

Only the sums of patterns and buckets come to the driver.  Patterns beyond ``PATTERNS`` raise an error.

Null texts have size zero; a null source is a source of its own, last in order; a document without sources gives nothing.
Rows that repeat an id have one hash and are selected alike, as are ids whose hashes tie.  Very long texts are counted whole.  An
empty table gives an empty result.  Reruns agree: order and partitions don't matter.  Extra columns are ignored (``sampled``
keeps them).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh, stored

WEIGHTS, REPEATS, SEED, PATTERNS = (5, 2, 1), 3, 17, 100_000
_ROUNDS, _BITS = 3, 10


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> list[float]:
    """Targets of sources in order: weighted shares of all sizes, none above ``repeats`` times its size, the excess
    shared again among the others."""
    total, capped = float(sum(sizes)), set()
    weigh = [weights[k % len(weights)] for k in range(len(sizes))]
    while True:
        left = total - sum(repeats * sizes[k] for k in capped)
        free = [k for k in range(len(sizes)) if k not in capped]
        share = sum(weigh[k] for k in free)
        out = [float(repeats * sizes[k]) if k in capped else left * weigh[k] / share for k in range(len(sizes))]
        above = {k for k in free if out[k] > repeats * sizes[k]}
        if not above:
            return out
        capped |= above


def flow(supply: list[float], member: list[tuple[int, ...]], quota: list[float], repeats: int = REPEATS) -> list[float]:
    """Tokens each pattern gives, from supplies by pattern, sources by pattern, and quotas by source: a maximum flow of
    least repetition cost.

    Primal-dual: only arcs from the origin cost anything, so the shortest augmenting paths of one length are those that begin
    with the k-th copies, and each length is exhausted at once by blocking flows.  Flow is kept on the arcs from patterns to
    sources; a pattern's flow never falls.
    """
    n, m = len(supply), len(quota)
    tiny = 1e-9 * max(1.0, sum(quota))
    sent: list[dict[int, float]] = [dict.fromkeys(x, 0.0) for x in member]
    back: list[set[int]] = [set() for _ in range(m)]  # patterns that send to a source
    given, open_ = [0.0] * n, list(quota)
    for copy in range(1, repeats + 1):
        room = [min(copy * x - g, x) if x > 0 else 0.0 for x, g in zip(supply, given, strict=True)]
        while True:
            # patterns and sources in layers by the number of arcs from a pattern that has room
            level = [0 if r > tiny else -1 for r in room]
            depth = [-1] * m
            layer, far, found = [p for p in range(n) if level[p] == 0], 0, False
            while layer and not found:
                reached = []
                for p in layer:
                    for s in sent[p]:
                        if depth[s] < 0:
                            depth[s] = far + 1
                            reached.append(s)
                            found = found or open_[s] > tiny
                layer, far = [], far + 2
                for s in reached:
                    for p in back[s] if not found else ():
                        if level[p] < 0 and sent[p][s] > tiny:
                            level[p] = far
                            layer.append(p)
            if not found:
                break
            ways = [[s for s in sent[p] if depth[s] == level[p] + 1] if level[p] >= 0 else [] for p in range(n)]
            turns = [[p for p in back[s] if level[p] == depth[s] + 1] if depth[s] >= 0 else [] for s in range(m)]
            way, turn = [0] * n, [0] * m  # arcs before these lead nowhere in this round
            for first in range(n):
                while level[first] == 0 and room[first] > tiny:
                    path = [first]  # patterns and sources in turn
                    while path:
                        at = path[-1]
                        if len(path) % 2:
                            if way[at] < len(ways[at]):
                                path.append(ways[at][way[at]])
                                continue
                            path.pop()
                            if path:
                                turn[path[-1]] += 1
                        elif open_[at] > tiny:
                            break
                        else:
                            while turn[at] < len(turns[at]) and sent[turns[at][turn[at]]][at] <= tiny:
                                turn[at] += 1
                            if turn[at] < len(turns[at]):
                                path.append(turns[at][turn[at]])
                                continue
                            path.pop()
                            way[path[-1]] += 1
                    if not path:
                        break
                    push = min([room[first], open_[path[-1]], *(sent[path[k]][path[k - 1]] for k in range(2, len(path), 2))])
                    room[first] -= push
                    given[first] += push
                    open_[path[-1]] -= push
                    for k in range(0, len(path), 2):
                        sent[path[k]][path[k + 1]] += push
                        back[path[k + 1]].add(path[k])
                        if k:
                            sent[path[k]][path[k - 1]] -= push
    return given


@dataclass
class Plan:
    """Of a mix: sources in order, their sizes and targets."""

    sources: list[str | None]
    sizes: list[int]
    targets: list[float]


def mix(docs: DataFrame, sources: Column, size: Column, key: Column, keep: list[Column], weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = SEED) -> tuple[DataFrame, Plan]:
    """Rows of ``docs`` as the columns ``keep`` with pattern, size and copies (0 to ``repeats``).

    sources: array of source names; size: tokens; key: what identifies a document for the seeded selection.
    """
    spark = docs.sparkSession
    names = F.array_sort(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>"))))
    # a code without ambiguity: each name after its length
    code = F.array_join(F.transform(names, lambda x: F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("n"))), ",")
    rows = docs.select(*keep, code.alias("pattern"), names.alias("names"), size.alias("size"), F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 64 - _ROUNDS * _BITS).alias("u"))
    rows = stored(rows)
    sums = rows.groupBy("pattern").agg(F.sum("size").alias("size"), F.first("names").alias("names")).limit(PATTERNS + 1).collect()
    if len(sums) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} membership patterns")
    sums = sorted(sums, key=lambda r: r["pattern"])
    order = sorted({x for r in sums for x in r["names"]}, key=lambda x: (x is None, x or ""))
    at = {x: k for k, x in enumerate(order)}
    sizes = [0] * len(order)
    for r in sums:
        for x in r["names"]:
            sizes[at[x]] += r["size"]
    total = sum(r["size"] for r in sums if r["names"])
    targets = source_targets(sizes, weights, repeats)
    scale = total / sum(sizes) if sum(sizes) else 1.0  # tokens of several sources count once in the whole
    targets = [t * scale for t in targets]
    given = flow([float(r["size"]) for r in sums], [tuple(at[x] for x in r["names"]) for r in sums], targets, repeats)
    whole, rest = {}, {}
    for r, g in zip(sums, given, strict=True):
        copies = min(repeats, int(g / r["size"] + 1e-9)) if r["size"] else 0
        whole[r["pattern"]] = copies
        rest[r["pattern"]] = max(0.0, g - copies * r["size"]) if copies < repeats else 0.0
    below = dict.fromkeys(whole, 0)
    if sums:
        below = _thresholds(rows, rest)
        table = spark.createDataFrame([(p, whole[p], below[p]) for p in sorted(whole)], "pattern string, whole int, below long")
        out = rows.join(F.broadcast(table), "pattern")  # bounded by PATTERNS
        copies = F.col("whole") + F.when(F.col("u") < F.col("below"), 1).otherwise(0)
        rows = out.withColumn("copies", copies)
    else:
        rows = rows.withColumn("copies", F.lit(0))
    return rows.drop("u", "whole", "below"), Plan(order, sizes, targets)


def _thresholds(rows: DataFrame, rest: dict[str, float]) -> dict[str, int]:
    """For each pattern the hash below which documents are taken once more."""
    spark = rows.sparkSession
    prefix = dict.fromkeys((p for p, r in rest.items() if r > 0), 0)
    left = dict(rest)
    out = dict.fromkeys(rest, 0)
    for turn in range(_ROUNDS):
        if not prefix:
            break
        shift = (_ROUNDS - 1 - turn) * _BITS
        edge = spark.createDataFrame(sorted(prefix.items()), "pattern string, prefix long")
        bucket = F.shiftright("u", shift)
        sums = rows.join(F.broadcast(edge), "pattern").where(F.shiftright("u", shift + _BITS) == F.col("prefix")).groupBy("pattern", bucket.alias("b")).agg(F.sum("size").alias("size")).collect()  # patterns x 1,024
        by: dict[str, list[tuple[int, int]]] = {p: [] for p in prefix}
        for r in sums:
            by[r["pattern"]].append((r["b"], r["size"]))
        nxt = {}
        for p, found in by.items():
            out[p] = prefix[p] << (shift + _BITS)
            for b, size in sorted(found):
                if size > left[p]:
                    out[p] = b << shift
                    if turn + 1 < _ROUNDS:
                        nxt[p] = b
                    elif 2 * left[p] >= size:  # the nearer of with and without
                        out[p] = (b + 1) << shift
                    break
                left[p] -= size
                out[p] = (b + 1) << shift
        prefix = nxt
    return out


def by_source(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of every row, for a single source column."""
    spark = docs.sparkSession
    rows, plan = mix(docs, F.array(F.col(source_col)), n_words(F.col(text_col)), F.col(id_col), [F.col(id_col), F.col(source_col).alias("__source")])
    table = spark.createDataFrame(list(zip(plan.sources, plan.sizes, plan.targets, strict=True)), "source string, source_size long, target double")
    out = rows.join(F.broadcast(table), rows["__source"].eqNullSafe(table["source"]))  # bounded by PATTERNS
    return out.select(id_col, "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def sampled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the mix takes, with ``copies``, which replaces a column of that name."""
    docs = docs.drop("copies")
    own = fresh(docs, "__id")
    got = by_source(docs, id_col, text_col, source_col).where("copies > 0").select(F.col(id_col).alias(own), "copies")
    # rows that repeat an id have one hash, so they are taken alike
    got = got.groupBy(own).agg(F.max("copies").alias("copies"))
    return docs.join(got, docs[id_col].eqNullSafe(got[own])).drop(own)
