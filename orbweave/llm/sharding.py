"""Shards of near equal bytes by Karmarkar-Karp differencing.

A group is all rows of one text; it is never divided.  A partial partition of some groups is a tuple of one sum a shard, of which
only the differences matter.  Each group begins as a tuple of its own, and the two tuples with the largest spread are combined again
and again, the largest sum of the one with the smallest of the other, until one tuple is left.

Groups of at least ``1 / (shards * LARGE)`` of all bytes or rows, of which there are at most ``2 * shards * LARGE`` whatever the input, are
differenced on the driver.  All others are dealt over buckets of about ``BUCKET`` groups by a hash of the text, and each bucket is
differenced in a task of its own together with an equal part of the large groups' partition as one more tuple, so that small
groups fill what large ones leave uneven.  The first bucket comes last, together with the sums of all else, and fills what the others
leave.  A group that alone is larger than an even share makes its shard as large as itself.

Slots number a shard's rows from 0 without gaps, by chunks of about ``CHUNK`` rows dealt by a hash of id and text: the rows of earlier
chunks, which are counted, then the rank inside the chunk.

A null text has no bytes and is in one group with the empty text; its crc32 is 0.  Very long texts are digested whole, in the JVM.  Repeated
rows are rows of their own in the group of their text; equal rows take their slots in any order.  Ties go by the text's digest.
Null ids are allowed.  An empty table gives an empty result; extra columns are ignored (``write_shards`` keeps them).
Reruns agree: order and partitions don't matter.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stored

LARGE, BUCKET, CHUNK, OVERHEAD = 100, 20_000, 50_000, 16


def difference(sizes: np.ndarray, shards: int, prior: np.ndarray | None = None, turn: int = 0) -> np.ndarray:
    """The shard of each group, from their sizes in order of decreasing size.

    prior: sums that the shards have already, one more tuple whose places keep their names; ``turn`` says where names of
    equal sums begin.
    """
    n = len(sizes)
    prior = np.zeros(shards, np.int64) if prior is None else np.asarray(prior, np.int64)
    names = np.lexsort(((np.arange(shards) + turn) % shards, -prior))
    sums = [np.r_[np.int64(s), np.zeros(shards - 1, np.int64)] for s in sizes]
    sums.append(prior[names] - prior.min())
    heap = [(-int(t[0] - t[-1]), k) for k, t in enumerate(sums)]
    heapq.heapify(heap)
    made: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums[a] + sums[b][::-1]
        order = np.argsort(-both, kind="stable")
        made.append((a, b, order))
        whole = both[order]
        whole -= whole[-1]
        sums[a] = sums[b] = None  # no longer needed
        heapq.heappush(heap, (-int(whole[0]), len(sums)))
        sums.append(whole)
    # back from the last tuple: where each place of a part has come to
    places: list = [None] * len(sums)
    places[-1] = np.arange(shards)
    for k in range(len(made) - 1, -1, -1):
        a, b, order = made[k]
        at, places[n + 1 + k] = places[n + 1 + k], None
        places[a] = np.empty(shards, np.int64)
        places[b] = np.empty(shards, np.int64)
        places[a][order] = at
        places[b][shards - 1 - order] = at
    name = np.empty(shards, np.int64)
    name[places[n]] = names
    return name[np.fromiter((p[0] for p in places[:n]), np.int64, n)]


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, digest) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")
    )


def assigned(groups: DataFrame, shards: int, large: int = LARGE, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """(digest, shard) of the large and of the other groups (digest, bytes, n)."""
    if shards < 1:
        raise ValueError("one shard at least")
    spark = groups.sparkSession
    total = groups.agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.count("*").alias("groups")).first()
    part = shards * large
    is_large = (F.col("bytes") >= (total["bytes"] or 0) / part) | (F.col("n") >= (total["n"] or 0) / part)
    big = groups.where(is_large).select("digest", "bytes").toPandas()  # at most 2 * part rows
    big = big.assign(digest=big["digest"].map(bytes)).sort_values(["bytes", "digest"], ascending=[False, True])
    sizes = big["bytes"].to_numpy(np.int64)
    shard = difference(sizes, shards)
    first = spark.createDataFrame([(bytearray(d), int(s)) for d, s in zip(big["digest"], shard, strict=True)], "digest binary, shard int")
    held = np.zeros(shards, np.int64)
    np.add.at(held, shard, sizes)
    buckets = max(1, math.ceil(total["groups"] / bucket))

    def fill(pdf: pd.DataFrame, prior: np.ndarray, turn: int) -> pd.DataFrame:
        pdf = pdf.assign(digest=pdf["digest"].map(bytes)).sort_values(["bytes", "digest"], ascending=[False, True])
        return pd.DataFrame({"digest": pdf["digest"], "shard": difference(pdf["bytes"].to_numpy(np.int64), shards, prior, turn).astype(np.int32), "bytes": pdf["bytes"]})

    def fill_part(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf["bucket"].iloc[0])
        return fill(pdf, np.array([int(x) * (b + 1) // buckets - int(x) * b // buckets for x in held - held.min()], np.int64), b)

    small = groups.where(~is_large).select("digest", "bytes", F.pmod(F.xxhash64("digest"), F.lit(buckets)).alias("bucket"))
    out = "digest binary, shard int, bytes long"
    others = stored(small.where("bucket > 0").groupBy("bucket").applyInPandas(fill_part, out))
    before = held.copy()
    for row in others.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect():  # one row a shard
        before[row["shard"]] += row["bytes"]
    last = small.where("bucket = 0").groupBy("bucket").applyInPandas(lambda pdf: fill(pdf, before, 0), out)
    return first, others.unionByName(last).drop("bytes")


def shard_rows(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", large: int = LARGE, bucket: int = BUCKET, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    base = stored(sized(docs, id_col, text_col))
    groups = stored(base.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    first, rest = assigned(groups, shards, large, bucket)
    # large groups are few and may have any number of rows; those of the others are few each
    placed = base.join(F.broadcast(first), "digest").unionByName(base.join(F.broadcast(first), "digest", "left_anti").join(rest, "digest"))
    chunks = max(1, math.ceil(base.count() / chunk))
    placed = stored(placed.withColumn("chunk", F.pmod(F.xxhash64(id_col, "digest"), F.lit(chunks))))
    earlier = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    begins = placed.groupBy("shard", "chunk").agg(F.count("*").alias("n")).select("shard", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin"))
    rank = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy(id_col, "digest"))
    return placed.join(begins, ["shard", "chunk"]).select(
        F.col(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("begin") + rank - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The rows of ``docs`` as Parquet, one folder ``shard=<number>`` for each shard; a column of that name is replaced."""
    base = stored(sized(docs, id_col, text_col))
    first, rest = assigned(stored(base.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))), shards)
    name = fresh(docs, "__digest")
    rows = docs.drop("shard").withColumn(name, F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)))
    first, rest = first.withColumnRenamed("digest", name), rest.withColumnRenamed("digest", name)
    placed = rows.join(F.broadcast(first), name).unionByName(rows.join(F.broadcast(first), name, "left_anti").join(rest, name)).drop(name)
    placed.repartition("shard", F.pmod(F.xxhash64(id_col), F.lit(8))).write.partitionBy("shard").parquet(path)
