"""Language identification: multinomial naive Bayes over hashed character n-grams.

Learning counts hashed 1- to 3-grams of lower-cased letters (a run of other characters is one blank) in a sample of
at most about ``fit_rows`` labelled rows, chosen by id hash; ``fit_rows`` is the documented bound of the sample.  Counts are
summed by partition and then by language and bucket, and the log-probability matrix, ``2**BITS`` rows by the number of languages, is what is
broadcast: its size doesn't depend on the corpus.  Scoring looks up the n-grams of a whole text and sums rows of the
matrix in numpy.

Null texts and texts without letters are ``und`` with score 0.  Repeated rows are counted and predicted like any other.
Without any labelled row every text is ``und``.  Of tied languages the first by name wins.  Very long texts are read whole, an
empty table gives an empty result, and extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, utf8

BITS, ORDERS, ALPHA = 15, 3, 0.5
FIT_ROWS = 20_000

#: Letters among all code points: a fixed table of the Unicode property, built from Python's own.
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def grams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of a text column: first and last row, each gram's row (relative) and bucket, and rows that have letters."""
    data, off = utf8(pc.utf8_lower(column))
    letter = _letters()
    for lo, hi in pieces(off, 1 << 20):
        raw = data[off[lo] : off[hi]]
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        code = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        row = np.searchsorted(off[lo : hi + 1] - off[lo], lead, side="right") - 1
        solid = letter[code]
        has = np.zeros(hi - lo, bool)
        has[row[solid]] = True
        # a run of other characters becomes one blank; each text begins and ends with one as well
        same = np.r_[False, (row[1:] == row[:-1])] if len(row) else np.zeros(0, bool)
        blank_before = np.r_[False, ~solid[:-1]] if len(row) else np.zeros(0, bool)
        keep = solid | ~(same & blank_before)
        code, row = np.where(solid, code, 32)[keep].astype(np.uint64), row[keep]
        rows, buckets = [], []
        for order in range(1, ORDERS + 1):
            n = len(code) - order + 1
            if n <= 0:
                break
            h = np.full(n, order, np.uint64)
            for k in range(order):
                h = (h ^ code[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            inside = row[:n] == row[order - 1 : order - 1 + n]
            if order == 1:
                inside &= code[:n] != 32
            rows.append(row[:n][inside])
            buckets.append((h[inside] >> np.uint64(64 - BITS)).astype(np.int32))
        yield lo, hi, np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(buckets or [np.zeros(0, np.int32)]), has


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", fit_rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages by name, and the (buckets + 1) x languages matrix of log-probabilities; its last row has the priors."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = rows.count()
    share = min(1.0, fit_rows / max(1, n))
    sample = rows.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("fit")), F.lit(1_000_000)) < int(share * 1_000_000))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(1).to_pylist()
            for lo, _, row, bucket, _ in grams(batch.column(0)):
                order = {name: k for k, name in enumerate(dict.fromkeys(names))}
                which = np.array([order[x] for x in names])[lo + row]
                for name, k in order.items():
                    if name not in sums:
                        sums[name] = np.zeros((1 << BITS) + 1, np.int64)
                    sums[name][:-1] += np.bincount(bucket[which == k], minlength=1 << BITS)
            for name in names:
                sums.setdefault(name, np.zeros((1 << BITS) + 1, np.int64))[-1] += 1
        for name, counts in sums.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["lang", "bucket", "n"])

    total: dict[str, np.ndarray] = {}
    # languages times buckets, whatever the corpus
    sums = sample.select(text_col, lang_col).mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = np.asarray(sums["bucket"]), np.asarray(sums["n"])
    names = np.array(sums["lang"].to_pylist(), dtype=object)
    for name in set(names.tolist()):
        total[name] = np.zeros((1 << BITS) + 1, np.int64)
        total[name][bucket[names == name]] = n[names == name]
    langs = sorted(total)
    if not langs:
        return [], np.zeros(((1 << BITS) + 1, 0), np.float32)
    counts = np.stack([total[x] for x in langs], axis=1).astype(np.float64)
    logs = np.log(counts[:-1] + ALPHA) - np.log(counts[:-1].sum(axis=0) + ALPHA * (1 << BITS))
    prior = np.log(counts[-1:] / counts[-1].sum())
    return langs, np.concatenate([logs, prior]).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) per row; score is the posterior of the predicted language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, matrix = shared.value
        names = np.array([*langs, "und"], dtype=object)
        for batch in batches:
            pred = np.full(batch.num_rows, len(langs))
            score = np.zeros(batch.num_rows)
            if langs:
                for lo, hi, row, bucket, has in grams(batch.column(2)):
                    sums = np.stack([np.bincount(row, weights=matrix[:, k][bucket], minlength=hi - lo) for k in range(len(langs))], axis=1) + matrix[-1]
                    best = sums.argmax(axis=1)
                    weight = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
                    pred[lo:hi] = np.where(has, best, len(langs))
                    score[lo:hi] = np.where(has, weight, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names[pred].tolist(), pa.string()), pa.array(score)], names=[id_col, "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    held = F.lit(False) if held_out is None else held_out
    return docs.select(F.col(id_col), held.alias("held_out"), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")
