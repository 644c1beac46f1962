"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hard_negatives, html_extract, langid, licenses, media, mixing, pii, sharding, simhash, substring, toxicity
from .common import read


def _fold(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.overlaps(read(spark, d, "documents"), read(spark, d, "benchmark"))


def op2_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, d, "labels").select("doc_id", "toxic"), train=_fold(3) != 1)
    return toxicity.score(docs, model, held_out=_fold(3) == 1)


def op3_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash.groups(read(spark, d, "documents"))


def op4_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.by_source(read(spark, d, "documents"))


def op5_substring(spark: SparkSession, d: str) -> DataFrame:
    return substring.dedup(read(spark, d, "documents"))


def op6_licenses(spark: SparkSession, d: str) -> DataFrame:
    return licenses.scan(read(spark, d, "documents"))


def op7_pii(spark: SparkSession, d: str) -> DataFrame:
    return pii.digests(read(spark, d, "documents"))


def op8_media(spark: SparkSession, d: str) -> DataFrame:
    return media.digests(read(spark, d, "documents"))


def op9_html(spark: SparkSession, d: str) -> DataFrame:
    return html_extract.extract(read(spark, d, "pages"))


def op10_langid(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(_fold(4) != 2))
    return langid.predict(docs.drop("lang"), model, held_out=_fold(4) == 2)


def op11_sharding(spark: SparkSession, d: str) -> DataFrame:
    return sharding.shard_rows(read(spark, d, "documents"))


def op12_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, d, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_decontaminate, op2_toxicity, op3_simhash, op4_mixing, op5_substring, op6_licenses, op7_pii, op8_media, op9_html, op10_langid, op11_sharding, op12_hard_negatives)
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op6_licenses": licenses.scan_sql(), "op12_hard_negatives": hard_negatives.SQL}
