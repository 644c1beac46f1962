"""A pipeline of corpus stages, each written as Parquet and read again as the next one's documents.

Null texts are empty texts: they are not toxic, all of them are one group of near duplicates together with texts without words, they overlap no
benchmark and hold no personal data.  Of rows that repeat an id and a text one stays after the second stage.  Nulls in other columns are kept; a
null source is a source of its own.  Texts of any length are read whole, an empty table gives empty tables, and extra columns stay,
but for ``copies``, which the mix sets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import decontaminate, mixing, neardup, pii, simhash, toxicity
from orbweave.llm.common import components, read
from orbweave.tables import shared_folder, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the lexicon is learned from the labelled documents."""
    model = toxicity.fit(docs.select("doc_id", "text"), read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: SimHash fingerprints that differ in at most four bits, or 5-word shingles with a
    Jaccard similarity of at least 0.8.  A group is what links of either kind join."""
    alike, similar = simhash.groups(docs), stored(neardup.groups(docs))
    links = alike.select(F.col("doc_id").alias("u"), F.col("component_id").alias("v")).union(similar.select("doc_id", "component_id"))
    roots = components(links).withColumnRenamed("node", "doc_id")
    found = similar.join(roots, "doc_id", "left").select("doc_id", F.coalesce("root", "component_id").alias("component_id"))
    return simhash.rows_of_least(docs, found, "doc_id", "text")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced and n_chars counted again."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix to target weights takes, and how many copies of each."""
    return mixing.sampled(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
]

#: The stages learn a model, follow components and solve a flow: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; intermediate tables lie in the shared checkpoint folder."""
    root = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{root}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
