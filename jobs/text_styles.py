"""Which sources of a growing text collection look alike: histogram descriptors, matched as planes of two scans are.

A plane of a scan is described by a histogram of distances by angles around it, and two scans' planes are matched where each
is the other's nearest by chi-square distance, with a confidence that compares with the second best.  This job does the same with text
sources: a source's descriptor is the histogram of word lengths by place in the text, kept for each language, and sources
that are each other's nearest are reported.  Feeds that come in twice under two names show up with a confidence near 1.

The job is incremental.  The table is read as a stream of files; a run takes the files that the checkpoint has not seen, adds up
each batch's histograms and writes them to the batch's own folder, which a batch that is repeated after a failure overwrites.
Then the report is made anew from all batches' histograms, a few rows for each source and batch.  A run without new files
changes nothing.  The checkpoint lies in the output folder, since one is of no use without the other.

Words are counted on the map side before any shuffle, so a source that holds most of the texts is no crowded key.  A null text has
no words, a null source or language is called (none).  Sources without words have no descriptor.  Whole texts are read.  Repeated rows
count again.  An empty table gives an empty report; other columns are ignored.

    python -m jobs.text_styles <folder of tables> <output> [configuration.json]
"""

from __future__ import annotations

import json
import logging
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.operators import matching

CONFIG = json.loads(Path(__file__).with_suffix(".json").read_text())
WORD = r"([^\x20\x09-\x0D]+)"
TEXTS = "lang string, source string, text string"
COUNTS = "lang string, source string, bin int, n long, batch long"
REPORT = "source string, like string, distance double, confidence double, lang string"
log = logging.getLogger("jobs.text_styles")


def counts(docs: DataFrame, lengths: int, places: int) -> DataFrame:
    """(lang, source, bin, n): words by length (the last bin holds all longer ones) and place in their text."""
    words = docs.select(F.coalesce("lang", F.lit("(none)")).alias("lang"), F.coalesce("source", F.lit("(none)")).alias("source"), F.regexp_extract_all("text", F.lit(WORD), 1).alias("w"))
    bins = F.transform("w", lambda x, i: ((F.least(F.length(x), F.lit(lengths)) - 1) * places + F.floor(i * places / F.size("w"))).cast("int"))
    return words.select("lang", "source", F.explode(bins).alias("bin")).groupBy("lang", "source", "bin").agg(F.count("*").alias("n"))


def report(all_counts: DataFrame) -> DataFrame:
    """(lang, source, like, distance, confidence): pairs of sources of a language that are each other's nearest."""
    sums = all_counts.groupBy("lang", "source", "bin").agg(F.sum("n").alias("n"))
    whole = sums.groupBy("lang", "source").agg(F.sum("n").alias("whole"))
    hist = sums.join(whole, ["lang", "source"]).select("lang", F.col("source").alias("id"), "bin", (F.col("n") / F.col("whole")).alias("mass"))
    apart = matching.chi_square(hist, hist, ("lang",)).where("s != t")
    best = matching.mutual_confidence(apart, ("lang",)).where("s < t")  # of either order one
    return best.select(F.col("s").alias("source"), F.col("t").alias("like"), F.col("d").alias("distance"), "confidence", "lang")


def read_report(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(REPORT).parquet(f"{output}/report")


def run(spark: SparkSession, tables: str, output: str, config: dict = CONFIG) -> DataFrame:
    """Take what is new, and return the whole report."""
    path = f"{tables}/{config['table']}.parquet"
    # as a pattern, so that a table may be one file or a folder of files
    stream = spark.readStream.schema(TEXTS).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(f"{path[:-1]}[t]")

    # the report can be made before anything has come
    counts(spark.createDataFrame([], TEXTS), config["lengths"], config["places"]).write.mode("ignore").parquet(f"{output}/counts/batch=-1")

    def add(batch: DataFrame, number: int) -> None:
        counts(batch, config["lengths"], config["places"]).write.mode("overwrite").parquet(f"{output}/counts/batch={number}")

    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    taken = [p for p in query.recentProgress if p["numInputRows"]]
    log.info("read %s new texts of %s in %s batches", sum(p["numInputRows"] for p in taken), path, len(taken))
    have = spark.read.schema(COUNTS).parquet(f"{output}/counts")
    report(have).repartition("lang").write.mode("overwrite").partitionBy("lang").parquet(f"{output}/report")
    out = read_report(spark, output)
    log.info("wrote %s pairs of sources to %s/report, from %s batches in all", out.count(), output, have.where("batch >= 0").select("batch").distinct().count())
    return out


def main(args: list[str]) -> int:
    if len(args) not in (2, 3):
        print("usage: python -m jobs.text_styles <folder of tables> <output> [configuration.json]", file=sys.stderr)
        return 1
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = CONFIG | json.loads(Path(args[2]).read_text()) if args[2:] else CONFIG
    spark = SparkSession.builder.appName("text_styles").getOrCreate()
    try:
        run(spark, args[0], args[1], config)
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
