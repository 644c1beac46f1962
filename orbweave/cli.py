"""Command lines: ``register`` for a pair of files and ``benchmark`` for a manifest."""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import layout, pose
from .plans import registration
from .plans.progress import Progress, to_terminal
from .plans.timers import Timers
from .sources import ply, text
from .tables import stored


def register(spark: SparkSession, args: list[str]) -> int:
    """<source> <target> <voxel size> [--raw] [--segment-ground]: the transform and counts of a pair."""
    options = set(args[3:])
    if len(args) < 3 or options - {"--raw", "--segment-ground"}:
        print(register.__doc__, file=sys.stderr)
        return 1
    p = registration.Parameters(float(args[2]), ground_segmentation="--segment-ground" in options)
    points = ply.scan(spark, args[0]).withColumn("cloud_id", F.lit("source")).unionByName(ply.scan(spark, args[1]).withColumn("cloud_id", F.lit("target")))
    if "--raw" in options:
        points = layout.voxel_downsample(points, p.voxel_size).withColumn("pid", F.xxhash64("i", "j", "k")).select("cloud_id", "pid", "x", "y", "z")
    timers = Timers(spark)
    with timers.time("Preparing clouds"):
        clouds = registration.process_clouds(points, p)
    with timers.time("Registration"):
        got = registration.register(clouds, spark.createDataFrame([(0, "source", "target")], "pair_id long, source string, target string"), p)
    print(timers.report())
    registration.counts(clouds).show()
    got.clique.groupBy("kind").count().show()
    for row in got.transforms.collect():  # one row
        print("\n".join(" ".join(f"{x:.9g}" for x in row["m"][4 * i : 4 * i + 4]) for i in range(4)))
    return 0


def benchmark(spark: SparkSession, args: list[str]) -> int:
    """<manifest> <output folder>: trajectories and a summary of all sequences."""
    if len(args) != 2:
        print(benchmark.__doc__, file=sys.stderr)
        return 1
    base = args[0].rsplit("/", 1)[0]
    results = []
    for entry in text.manifest(spark.read.text(args[0])).collect():  # one row a sequence
        began = time.time()
        voxel = text.voxel_sizes(spark.read.text(f"{base}/{entry['scans']}/voxel_size", wholetext=True).withColumn("sequence", F.lit(entry["sequence"]))).first()["voxel_size"]
        p = registration.Parameters(voxel, ground_segmentation=entry["segment_ground"])
        truth = text.read_ground_truth(spark, f"{base}/{entry['ground_truth']}").withColumn("pair_id", F.col("record").cast("long"))
        used = truth.select(F.col("src").alias("scan")).union(truth.select("tgt")).distinct()
        points = ply.scan_indexed(spark, f"{base}/{entry['scans']}").join(used, "scan", "left_semi").select("cloud_id", "pid", "x", "y", "z")
        pairs = truth.select("pair_id", *(F.concat(F.lit("cloud_bin_"), F.col(c)).alias(d) for c, d in (("src", "source"), ("tgt", "target"))))
        with Progress(spark, entry["sequence"], to_terminal()):
            got = stored(registration.register(registration.process_clouds(points, p), pairs, p).transforms)
        n = max(1, got.count())
        rows = truth.select("pair_id", "m", F.lit(entry["dataset"]).alias("dataset"), F.lit(entry["sequence"]).alias("sequence"), F.lit(entry["t_crit"]).alias("t_crit"), F.lit(entry["r_crit"]).alias("r_crit"), F.lit((time.time() - began) * 1000 / n).alias("runtime_ms"))
        results.append(registration.evaluate(got, rows))
        text.write_trajectories(truth.drop("m").join(got.drop("optimal"), "pair_id").withColumn("sequence", F.lit(entry["sequence"])), f"{args[1]}/{entry['sequence']}")
    if results:
        every = results[0]
        for more in results[1:]:
            every = every.unionByName(more)
        report = pose.summary(every)
        text.summary_lines(report).write.partitionBy("dataset").text(f"{args[1]}/summary")
        text.console_line(report).show(1000, truncate=False)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = sys.argv[1:] if argv is None else argv
    commands = {"register": register, "benchmark": benchmark}
    if not args or args[0] not in commands:
        print("usage: register | benchmark", file=sys.stderr)
        return 1
    return commands[args[0]](SparkSession.builder.getOrCreate(), args[1:])


if __name__ == "__main__":
    sys.exit(main())
