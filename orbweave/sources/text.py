"""Text formats: trajectory logs, manifests, voxel sizes, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pose import inverse

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
FIELDS = 19


def ground_truth(texts: DataFrame) -> DataFrame:
    """(sequence, record, src, tgt, meta, m array of 16) of whole logs (sequence, value).

    A record is two scan numbers, a number that is not used, and a row-major matrix.  Reading stops at the first token that
    is no number; an incomplete record is dropped.
    """
    rows = texts.select("sequence", F.filter(F.split("value", r"\s+"), lambda t: t != "").alias("t"))
    bad = F.array_position(F.transform("t", lambda t: t.rlike(NUMBER)), F.lit(False))
    whole = F.floor(F.when(bad == 0, F.size("t")).otherwise(bad - 1) / FIELDS).cast("int")
    rows = rows.select("sequence", "t", whole.alias("n")).where("n > 0").select("sequence", "t", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("record"))
    at = lambda k: F.get("t", F.col("record") * FIELDS + k)
    m = F.transform(F.slice("t", F.col("record") * FIELDS + 4, 16), lambda x: x.cast("double"))
    return rows.select("sequence", "record", *(at(k).cast("int").alias(c) for k, c in enumerate(("src", "tgt", "meta"))), m.alias("m"))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return ground_truth(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("sequence"), "value"))


def _fail(condition: Column, message: Column) -> Column:
    return F.when(condition, F.raise_error(message))


def manifest(lines: DataFrame) -> DataFrame:
    """(scans, ground_truth, dataset, sequence, segment_ground, t_crit, r_crit) of lines (value).

    Fields: two paths, then ``--segment-ground`` and ``--success-criteria T R``.  Blank lines are skipped; a missing path,
    an unknown option and criteria that are no numbers are errors.  Criteria are 0 where none are given.
    """
    rows = lines.select(F.filter(F.split("value", r"\s+"), lambda t: t != "").alias("t")).where(F.size("t") > 0)
    rest = F.slice("t", 3, F.greatest(F.size("t") - 2, F.lit(0)))
    # options are read from left to right; the state is how many criteria are still due
    start = F.struct(F.lit(0).alias("due"), F.lit(False).alias("ground"), F.array().cast("array<double>").alias("crit"), F.lit(None).cast("string").alias("bad"))

    def step(s: Column, x: Column) -> Column:
        number = x.try_cast("double")
        bad = F.when(s["bad"].isNotNull(), s["bad"]).when((s["due"] > 0) & number.isNull(), F.concat(F.lit("not a number: "), x)).when((s["due"] == 0) & ~x.isin("--segment-ground", "--success-criteria"), F.concat(F.lit("unsupported option: "), x))
        crit = F.when(s["due"] == 2, F.array(number)).when(s["due"] == 1, F.concat(s["crit"], F.array(number))).otherwise(s["crit"])
        due = F.when(s["due"] > 0, s["due"] - 1).when(x == "--success-criteria", 2).otherwise(0)
        return F.struct(due.alias("due"), (s["ground"] | ((s["due"] == 0) & (x == "--segment-ground"))).alias("ground"), crit.alias("crit"), bad.alias("bad"))

    rows = rows.select("t", F.aggregate(rest, start, step).alias("o"))
    wrong = F.coalesce(_fail(F.size("t") < 2, F.lit("missing ground-truth path in manifest")), _fail(F.col("o.bad").isNotNull(), F.col("o.bad")), _fail(F.col("o.due") > 0, F.lit("criteria are incomplete")))
    folder = F.regexp_replace(F.regexp_replace(F.get("t", F.lit(1)), r"^(\./)?benchmarks/", ""), r"/?[^/]*$", "")
    crit = lambda k: F.coalesce(F.get("o.crit", F.lit(k)), F.lit(0.0))
    # the error is part of a column that is always read
    scans = F.coalesce(wrong.cast("string"), F.get("t", F.lit(0)))
    return rows.select(scans.alias("scans"), F.get("t", F.lit(1)).alias("ground_truth"), F.substring_index(folder, "/", 1).alias("dataset"), folder.alias("sequence"), F.col("o.ground").alias("segment_ground"), crit(0).alias("t_crit"), crit(1).alias("r_crit"))


def voxel_sizes(texts: DataFrame) -> DataFrame:
    """(sequence, voxel_size) of side files (sequence, value); a size that is not positive is an error."""
    size = F.get(F.filter(F.split("value", r"\s+"), lambda t: t != ""), F.lit(0)).try_cast("double")
    return texts.select("sequence", F.when(size > 0, size).otherwise(F.raise_error(F.lit("voxel size must be positive"))).alias("voxel_size"))


def _g17(x: Column) -> Column:
    return F.format_string("%s", x)


def trajectory(results: DataFrame) -> DataFrame:
    """(sequence, record, value): log entries, the pair and the inverse of its estimate (sequence, record, src, tgt, m)."""
    rows = results.withColumn("_i", inverse(F.col("m")))
    lines = [F.concat_ws(" ", *(_g17(F.get("_i", F.lit(4 * i + j))) for j in range(4))) for i in range(4)]
    head = F.concat_ws(" ", F.col("src").cast("string"), F.col("tgt").cast("string"), F.lit("0"))
    return rows.select("sequence", "record", F.concat_ws("\n", head, *lines).alias("value"))


def write_trajectories(results: DataFrame, path: str) -> None:
    """A folder of text files for each sequence."""
    trajectory(results).repartition("sequence").sortWithinPartitions("sequence", "record").select("sequence", "value").write.partitionBy("sequence").text(path)


def _three(c: str) -> Column:
    return F.when(F.col(c).isNull(), "nan").otherwise(F.format_string("%.3f", F.col(c)))


def summary_lines(summary: DataFrame) -> DataFrame:
    """(dataset, value): the report's table rows."""
    value = F.concat(F.rpad("sequence", 32, " "), F.lpad(_three("sr"), 10, " "), F.lpad(_three("ate"), 12, " "), F.lpad(_three("are"), 12, " "), F.lpad(_three("runtime_ms"), 14, " "))
    return summary.select("dataset", value.alias("value"))


def console_line(summary: DataFrame) -> DataFrame:
    """(dataset, sequence, value): one line a sequence."""
    value = F.concat(F.lit("["), F.col("sequence"), F.lit("] success: "), F.concat_ws("/", F.col("successful").cast("string"), F.col("pairs").cast("string")), F.lit(" ("), _three("sr"), F.lit("%), ATE: "), _three("ate"), F.lit(" m, ARE: "), _three("are"), F.lit(" deg, runtime: "), _three("runtime_ms"), F.lit(" ms"))
    return summary.select("dataset", "sequence", value.alias("value"))
