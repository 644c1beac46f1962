"""A Spark data source for PLY files that many tasks read at once.

``spark.read.format("ply").load(path)`` after ``register(spark)``: points (cloud_id, pid, x, y, z).  The vertices of a binary file are records
of one length, so a file is cut into ranges of ``rows`` vertices (an option), each of which one task seeks and reads; ids are the
vertices' numbers in the file, as in ``ply.scan``.  Lines of an ASCII file can't be numbered from the middle, so such a file is one
range.  Only headers are read on the driver.

The path is a file, a folder of ``.ply`` files or a pattern in the last part of the path, on any file system that Arrow opens
from a URI, or a local one that driver and executors share; ``ply.scan`` reads through Spark's own reader instead, whole files at a
time.  A truncated or unreadable file fails at planning, an empty one fails unless the option ``allowEmpty`` is true.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from . import ply

ROWS = 1_000_000
HEAD = 1 << 14


class Range(InputPartition):
    """Vertices ``first`` to ``first + count`` of a file."""

    def __init__(self, path: str, at: ply.Layout, first: int, count: int):
        self.path, self.at, self.first, self.count = path, at, first, count


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """Files and their sizes, by name."""
    system, inner = opened(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(prefix + inner, info.size)]
    folder, pattern = (inner, "*.ply") if info.type == fs.FileType.Directory else inner.rsplit("/", 1)
    found = [i for i in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, pattern)]
    if not found:
        raise FileNotFoundError(path)
    return sorted((prefix + i.path, i.size) for i in found)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.rows = options["path"], int(options.get("rows", ROWS))
        self.allow_empty = str(options.get("allowempty", options.get("allowEmpty", "false"))).lower() == "true"
        if self.rows < 1:
            raise ValueError("a range has one vertex at least")

    def partitions(self) -> list[Range]:
        out = []
        for path, size in listed(self.path):
            system, inner = opened(path)
            with system.open_input_file(inner) as f:
                head, at = b"", None
                while at is None:
                    more = f.read(HEAD)
                    head += more
                    at = ply.header(head)
                    if at is None and not more:
                        raise ValueError(f"{path}: not a PLY file")
            if not at.count and not self.allow_empty:
                raise ValueError(f"{path}: empty cloud")
            if at.record is None:
                out.append(Range(path, at, 0, at.count))
                continue
            if at.begin + at.count * at.record.itemsize > size:
                raise ValueError(f"{path}: fewer vertices than announced")
            out += [Range(path, at, k, min(self.rows, at.count - k)) for k in range(0, at.count, self.rows)]
        return out or [Range("", None, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        system, inner = opened(part.path)
        cloud = part.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        with system.open_input_file(inner) as f:
            if part.at.record is None:
                f.seek(part.at.begin)
                xyz = ply.ascii_vertices(f.read(), part.at)
                pieces = iter([(0, xyz)])
            else:
                width = part.at.record.itemsize
                f.seek(part.at.begin + part.first * width)
                # some ten thousand vertices at a time
                pieces = ((k, ply.binary_vertices(f.read(min(1 << 16, part.count - k) * width), part.at.record)) for k in range(0, part.count, 1 << 16))
            for k, xyz in pieces:
                ids = part.first + k + np.arange(len(xyz))
                yield pa.RecordBatch.from_arrays([pa.array([cloud]).take(pa.array(np.zeros(len(xyz), np.int32))), pa.array(ids), *(pa.array(np.ascontiguousarray(xyz[:, j])) for j in range(3))], names=["cloud_id", "pid", "x", "y", "z"])


class PlyDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        return ply.SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PlyDataSource)


def scan(spark: SparkSession, path: str, rows: int = ROWS, allow_empty: bool = False) -> DataFrame:
    """points (cloud_id, pid, x, y, z) of the files under ``path``, ``rows`` vertices to a task."""
    register(spark)
    return spark.read.format("ply").option("rows", rows).option("allowEmpty", allow_empty).load(path)


def scan_indexed(spark: SparkSession, directory: str, rows: int = ROWS) -> DataFrame:
    """points of ``cloud_bin_<i>.ply`` files, with the index i as scan."""
    points = scan(spark, f"{directory}/cloud_bin_*.ply", rows)
    return points.withColumn("scan", F.regexp_extract("cloud_id", r"^cloud_bin_(\d+)$", 1).cast("int"))
