"""PLY point clouds: scan of files into points, and files from points."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed names of the format's scalar types.
TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
SCHEMA = "cloud_id string, pid long, x double, y double, z double"


class Layout(NamedTuple):
    """Where the vertices of a file are: its form, the bytes or lines before them, their number, their names and (binary) their record."""

    form: str
    begin: int
    lines: int
    count: int
    names: list[str]
    record: np.dtype | None


def header(head: bytes) -> Layout | None:
    """The layout that the beginning of a file tells; None if its header goes on, ValueError if it can't be read."""
    end = re.search(rb"end_header\r?\n", head)
    if not head.startswith(b"ply"[: len(head)]) or not head:
        raise ValueError("not a PLY file")
    if not end:
        return None
    form, elements = None, []
    for line in head[: end.start()].decode("ascii", "replace").split("\n"):
        words = line.split()
        if words[:1] == ["format"]:
            form = words[1]
        elif words[:1] == ["element"]:
            elements.append((words[1], int(words[2]), []))
        elif words[:1] == ["property"]:
            elements[-1][2].append(words[1:])
    begin, lines = end.end(), 0
    for name, count, properties in elements:
        names = [p[-1] for p in properties]
        if name != "vertex":
            if any(p[0] == "list" for p in properties) and form != "ascii":
                raise ValueError("elements with lists before the vertices")
            if form == "ascii":
                lines += count
            else:
                begin += count * sum(np.dtype(TYPES[p[0]]).itemsize for p in properties)
            continue
        if any(p[0] == "list" for p in properties) or not {"x", "y", "z"} <= set(names):
            raise ValueError("vertices without plain x, y, z")
        if form == "ascii":
            return Layout(form, begin, lines, count, names, None)
        order = {"binary_little_endian": "<", "binary_big_endian": ">"}.get(form or "")
        if order is None:
            raise ValueError(f"unknown format {form}")
        return Layout(form, begin, 0, count, names, np.dtype([(n, order + TYPES[p[0]]) for n, p in zip(names, properties, strict=True)]))
    raise ValueError("no vertices")


def ascii_vertices(body: bytes, at: Layout) -> np.ndarray:
    """The vertices of the bytes behind the header of an ASCII file."""
    rows = body.split(b"\n")[at.lines : at.lines + at.count]
    table = np.array([[float(w) for w in row.split()[: len(at.names)]] for row in rows]).reshape(-1, len(at.names))
    if len(table) != at.count:
        raise ValueError("fewer vertices than announced")
    return table[:, [at.names.index(c) for c in "xyz"]]


def binary_vertices(records: bytes, record: np.dtype) -> np.ndarray:
    table = np.frombuffer(records, record)
    return np.stack([table[c].astype(float) for c in "xyz"], axis=1)


def parse(blob: bytes) -> np.ndarray:
    """The vertices' x, y, z (n x 3 doubles) of a file in ASCII or binary form; ValueError if it can't be read."""
    at = header(blob)
    if at is None:
        raise ValueError("not a PLY file")
    if at.record is None:
        return ascii_vertices(blob[at.begin :], at)
    end = at.begin + at.count * at.record.itemsize
    if len(blob) < end:
        raise ValueError("fewer vertices than announced")
    return binary_vertices(blob[at.begin : end], at.record)


def render(xyz: np.ndarray, ascii_form: bool = False) -> bytes:
    """A file of double coordinates."""
    head = f"ply\nformat {'ascii' if ascii_form else 'binary_little_endian'} 1.0\nelement vertex {len(xyz)}\nproperty double x\nproperty double y\nproperty double z\nend_header\n".encode()
    if ascii_form:
        return head + "".join(" ".join(map(repr, row)) + "\n" for row in xyz.tolist()).encode()
    return head + np.ascontiguousarray(xyz, "<f8").tobytes()


def scan(spark: SparkSession, path: str, allow_empty: bool = False) -> DataFrame:
    """points (cloud_id, pid, x, y, z) of the files under ``path`` (a glob); cloud_id is the file's name without suffix.

    Files come through Spark's own reader, one a row, so any file system works; an unreadable or empty file fails.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, blob in zip(pdf["path"], pdf["content"], strict=True):
                xyz = parse(bytes(blob))
                if not len(xyz) and not allow_empty:
                    raise ValueError(f"{name}: empty cloud")
                yield pd.DataFrame({"cloud_id": name.rsplit("/", 1)[-1].rsplit(".", 1)[0], "pid": np.arange(len(xyz)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def scan_indexed(spark: SparkSession, directory: str) -> DataFrame:
    """points of ``cloud_bin_<i>.ply`` files, with the index i as scan."""
    points = scan(spark, f"{directory}/cloud_bin_*.ply")
    return points.withColumn("scan", F.regexp_extract("cloud_id", r"^cloud_bin_(\d+)$", 1).cast("int"))


def files(points: DataFrame) -> DataFrame:
    """(cloud_id, content): one binary file a cloud, points in id order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pid")
        return pd.DataFrame({"cloud_id": [pdf["cloud_id"].iloc[0]], "content": [render(pdf[["x", "y", "z"]].to_numpy(float))]})

    kind = points.schema["cloud_id"].dataType.simpleString()
    return points.groupBy("cloud_id").applyInPandas(run, f"cloud_id {kind}, content binary")
