"""Nested timers that also name Spark's jobs."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


class Timers:
    """Named times, nested as their blocks are; a block that fails is timed as well."""

    def __init__(self, spark: SparkSession | None = None):
        self.spark, self.stack = spark, []
        self.lines: list[tuple[int, str, float]] = []

    @contextmanager
    def time(self, name: str) -> Iterator[None]:
        place, began = len(self.lines), time.perf_counter()
        self.lines.append((len(self.stack), name, 0.0))
        self.stack.append(name)
        self._describe()
        try:
            yield
        finally:
            self.stack.pop()
            self._describe()
            self.lines[place] = (len(self.stack), name, (time.perf_counter() - began) * 1000)

    def _describe(self) -> None:
        if self.spark is not None:
            self.spark.sparkContext.setJobDescription(" / ".join(self.stack) or None)

    def report(self) -> str:
        return "\n".join(f"{'  ' * depth}{name}: {ms:.3f} ms" for depth, name, ms in self.lines)
