"""How far Spark's tasks are, while a block runs: done and known tasks, tasks a second, and the time that is left."""

from __future__ import annotations

import sys
import threading
import time
import uuid
from dataclasses import dataclass
from typing import TextIO

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Snapshot:
    """Tasks of the block's jobs so far; later jobs are not known yet."""

    seconds: float
    done: int
    known: int

    @property
    def rate(self) -> float:
        return self.done / self.seconds if self.seconds else 0.0

    def line(self, name: str, width: int = 24) -> str:
        full = width * self.done // self.known if self.known else 0
        left = f"{(self.known - self.done) / self.rate:.0f} s left" if self.done else "no estimate"
        return f"{name} [{'=' * full}{' ' * (width - full)}] {self.done}/{self.known} tasks, {self.rate:.1f} a second, {left}"


class Progress:
    """Watches the jobs that its block starts, in a group of their own; ``snapshots`` holds what it saw, one at the end at least.

    With ``out`` a line is written over the last one every ``every`` seconds.  The group that the session had is not known to
    PySpark, so a block has none afterwards.
    """

    def __init__(self, spark: SparkSession, name: str, out: TextIO | None = None, every: float = 1.0):
        self.context, self.name, self.out, self.every = spark.sparkContext, name, out, every
        self.group, self.snapshots = f"progress-{uuid.uuid4().hex}", []
        self._over = threading.Event()

    def look(self) -> Snapshot:
        tracker, done, known = self.context.statusTracker(), 0, 0
        for job in tracker.getJobIdsForGroup(self.group):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else []:
                tasks = tracker.getStageInfo(stage)
                if tasks:  # what an ended job has not run was there from an earlier one
                    done, known = done + tasks.numCompletedTasks, known + (tasks.numCompletedTasks if info.status == "SUCCEEDED" else tasks.numTasks)
        return Snapshot(time.perf_counter() - self._began, done, known)

    def _watch(self) -> None:
        while not self._over.wait(self.every):
            self._keep()

    def _keep(self) -> None:
        self.snapshots.append(self.look())
        if self.out is not None:
            print("\r" + self.snapshots[-1].line(self.name), end="", file=self.out, flush=True)

    def __enter__(self) -> Progress:
        self._began = time.perf_counter()
        self.context.setJobGroup(self.group, self.name)
        self._thread = threading.Thread(target=self._watch, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._over.set()
        self._thread.join()
        self._keep()
        if self.out is not None:
            print(file=self.out)
        for key in ("spark.jobGroup.id", "spark.job.description"):
            self.context.setLocalProperty(key, None)


def to_terminal() -> TextIO | None:
    """Standard error, if somebody looks at it."""
    return sys.stderr if sys.stderr.isatty() else None
