"""Progress of Spark's tasks."""

import io
import time

import pytest

from orbweave.plans.progress import Progress, Snapshot


def slow(frames):
    for f in frames:
        time.sleep(0.4)
        yield f


def test_numbers_of_tasks(spark):
    out = io.StringIO()
    with Progress(spark, "waiting", out, every=0.1) as seen:
        assert spark.range(0, 12, numPartitions=12).mapInPandas(slow, "id long").count() == 12
    done = [s.done for s in seen.snapshots]
    assert done == sorted(done) and len(set(done)) >= 3  # it was seen on its way
    last = seen.snapshots[-1]
    assert last.done == last.known >= 12 and last.seconds > 1
    assert "waiting [" in out.getvalue() and f"{last.done}/{last.known} tasks" in out.getvalue()
    # jobs after the block, and of other blocks, are not its own
    with Progress(spark, "other", every=5) as other:
        spark.range(0, 3, numPartitions=3).mapInPandas(lambda x: x, "id long").collect()
    assert other.snapshots[-1].known == 3 and seen.look().known == last.known
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


def test_a_block_that_fails_is_left_in_order(spark):
    with pytest.raises(ValueError, match="x"), Progress(spark, "failing") as seen:
        raise ValueError("x")
    assert seen.snapshots[-1].known == 0 and spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


def test_lines():
    assert Snapshot(2.0, 5, 10).line("a", 4) == "a [==  ] 5/10 tasks, 2.5 a second, 2 s left"
    assert Snapshot(0.0, 0, 0).line("a", 4) == "a [    ] 0/0 tasks, 0.0 a second, no estimate"
