"""The streaming runner with a state per frame: disordered and late frames, against the runner over a table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronospan.operators import rolling
from chronospan.streaming import rolling as streaming
from tests.test_rolling_scores import H
from tests.test_rolling_scores import make as made

START, STOP = 30 * H, 64 * H


def make(spark):
    """The frames of the other tests, a day later: a watermark begins at 0 and lets nothing of that time through."""
    return made(spark)[2].withColumn("start_us", F.col("start_us") + 24 * H)


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    streaming.use_rocksdb(spark)
    yield
    spark.conf.set(key, before)


def replay(spark, frames, batches, c, tmp_path, delay):
    """The windows that fire when the listed batches (conditions on frames) arrive one after the other, and the query's progress."""
    for k, condition in enumerate(batches):
        frames.where(condition).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.run(stream, START, STOP, c, ["station"], delay=delay).writeStream.format("memory").queryName("fired").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return {(r["station"], r["window_us"]): r for r in spark.table("fired").collect()}, q.recentProgress


def same(got, want):
    for key, g in got.items():
        w = want[key]
        assert (g["status"], g["n_context"], g["n_quiet"], g["frame_idx"]) == (w["status"], w["n_context"], w["n_quiet"], w["frame_idx"] or [])
        assert np.allclose(g["score"], w["score"] or [], equal_nan=True)


def test_disorder_and_late_frames(spark, rocksdb, tmp_path):
    """Frames of each 8 hours arrive in two halves, the earlier ones last; some come far too late and are dropped."""
    frames = make(spark)
    c = rolling.RollingConfig(context_us=12 * H, k=2, method="l2")
    too_late = F.expr("station = 'A' and frame_idx in (20, 21)")
    part = F.floor(F.col("start_us") / (4 * H)) - 6
    order = [1, 0, 3, 2, 5, 4, 7, 6, 9, 8]
    batches = [(part == k) & ~too_late for k in order[:6]] + [too_late] + [(part == k) & ~too_late for k in order[6:]]
    got, progress = replay(spark, frames, batches, c, tmp_path, "9 hours")
    of = lambda df: {(r["station"], r["window_us"]): r for r in rolling.run(df, START, STOP, c, ["station"]).where("status <> 'not_fired'").collect()}
    want = of(frames.where(~too_late))
    same(got, want)
    # Windows up to the watermark have fired: nine hours behind the last frame.
    last = frames.where("station = 'A'").agg(F.max("start_us")).first()[0]
    assert {h for s, h in got if s == "A"} == {h for s, h in want if s == "A" and h + 6 * H <= last - 9 * H} and len(got) > 10
    full = of(frames)
    assert any(want[k]["n_context"] != full[k]["n_context"] for k in got)  # the dropped frames would have been seen


def test_state_written_follows_new_frames(spark, rocksdb, tmp_path):
    """With a context of all frames, a trigger updates the rows that it brings and a few facts, not the context."""
    frames = make(spark).where("station = 'A'")
    c = rolling.RollingConfig(context_us=30 * H, k=1, method="l2", ring_capacity=100)
    batches = [F.floor(F.col("frame_idx") / 12) == k for k in range(12)]
    got, progress = replay(spark, frames, batches, c, tmp_path, "0 seconds")
    updated = [p["stateOperators"][0]["numRowsUpdated"] for p in progress if p["numInputRows"]]
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["numInputRows"]]
    assert max(updated) <= 12 + 6 and max(held) > 90
    want = {(r["station"], r["window_us"]): r for r in rolling.run(frames, START, STOP, c, ["station"]).collect()}
    same(got, want)
    assert len(got) >= 5
