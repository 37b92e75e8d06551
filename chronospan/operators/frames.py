"""Sliding frames over a sample grid, and access to single frames."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import FramePlan


def frames(spark: SparkSession, plan: FramePlan) -> DataFrame:
    """frame_idx, t_start_idx, t_end_idx (exclusive), start_us."""
    start = F.col("id") * plan.step_n + plan.i_start
    return spark.range(plan.n_frames).select(F.col("id").alias("frame_idx"), start.alias("t_start_idx"), (start + plan.window_n).alias("t_end_idx"), F.floor((F.lit(plan.t0) + start * plan.dt) * 1e6 + 0.5).alias("start_us"))


def assign(samples: DataFrame, plan: FramePlan, t: str = "t_idx") -> DataFrame:
    """samples with a row for each frame that holds them (frame_idx). In closed form, so neither a join nor a shuffle is needed.

    Frames without samples have no row; with_plan() brings them back.
    """
    x = F.col(t) - plan.i_start
    lo = F.greatest(F.lit(0), F.ceil((x - plan.window_n + 1) / plan.step_n))
    hi = F.least(F.lit(plan.n_frames - 1), F.floor(x / plan.step_n))
    ranged = samples.where((F.col(t) >= plan.i_start) & (F.col(t) < plan.i_stop)).withColumn("_lo", lo).withColumn("_hi", hi)
    # sequence() counts down where lo > hi, hence the filter.
    return ranged.where("_lo <= _hi").withColumn("frame_idx", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")


def with_plan(per_frame: DataFrame, plan: FramePlan, counts: tuple[str, ...] = (), groups: DataFrame | None = None) -> DataFrame:
    """All frames of the plan (of each row of ``groups``, say stations) with the columns of per_frame, NULL for frames without samples; ``counts`` become 0."""
    spark = per_frame.sparkSession
    keys = [*(groups.columns if groups is not None else ()), "frame_idx"]
    wanted = frames(spark, plan).select("frame_idx")
    if groups is not None:
        wanted = groups.withColumn("frame_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(plan.n_frames - 1).cast("long"))))
    out = wanted.join(per_frame, keys, "left")
    return out.fillna(0, list(counts)) if counts else out


def patch(samples: DataFrame, start: int, n: int, t: str = "t_idx", nt: int | None = None) -> DataFrame:
    """The n samples from start on; with nt, a patch that leaves the grid of nt samples raises."""
    if n <= 0 or start < 0:
        raise ValueError("a patch needs a start of 0 or more and a length")
    if nt is not None and start + n > nt:
        raise ValueError(f"samples {start} to {start + n} leave the grid of {nt}")
    return samples.where((F.col(t) >= start) & (F.col(t) < start + n))


def load_at(samples: DataFrame, plan: FramePlan, t_start: int, t: str = "t_idx", nt: int | None = None) -> DataFrame:
    """The frame that begins at any sample, on the plan or not; its frame_idx is -1."""
    return patch(samples, t_start, plan.window_n, t, nt).withColumn("frame_idx", F.lit(-1).cast("long"))


def frame_at(samples: DataFrame, plan: FramePlan, i: int, t: str = "t_idx") -> DataFrame:
    """Frame i of the plan; indices below 0 or behind the last raise IndexError."""
    if not 0 <= i < plan.n_frames:
        raise IndexError(f"no frame {i} of {plan.n_frames}")
    return patch(samples, plan.i_start + i * plan.step_n, plan.window_n, t).withColumn("frame_idx", F.lit(i).cast("long"))


def in_order(framed: DataFrame, *rest: str) -> DataFrame:
    """Rows in the order of their frames (a range-partitioned sort, so that toLocalIterator() goes frame by frame)."""
    return framed.orderBy("frame_idx", *rest)


def random_frame(samples: DataFrame, plan: FramePlan, seed: int, t: str = "t_idx") -> DataFrame:
    """One frame of the plan, each equally likely; the same for the same seed."""
    return frame_at(samples, plan, random.Random(seed).randrange(plan.n_frames), t)


def frame_batch(samples: DataFrame, plan: FramePlan, indices: list[int], t: str = "t_idx") -> DataFrame:
    """samples of the listed frames with pos (place in the list) and frame_idx; duplicates come as often as they are listed."""
    for i in indices:
        if not 0 <= i < plan.n_frames:
            raise IndexError(f"no frame {i} of {plan.n_frames}")
    wanted = samples.sparkSession.createDataFrame([(p, i) for p, i in enumerate(indices)], "pos long, frame_idx long")
    # The list is a parameter; the samples of its frames alone are exploded.
    starts = [plan.i_start + i * plan.step_n for i in set(indices)]
    lo, hi = (min(starts), max(starts) + plan.window_n) if starts else (0, 0)
    return assign(samples.where((F.col(t) >= lo) & (F.col(t) < hi)), plan, t).join(F.broadcast(wanted), "frame_idx")
