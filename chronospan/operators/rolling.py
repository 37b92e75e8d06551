"""Centred rolling contexts: which frames each scoring window fits and scores, and their scores against a rolling PCA."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.selection import FreqMask, effective_mask
from . import background, metrics

HOUR = 3_600_000_000


def windows(frames: DataFrame, start_us: int, stop_us: int, context_us: int, stride_us: int = HOUR, score_us: int = HOUR, gap_us: int = 0, by: list[str] | None = None, ts: str = "start_us") -> DataFrame:
    """frames with a row per window that uses them: window_us, in_fit, in_score.

    Windows start at first hour >= start_us, every stride_us, before stop_us. A window fits the frames of
    [h - c/2, h + c/2) less the gap [h - g/2, h + score + g/2) and scores those of [h, h + score). It fires only if
    some frame of its group starts at h + c/2 or later. Frames find their windows in closed form, without a range join.
    """
    if not 0 < score_us <= stride_us:
        raise ValueError("score hours must be above 0 and at most the stride")
    by = by or []
    first = -(-start_us // HOUR) * HOUR
    count = max(0, -(-(stop_us - first) // stride_us))
    half = context_us // 2
    t = F.col(ts) - first
    lo = F.greatest(F.lit(0), F.floor((t - max(half, score_us)) / stride_us))
    hi = F.least(F.lit(count - 1), F.ceil((t + half) / stride_us))
    last = frames.groupBy(*by).agg(F.max(ts).alias("_last"))
    out = frames.withColumn("_lo", lo).withColumn("_hi", hi).where("_lo <= _hi").withColumn("_w", F.explode(F.sequence("_lo", "_hi")))
    out = out.withColumn("window_us", F.col("_w") * stride_us + first).drop("_lo", "_hi", "_w")
    h, x = F.col("window_us"), F.col(ts)
    in_fit = (x >= h - half) & (x < h + half)
    if gap_us > 0:
        in_fit = in_fit & ~((x >= h - gap_us // 2) & (x < h + score_us + gap_us // 2))
    out = out.withColumn("in_fit", in_fit).withColumn("in_score", (x >= h) & (x < h + score_us)).where("in_fit or in_score")
    out = out.join(last, by) if by else out.crossJoin(F.broadcast(last))
    return out.where(F.col("_last") >= h + half).drop("_last")


@dataclass(frozen=True)
class RollingConfig:
    """A rolling PCA run. Times in microseconds; ``mask`` keeps entries of the feature arrays.

    ring_capacity limits a window's context to what a first-in-first-out buffer of so many frames holds when the window
    fires (the frame that fires it takes one place); see ring_capacity(). block: windows that a task works on together.
    """

    context_us: int = 24 * HOUR
    stride_us: int = HOUR
    score_us: int = HOUR
    gap_us: int = 0
    k: int = 16
    quiet_fraction: float = 0.3
    n_quiet: int | None = None
    quiet_method: str = "p99"
    quiet_options: dict = field(default_factory=dict)
    method: str = "topk_sum"
    score_options: dict = field(default_factory=lambda: {"min_finite_frac": 0.7, "normalize_missing": True})
    positive_only: bool = True
    center: bool = True
    ring_capacity: int | None = None
    runner_mask: FreqMask | None = None
    selector_mask: FreqMask | None = None
    background_mask: FreqMask | None = None
    block: int = 6

    def __post_init__(self):
        if not 0 < self.score_us <= self.stride_us:
            raise ValueError("score hours must be above 0 and at most the stride")
        if self.context_us <= 0 or self.gap_us < 0 or self.k < 0 or self.block < 1:
            raise ValueError("the context must be positive, gap and k not negative, a block at least one window")
        if not 0 < self.quiet_fraction <= 1:
            raise ValueError("the quiet fraction lies outside (0, 1]")
        if self.ring_capacity is not None and self.ring_capacity < 1:
            raise ValueError("a ring holds at least one frame")
        for method, options in ((self.quiet_method, self.quiet_options), (self.method, self.score_options)):
            metrics.check(method, **options)
        effective_mask(self.runner_mask, self.selector_mask, self.background_mask)

    @property
    def mask(self) -> FreqMask | None:
        return effective_mask(self.runner_mask, self.selector_mask, self.background_mask)


def ring_capacity(context_hours: float, step_s: float) -> int:
    """Frames that the buffer of a run holds: the context times the frames of an hour, both rounded up."""
    if step_s <= 0:
        raise ValueError("the step must be positive")
    return math.ceil(context_hours * math.ceil(3600 / step_s))


def starts(rows: DataFrame, by: list[str], ts: str, stride_us: int = HOUR) -> DataFrame:
    """by, window_us: scoring starts of each group, from the first whole hour at or after its first time, before its last."""
    if stride_us <= 0:
        raise ValueError("the stride must be positive")
    ends = rows.groupBy(*by).agg((F.ceil(F.min(ts) / HOUR) * HOUR).alias("_lo"), F.max(ts).alias("_hi"))
    return ends.where("_lo < _hi").select(*by, F.explode(F.sequence(F.col("_lo"), F.col("_hi") - 1, F.lit(stride_us))).alias("window_us"))


def n_steps(start_us: int, stop_us: int, stride_us: int) -> int:
    """Planned windows from the first whole hour at or after start, before stop; skipped ones count."""
    return max(0, -(-(stop_us - -(-start_us // HOUR) * HOUR) // stride_us))


def place(frames: DataFrame, first: int, n_blocks: int, c: RollingConfig, ts: str = "_t") -> DataFrame:
    """frames with a row for each block of windows (_block) of which one holds or scores them, in closed form."""
    span, half, t = c.block * c.stride_us, c.context_us // 2, F.col(ts) - first
    lo = F.greatest(F.lit(0), F.ceil((t - (span - c.stride_us) - max(half, c.score_us)) / span))
    hi = F.least(F.lit(n_blocks - 1), F.floor((t + half) / span))
    return frames.withColumn("_lo", lo.cast("long")).withColumn("_hi", hi.cast("long")).where("_lo <= _hi").withColumn("_block", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")


#: What became of a window.
SCORED, NOT_FIRED, EMPTY_CONTEXT, ALL_IN_GAP, NO_QUIET, NOTHING_TO_SCORE = "scored", "not_fired", "empty_context", "all_in_gap", "no_quiet", "nothing_to_score"


def choose(t: np.ndarray, ids: np.ndarray, quiet: np.ndarray, whole: np.ndarray, h: int, last: int, c: RollingConfig) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """(status, held frames, those it fits, those it scores) of the window at h, as places; frames are in time order, whole are those without a gap."""
    none, half = np.empty(0, np.int64), c.context_us // 2
    if last < h + half:
        return NOT_FIRED, none, none, none
    held = np.flatnonzero((t >= h - half) & (t < h + half))
    if c.ring_capacity is not None:
        before = int(np.searchsorted(t, h + half))
        held = held[held >= before - (c.ring_capacity - 1)]
    if not len(held):
        return EMPTY_CONTEXT, none, none, none
    fit = held
    if c.gap_us > 0:
        fit = held[~((t[held] >= h - c.gap_us // 2) & (t[held] < h + c.score_us + c.gap_us // 2))]
        if not len(fit):
            return ALL_IN_GAP, held, none, none
    real = fit[np.isfinite(quiet[fit])]
    n = len(real)
    count = max(1, int(np.floor(n * c.quiet_fraction))) if c.n_quiet is None else max(1, min(c.n_quiet, n))
    chosen = real[np.lexsort((ids[real], quiet[real]))][:count]
    chosen = np.sort(chosen[whole[chosen]])
    if not len(chosen):
        return NO_QUIET, held, none, none
    scored = held[(t[held] >= h) & (t[held] < h + c.score_us)]
    return (SCORED if len(scored) else NOTHING_TO_SCORE), held, chosen, scored


def _window(t: np.ndarray, ids: np.ndarray, x: np.ndarray, quiet: np.ndarray, h: int, last: int, c: RollingConfig) -> tuple:
    """(status, n_context, n_quiet, scored frames, their scores) of the window at h; frames are in time order."""
    status, held, chosen, scored = choose(t, ids, quiet, np.isfinite(x).all(axis=1), h, last, c)
    if status != SCORED:
        return status, len(held), len(chosen), np.empty(0, np.int64), np.empty(0)
    mean, basis, _ = background.pca_basis(x[chosen], c.k, c.center)
    res = background.residuals(x[scored].astype(np.float64), mean, basis)
    if c.positive_only:
        res = np.maximum(res, 0.0)
    return SCORED, len(held), len(chosen), ids[scored], metrics.array_scores(res, c.method, **c.score_options)


def ranked(ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Places by falling score, missing ones first, ties by number."""
    return np.lexsort((ids, -np.where(np.isfinite(scores), scores, np.inf), ~np.isnan(scores)))


def run(frames: DataFrame, start_us: int, stop_us: int, config: RollingConfig, by: list[str], ts: str = "start_us", features: str = "features", last: DataFrame | None = None) -> DataFrame:
    """by, window_us, status, n_context, n_quiet, frame_idx and score (arrays, in time order), rank_idx: one row per planned window of each group.

    frames: by, frame_idx, ts, features (array of values, NaN or NULL where missing). Windows of a group are worked on in
    blocks: a frame goes once to each block that needs it, (context + block) / block times in all, and no row per pixel or
    per window and frame is made. A task holds the frames of one block's windows, as 32-bit numbers. rank_idx: places
    in the arrays by falling score, missing ones first. Windows without a row of frames within reach are empty_context.
    last: by, _last (the time of each group's last frame), where it is known without another pass over the frames.
    """
    first = -(-start_us // HOUR) * HOUR
    count = n_steps(start_us, stop_us, config.stride_us)
    c = config
    span = c.block * c.stride_us
    n_blocks = -(-count // c.block)
    types = dict(frames.dtypes)
    values = c.mask.array(features) if c.mask is not None else F.col(features)
    ready = frames.select(*by, F.col("frame_idx").cast("long").alias("frame_idx"), F.col(ts).cast("long").alias("_t"), values.cast("array<float>").alias("_x"))
    last = ready.groupBy(*by).agg(F.max("_t").alias("_last")) if last is None else last.select(*by, "_last")
    placed = place(ready, first, n_blocks, c)
    placed = placed.join(F.broadcast(last), by) if by else placed.crossJoin(F.broadcast(last))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_t", "frame_idx"], kind="stable")
        at, ids = pdf["_t"].to_numpy(np.int64), pdf["frame_idx"].to_numpy(np.int64)
        x = np.stack([np.asarray(v, np.float32) for v in pdf["_x"]])
        quiet = metrics.array_scores(x, c.quiet_method, **c.quiet_options)
        b, latest = int(pdf["_block"].iloc[0]), int(pdf["_last"].iloc[0])
        out = []
        for w in range(b * c.block, min((b + 1) * c.block, count)):
            h = first + w * c.stride_us
            status, n_context, n_quiet, scored, values = _window(at, ids, x, quiet, h, latest, c)
            out.append((h, status, n_context, n_quiet, scored.tolist(), values.tolist(), ranked(scored, values).tolist()))
        done = pd.DataFrame(out, columns=["window_us", "status", "n_context", "n_quiet", "frame_idx", "score", "rank_idx"])
        for k in by:
            done[k] = pdf[k].iloc[0]
        return done[[*by, "window_us", "status", "n_context", "n_quiet", "frame_idx", "score", "rank_idx"]]

    kinds = "".join(f"`{k}` {types[k]}, " for k in by)
    found = placed.groupBy(*by, "_block").applyInPandas(work, kinds + "window_us long, status string, n_context long, n_quiet long, frame_idx array<long>, score array<double>, rank_idx array<long>")
    return _planned(found, last, first, count, c, by)


def _planned(found: DataFrame, last: DataFrame, first: int, count: int, c: RollingConfig, by: list[str]) -> DataFrame:
    """found and a row for each planned window of each group that has none."""
    half = c.context_us // 2
    planned = last.withColumn("window_us", F.explode(F.sequence(F.lit(first), F.lit(first + (count - 1) * c.stride_us), F.lit(c.stride_us)))) if count else last.where("false").withColumn("window_us", F.lit(0).cast("long"))
    out = planned.join(found, [*by, "window_us"], "left")
    absent = F.when(F.col("_last") < F.col("window_us") + half, NOT_FIRED).otherwise(EMPTY_CONTEXT)
    return out.select(*by, "window_us", F.coalesce("status", absent).alias("status"), F.coalesce("n_context", F.lit(0)).cast("long").alias("n_context"), F.coalesce("n_quiet", F.lit(0)).cast("long").alias("n_quiet"), "frame_idx", "score", "rank_idx")


def frame_scores(windows_: DataFrame, by: list[str]) -> DataFrame:
    """by, window_us, frame_idx, score of the scored windows of run(); a score that can't be given is NULL."""
    rows = windows_.where(F.col("status") == SCORED).select(*by, "window_us", F.explode(F.arrays_zip("frame_idx", "score")).alias("p"))
    return rows.select(*by, "window_us", F.col("p.frame_idx").alias("frame_idx"), F.when(~F.isnan("p.score"), F.col("p.score")).alias("score"))


def status_counts(windows_: DataFrame, by: list[str]) -> DataFrame:
    """by, status, n: how many windows were scored, and why the others were skipped."""
    return windows_.groupBy(*by, "status").agg(F.count("*").alias("n"))
