"""Time grid arithmetic: sample indices, frame plans and scoring windows.

Index arithmetic stays in doubles counted from the grid's start, as a cadence need not be a whole number of
microseconds; nothing is accumulated.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

UTC_FORMAT, UTC_SPARK = "%Y%m%d_%H%M%S", "yyyyMMdd_HHmmss"


def parse_utc(text: str) -> datetime:
    return datetime.strptime(text, UTC_FORMAT).replace(tzinfo=timezone.utc)


def unix_seconds(ts: Column) -> Column:
    """Seconds since 1970 as a double, of a timestamp with or without zone (the session's zone is taken to be UTC)."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def seconds_to_samples(seconds: float, dt: float, least: int = 1) -> int:
    """Halves round up."""
    return max(least, math.floor(seconds / dt + 0.5))


def time_index(unix_s: Column, t0: float, dt: float) -> Column:
    return F.floor((unix_s - t0) / dt + 0.5)


def clamp(x: int, lo: int, hi: int) -> int:
    return min(max(x, lo), hi)


@dataclass(frozen=True)
class FramePlan:
    i_start: int
    i_stop: int
    window_n: int
    step_n: int
    dt: float
    t0: float

    @property
    def n_frames(self) -> int:
        return (self.i_stop - self.window_n - self.i_start) // self.step_n + 1


def plan_frames(nt: int, t0: float, dt: float, start: float, stop: float, window_s: float, step_s: float) -> FramePlan:
    """Frames of window_s seconds every step_s seconds within [start, stop], clamped to the nt samples from t0."""
    if window_s <= 0 or step_s <= 0 or dt <= 0:
        raise ValueError("durations must be positive")
    if stop < start:
        raise ValueError("stop lies before start")
    lo, hi = (clamp(math.floor((x - t0) / dt + 0.5), 0, nt) for x in (start, stop))
    plan = FramePlan(lo, hi, seconds_to_samples(window_s, dt), seconds_to_samples(step_s, dt), dt, t0)
    if hi - lo < plan.window_n:
        raise ValueError("the range is shorter than one window")
    return plan


def hour_starts(start: datetime, stop: datetime, stride_hours: float) -> list[datetime]:
    """Scoring starts: from the first whole hour at or after start, before stop."""
    if stride_hours <= 0:
        raise ValueError("the stride must be positive")
    at = start.replace(minute=0, second=0, microsecond=0)
    if at < start:
        at += timedelta(hours=1)
    out = []
    while at < stop:
        out.append(at)
        at += timedelta(hours=stride_hours)
    return out


def padded_range(start: datetime, stop: datetime, context_hours: float) -> tuple[str, str]:
    half = timedelta(hours=context_hours / 2)
    return (start - half).strftime(UTC_FORMAT), (stop + half).strftime(UTC_FORMAT)
