"""Channels and frequency masks: names, bounds, ranges, precedence."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The channels of a measurement, by index.
CHANNELS = ("pol00", "pol11", "pol01_mag", "pol01_phase")


def channel_names(indices: int | Sequence[int]) -> tuple[str, ...]:
    """Names of channel indices; an index without a name is chanN."""
    wanted = (indices,) if isinstance(indices, int) else tuple(int(i) for i in indices)
    return tuple(CHANNELS[i] if 0 <= i < len(CHANNELS) else f"chan{i}" for i in wanted)


def check_channels(indices: int | Sequence[int], n: int = len(CHANNELS)) -> tuple[int, ...]:
    wanted = (indices,) if isinstance(indices, int) else tuple(int(i) for i in indices)
    if not wanted:
        raise ValueError("no channel is selected")
    outside = [i for i in wanted if not 0 <= i < n]
    if outside:
        raise ValueError(f"channels {outside} lie outside 0 to {n - 1}")
    return wanted


def select_channels(rows: DataFrame, indices: int | Sequence[int], keys: list[str], names: Sequence[str] = CHANNELS, stacked: str | None = None) -> DataFrame:
    """keys and the selected channels as columns in the given order, or as one array column ``stacked`` (one channel: its values, not an array)."""
    wanted = [names[i] for i in check_channels(indices, len(names))]
    if stacked is None:
        return rows.select(*keys, *wanted)
    return rows.select(*keys, F.col(wanted[0]).alias(stacked) if len(wanted) == 1 else F.array(*wanted).alias(stacked))


def check_slice(start: int, stop: int, n: int) -> None:
    if not 0 <= start < stop <= n:
        raise ValueError(f"no frequency range {start} to {stop} of {n}")


def freq_slice(rows: DataFrame, start: int, stop: int, n: int, f: str = "f_idx") -> DataFrame:
    """Rows of [start, stop) of n frequencies."""
    check_slice(start, stop, n)
    return rows.where((F.col(f) >= start) & (F.col(f) < stop))


@dataclass(frozen=True)
class FreqMask:
    """Which of n frequencies are kept, as ranges [start, stop) that are left out: small, whatever n is."""

    n: int
    out: tuple[tuple[int, int], ...] = ()

    @classmethod
    def without(cls, n: int, start: int, stop: int) -> FreqMask:
        """All but [start, stop), clamped to [0, n]; stop <= start leaves all."""
        lo, hi = min(max(start, 0), n), min(max(stop, 0), n)
        return cls(n, ((lo, hi),) if hi > lo else ())

    @classmethod
    def of(cls, keep: Sequence[bool]) -> FreqMask:
        """From a flag per frequency."""
        ends, begin = [], None
        for i, k in enumerate([*map(bool, keep), True]):
            if not k and begin is None:
                begin = i
            elif k and begin is not None:
                ends.append((begin, i))
                begin = None
        return cls(len(keep), tuple(ends))

    @property
    def size(self) -> int:
        return self.n - sum(hi - lo for lo, hi in self.out)

    def keeps(self, f: Column) -> Column:
        """Whether a frequency index is kept; reaches the scan as plain comparisons."""
        kept = F.lit(True)
        for lo, hi in self.out:
            kept = kept & ((f < lo) | (f >= hi))
        return kept

    def rows(self, df: DataFrame, f: str = "f_idx") -> DataFrame:
        return df.where(self.keeps(F.col(f)))

    def array(self, values: Column | str) -> Column:
        """The kept entries of an array with one entry per frequency."""
        return F.filter(values, lambda _, i: self.keeps(i))


def effective_mask(runner: FreqMask | None, selector: FreqMask | None, background: FreqMask | None) -> FreqMask | None:
    """The runner's mask before the selector's before the background's; two different ones of selector and background raise, whatever the runner has."""
    if selector is not None and background is not None and selector != background:
        raise ValueError("the masks of selector and background differ")
    return next((m for m in (runner, selector, background) if m is not None), None)
