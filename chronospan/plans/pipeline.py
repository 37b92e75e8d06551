"""Typed, immutable chains of column transforms, checked when they are built and again when they run."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import maths
from ..functions.selection import channel_names

SPACES = ("linear", "db")


@dataclass(frozen=True)
class Step:
    """transform takes the channel columns by name and gives the new ones by name."""

    name: str
    transform: Callable[[dict[str, Column]], dict[str, Column]]
    in_space: str = "linear"
    out_space: str = "linear"
    channels_in: tuple[str, ...] | None = None
    channels_out: tuple[str, ...] | None = None
    config: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Pipeline:
    channels: tuple[str, ...]
    space: str = "linear"
    steps: tuple[Step, ...] = ()
    metadata: dict = field(default_factory=dict)

    def output(self) -> tuple[tuple[str, ...], str]:
        channels, space = self.channels, self.space
        for s in self.steps:
            channels, space = self._after(channels, space, s)
        return channels, space

    @staticmethod
    def _after(channels: tuple[str, ...], space: str, step: Step) -> tuple[tuple[str, ...], str]:
        if step.in_space != space:
            raise ValueError(f"{step.name} takes {step.in_space} values, not {space}")
        if step.channels_in is not None and step.channels_in != channels:
            raise ValueError(f"{step.name} takes channels {step.channels_in}, not {channels}")
        return step.channels_out or channels, step.out_space

    def add(self, step: Step, validate: bool = True) -> Pipeline:
        if validate:
            channels, space = self.output()
            self._after(channels, space, step)
            odd = [c for c in channels if "phase" in c.lower() or c.lower() in ("stokes_q", "stokes_u", "stokes_v")]
            if step.name == "safe_db" and odd:
                warnings.warn(f"decibels of signed channels: {odd}", stacklevel=2)
        return replace(self, steps=(*self.steps, step))

    def extend(self, steps) -> Pipeline:
        out = self
        for s in steps:
            out = out.add(s)
        return out

    def with_input_desc(self, channels: tuple[str, ...], space: str | None = None) -> Pipeline:
        """The same steps over other input, checked anew."""
        out = replace(self, channels=tuple(channels), space=self.space if space is None else space)
        if out.space not in SPACES:
            raise ValueError(f"unknown space {out.space!r}")
        out.output()
        return out

    def with_input_channels(self, *names: str) -> Pipeline:
        return self.with_input_desc(tuple(map(str, names)))

    def with_metadata(self, **more) -> Pipeline:
        return replace(self, metadata=self.metadata | more)

    def apply(self, df: DataFrame) -> DataFrame:
        """df with its channel columns replaced by the pipeline's output; one projection for Catalyst."""
        missing = [c for c in self.channels if c not in df.columns]
        if missing:
            raise ValueError(f"no column {missing}")
        self.output()
        columns = {c: F.col(c) for c in self.channels}
        for s in self.steps:
            columns = s.transform(columns)
        return df.select(*[c for c in df.columns if c not in self.channels], *[x.alias(c) for c, x in columns.items()])

    def to_dict(self) -> dict:
        channels, space = self.output()
        return {"input": {"channels": list(self.channels), "space": self.space}, "output": {"channels": list(channels), "space": space}, "metadata": self.metadata, "steps": [{"name": s.name, "config": s.config, "in_space": s.in_space, "out_space": s.out_space} for s in self.steps]}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2, sort_keys=True) + "\n"

    def save_json(self, path: str) -> None:
        """Writes to_json() to a file of the driver's machine, whose folder is made if need be."""
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(self.to_json(), encoding="utf-8")

    def summary(self) -> str:
        return " -> ".join([f"{self.space}{list(self.channels)}", *[s.name for s in self.steps], f"{self.output()[1]}{list(self.output()[0])}"])


def reject_db(pipeline: Pipeline | None, recipe: str) -> None:
    """Raises if the pipeline that a recipe is to start from, its own or the data's, already gives decibels. Call it once the pipeline is known."""
    if pipeline is not None and pipeline.output()[1] == "db":
        raise ValueError(f"{recipe} takes linear values, not decibels")


def panel_layout(n: int) -> tuple[int, int]:
    """Rows and columns of a grid of n panels: one row up to two panels, two columns beyond."""
    return (1, max(1, n)) if n <= 2 else (-(-n // 2), 2)


def panel_labels(n: int, labels: Sequence[str] | None = None, pipeline: Pipeline | None = None, channels: int | Sequence[int] | None = None) -> list[str]:
    """Labels of n panels: the given ones (n of them, or it raises), else the pipeline's output channels, else the channels' names, else ch0, ch1, ..."""
    if labels is not None:
        if len(labels) != n:
            raise ValueError(f"{len(labels)} labels for {n} panels")
        return [str(x) for x in labels]
    for names in (pipeline.output()[0] if pipeline is not None else (), channel_names(channels) if channels is not None else ()):
        if names and len(names) == n or n == 1 and names:
            return list(names[:n])
    return [f"ch{k}" for k in range(n)]


def db_step(floor: float = 1e-12) -> Step:
    if floor <= 0:
        raise ValueError("the floor must be positive")
    return Step("safe_db", lambda c: {k: maths.safe_db(x, floor) for k, x in c.items()}, "linear", "db", config={"floor": floor})


def stokes_i_step() -> Step:
    return Step("stokes_i", lambda c: {"stokes_i": maths.stokes_i(c["pol00"], c["pol11"])}, channels_in=("pol00", "pol11"), channels_out=("stokes_i",))


def stokes_iquv_step() -> Step:
    names = ("pol00", "pol11", "pol01_mag", "pol01_phase")
    out = ("stokes_i", "stokes_q", "stokes_u", "stokes_v")
    return Step("stokes_iquv", lambda c: dict(zip(out, maths.stokes_iquv(*(c[n] for n in names)).values(), strict=True)), channels_in=names, channels_out=out)
