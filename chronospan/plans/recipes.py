"""Quick looks: four panels from four channels, in the units that they are shown in.

A recipe starts from linear values. Which pipeline its rows come through is settled first, its own or else the data's; if that gives
decibels, the recipe refuses it, since decibels of decibels would look like data.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import maths
from ..functions.selection import CHANNELS
from .pipeline import Pipeline, reject_db, stokes_iquv_step


@dataclass(frozen=True)
class Recipe:
    """Panels (column, unit, whether 0 is in the middle of its colours), the channels they need and how they follow from these."""

    name: str
    needs: tuple[str, ...]
    panels: tuple[tuple[str, str, bool], ...]
    make: Callable[..., list[Column]]

    @property
    def labels(self) -> tuple[str, ...]:
        return tuple(p[0] for p in self.panels)

    def apply(self, rows: DataFrame, keys: list[str], pipeline: Pipeline | None = None, data_pipeline: Pipeline | None = None) -> DataFrame:
        """keys and the panels' columns. rows hold the channels as numbers or as arrays over frequency.

        pipeline goes before data_pipeline (what the data would be sent through anyway); without both the rows are taken as they are.
        """
        settled = pipeline if pipeline is not None else data_pipeline
        reject_db(settled, self.name)
        ready = settled.apply(rows) if settled is not None else rows
        missing = [c for c in self.needs if c not in ready.columns]
        if missing:
            raise ValueError(f"{self.name} needs channels {missing}")
        if dict(ready.dtypes)[self.needs[0]].startswith("array"):
            together = F.transform(F.arrays_zip(*self.needs), lambda r: F.struct(*[x.alias(label) for x, label in zip(self.make(*(r[c] for c in self.needs)), self.labels, strict=True)]))
            return ready.withColumn("_panels", together).select(*keys, *[F.col(f"_panels.{label}").alias(label) for label in self.labels])
        return ready.select(*keys, *[x.alias(label) for x, label in zip(self.make(*map(F.col, self.needs)), self.labels, strict=True)])


INSTRUMENTAL = Recipe(
    "instrumental quick look", CHANNELS, (("pol00_db", "db", False), ("pol11_db", "db", False), ("pol01_mag_db", "db", False), ("pol01_phase", "rad", False)),
    lambda p00, p11, mag, phase: [maths.safe_db(p00), maths.safe_db(p11), maths.safe_db(mag), phase.cast("double")],
)
STOKES_FRACTIONAL = Recipe(
    "fractional Stokes quick look", ("stokes_i", "stokes_q", "stokes_u", "stokes_v"), (("stokes_i_db", "db", False), ("q_i", "ratio", True), ("u_i", "ratio", True), ("v_i", "ratio", True)),
    lambda i, q, u, v: [maths.safe_db(i), *(maths.fraction_of(x, i) for x in (q, u, v))],
)


def stokes_pipeline() -> Pipeline:
    """From the four channels of a measurement to the four Stokes parameters."""
    return Pipeline(CHANNELS).add(stokes_iquv_step())
