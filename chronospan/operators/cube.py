"""From the rows of a cube (time index, array of values over frequency) to frame vectors, their scores and the search over them.

Rows are dealt to blocks of consecutive frames; a row goes to each block whose frames hold it, so besides its own block only the rows
of the last window of a block (its halo) are sent twice. A block becomes one dense array, frames are views of it, and one array per frame
comes out: no row per cell is made anywhere.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import maths
from ..functions.grid import FramePlan
from ..functions.selection import FreqMask
from . import metrics

PER_BLOCK = 16


def stokes_i_db(p00: Column, p11: Column, floor: float = 1e-12) -> Column:
    """Arrays of two polarisations as one array of total power in decibels, missing where one of both is."""
    return F.zip_with(p00, p11, lambda a, b: maths.safe_db(maths.stokes_i(a.cast("double"), b.cast("double")), floor))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of up to ``width`` numbers as the rows of a float32 matrix; NULL lists, NULL entries and what lacks at the end are NaN."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.diff(column.offsets.to_numpy())
    if (n > width).any():
        raise ValueError(f"a row of {n.max()} values in a cube of {width}")
    n = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, n)
    flat = column.flatten().cast(pa.float32()).to_numpy(zero_copy_only=False)
    if len(n) and (n == width).all():
        return flat.reshape(len(n), width)
    out = np.full((len(n), width), np.nan, np.float32)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def lists(x: np.ndarray, kind: pa.DataType = pa.float32()) -> pa.ListArray:
    """The rows of a matrix as lists."""
    ends = np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(x).ravel(), kind))


def pack(cells: DataFrame, by: list[str], f: str, value: str, nf: int, out: str = "values") -> DataFrame:
    """by and ``out``: the cells (by, f, value) of a row as an array of nf values, NaN where there is none. Of repeated cells one stays."""
    types = dict(cells.dtypes)
    grouped = cells.where((F.col(f) >= 0) & (F.col(f) < nf)).groupBy(*by).agg(F.collect_list(F.struct(F.col(f).cast("int").alias("f"), F.coalesce(F.col(value).cast("float"), F.lit(float("nan"))).alias("v"))).alias("c"))
    grouped = grouped.select(*by, F.col("c.f").alias("_f"), F.col("c.v").alias("_v"))

    def run(batches):
        for b in batches:
            fs, vs = b.column(len(by)), b.column(len(by) + 1)
            x = np.full((b.num_rows, nf), np.nan, np.float32)
            x[np.repeat(np.arange(b.num_rows), np.diff(fs.offsets.to_numpy())), fs.flatten().to_numpy()] = vs.flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(by)], lists(x)], [*by, out])

    return grouped.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in by) + f", `{out}` array<float>")


def _framed(rows: DataFrame, plan: FramePlan, by: list[str], width: int, t: str, values: Column, per_block: int, make: Callable, schema: str) -> DataFrame:
    """The result of make(frames, numbers of the frames) for each block of frames that holds a sample; by and the numbers lead it."""
    if per_block < 1:
        raise ValueError("a block holds at least one frame")
    types = dict(rows.dtypes)
    x = F.col(t) - plan.i_start
    lo = F.greatest(F.lit(0), F.ceil((x - plan.window_n + 1) / plan.step_n))
    hi = F.least(F.lit(plan.n_frames - 1), F.floor(x / plan.step_n))
    held = rows.where((F.col(t) >= plan.i_start) & (F.col(t) < plan.i_stop)).select(*by, F.col(t).cast("long").alias("_t"), values.cast("array<float>").alias("_x"), lo.alias("_lo"), hi.alias("_hi")).where("_lo <= _hi")
    blocks = F.sequence(F.floor(F.col("_lo") / per_block), F.floor(F.col("_hi") / per_block))
    dealt = held.select(*by, "_t", "_x", F.explode(blocks).alias("_block"))
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def work(group: pa.Table) -> pa.Table:
        first = group.column("_block")[0].as_py() * per_block
        m = min(per_block, plan.n_frames - first)
        at = group.column("_t").to_numpy() - (plan.i_start + first * plan.step_n)
        span = (m - 1) * plan.step_n + plan.window_n
        dense, here = np.full((span, width), np.nan, np.float32), np.zeros(span + 1, np.int64)
        inside = (at >= 0) & (at < span)
        dense[at[inside]] = matrix(group.column("_x"), width)[inside]
        here[at[inside] + 1] = 1
        here = np.cumsum(here)
        starts = np.arange(m) * plan.step_n
        real = np.flatnonzero(here[starts + plan.window_n] > here[starts])
        view = np.lib.stride_tricks.sliding_window_view(dense, plan.window_n, axis=0)[starts[real]]  # frames, frequencies, times
        frames = view.transpose(0, 2, 1).reshape(len(real), plan.window_n * width)
        keys = [pa.array([group.column(c)[0].as_py()] * len(real), group.schema.field(c).type) for c in by]
        return pa.Table.from_arrays([*keys, pa.array(first + real), *make(frames)], names=[*by, "frame_idx", *names])

    return dealt.groupBy(*by, "_block").applyInArrow(work, ", ".join([*(f"`{c}` {types[c]}" for c in by), "frame_idx long", schema]))


def start_us(plan: FramePlan, frame: Column) -> Column:
    """When a frame of the plan begins."""
    return F.floor((F.lit(plan.t0) + (frame * plan.step_n + plan.i_start) * plan.dt) * 1e6 + 0.5)


def frame_vectors(rows: DataFrame, plan: FramePlan, by: list[str], width: int, t: str = "t_idx", values: str = "values", mask: FreqMask | None = None, per_block: int = PER_BLOCK) -> DataFrame:
    """by, frame_idx, start_us, features of each frame of the plan that holds a row of ``rows`` (by, t, values).

    features: its window_n rows in time order, each with the ``width`` values of a row (those that mask keeps), NaN where missing. Rows are
    unique in (by, t). A task holds the rows of one block of frames.
    """
    kept = mask.array(values) if mask is not None else F.col(values)
    found = _framed(rows, plan, by, mask.size if mask is not None else width, t, kept, per_block, lambda x: [lists(x)], "features array<float>")
    return found.select(*by, "frame_idx", start_us(plan, F.col("frame_idx")).alias("start_us"), "features")


def frame_scores(rows: DataFrame, plan: FramePlan, by: list[str], width: int, method: str, t: str = "t_idx", values: str = "values", mask: FreqMask | None = None, per_block: int = PER_BLOCK, **options) -> DataFrame:
    """by, frame_idx, n_finite, score of the same frames (see metrics.score()); the vectors don't leave the task that makes them."""
    metrics.check(method, **options)
    kept = mask.array(values) if mask is not None else F.col(values)

    def make(x: np.ndarray) -> list[pa.Array]:
        return [pa.array(np.isfinite(x).sum(axis=1)), pa.array(metrics.array_scores(x, method, **options), from_pandas=True)]

    return _framed(rows, plan, by, mask.size if mask is not None else width, t, kept, per_block, make, "n_finite long, score double")


def last_start(rows: DataFrame, plan: FramePlan, by: list[str], t: str = "t_idx") -> DataFrame:
    """by, _last: when the last frame begins that frame_vectors() gives of each group; found from the time indices alone."""
    inside = rows.where((F.col(t) >= plan.i_start) & (F.col(t) < plan.i_stop))
    last = F.least(F.lit(plan.n_frames - 1), F.floor((F.max(t) - plan.i_start) / plan.step_n))
    # With steps longer than the window the last row may lie between two frames.
    if plan.step_n > plan.window_n:
        inside = inside.where((F.col(t) - plan.i_start) % plan.step_n < plan.window_n)
    return inside.groupBy(*by).agg(start_us(plan, last).alias("_last"))
