"""The rolling PCA of operators.rolling for frames too wide for a task to hold a context of them: by blocks of pixels.

A residual is a linear combination of frames, y - sum_j a_j x_j, whose weights follow from scalar products of frames alone. So

1. frames are cut into blocks of pixels, less an offset per pixel (the mean of the whole frames), which keeps the products accurate;
2. products of frames at most a context apart are taken in tiles of time and pixels, each pair in one tile, and summed over the pixels;
   all windows that share a pair share its product;
3. each window takes the matrix of its quiet frames out of these sums, centres and decomposes it (N x N, N a context's quiet frames);
4. weights meet the pixel blocks again and give blocks of residuals. The projection of a frame with gaps misses those pixels, so
   it is summed over the blocks first;
5. the blocks of a frame's residual come together to be scored.

A task holds, in turn, the frames of two contexts in one block of pixels, the products of a block of windows, the quiet and scored frames
of a block of windows in one block of pixels, and one residual. Frames are shipped twice (2), and (4) once for each block of windows
that fits or scores them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from . import metrics, rolling
from .cube import lists, matrix

PIXELS = 4096


def _wide(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of equal length as a matrix of doubles."""
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def frame_facts(frames: DataFrame, by: list[str], config: rolling.RollingConfig) -> DataFrame:
    """by, frame_idx, _t, quiet (the score that tells quiet frames), whole (no gap), width of frames (by, frame_idx, _t, _x)."""
    types = dict(frames.dtypes)
    keys = [*by, "frame_idx", "_t"]

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 16):
                part = b.slice(k, 16)
                column = part.column(len(keys))
                x = matrix(column, max(np.diff(column.offsets.to_numpy()).max(initial=0), 1))
                quiet = metrics.array_scores(x, config.quiet_method, **config.quiet_options)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], pa.array(quiet), pa.array(np.isfinite(x).all(axis=1)), pa.array(np.full(part.num_rows, x.shape[1]))], [*keys, "quiet", "whole", "width"])

    return frames.select(*keys, "_x").mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keys) + ", quiet double, whole boolean, width long")


def pixel_blocks(frames: DataFrame, facts: DataFrame, by: list[str], pixels: int, center: bool) -> DataFrame:
    """by, pixel (number of the block), frame_idx, _t, v: blocks of the frames less the offsets of their pixels, NaN where missing."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    n = F.ceil(F.size("_x") / pixels).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice("_x", i * pixels + 1, pixels))
    cut = frames.select(*by, "frame_idx", "_t", F.posexplode(parts).alias("pixel", "v"))
    cut = written(cut.withColumn("v", F.transform("v", lambda x: F.coalesce(x, F.lit(float("nan")).cast("float")))), "pixel-blocks")
    if not center:
        return cut.withColumn("v", F.col("v").cast("array<double>"))
    whole = cut.join(facts.where("whole").select(*by, "frame_idx"), [*by, "frame_idx"], "left_semi")
    offsets = whole.groupBy(*by, "pixel").agg(vector_to_array(Summarizer.mean(array_to_vector(F.col("v").cast("array<double>")))).alias("offset"))
    # Of a group without a whole frame nothing is fitted.
    return cut.join(written(offsets, "offsets"), [*by, "pixel"]).withColumn("v", F.zip_with("v", "offset", lambda x, o: x.cast("double") - o)).drop("offset")


def products(blocks: DataFrame, by: list[str], reach_us: int) -> DataFrame:
    """by, frame_idx, partners (frames before it by less than reach_us, itself last), products with them, summed over all pixels."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    types = dict(blocks.dtypes)
    tile = F.floor(F.col("_t") / reach_us)
    tiles = blocks.withColumn("_own", tile).withColumn("_tile", F.explode(F.array(tile, tile + 1)))

    def work(g: pa.Table) -> pa.Table:
        g = g.sort_by([("_t", "ascending"), ("frame_idx", "ascending")])
        t, ids, own = (g.column(c).to_numpy() for c in ("_t", "frame_idx", "_own"))
        x = np.nan_to_num(_wide(g.column("v")), nan=0.0, posinf=0.0, neginf=0.0)
        mine = np.flatnonzero(own == g.column("_tile")[0].as_py())
        dots = x[mine] @ x.T
        lo = np.searchsorted(t, t[mine] - reach_us, side="right")
        keys = [pa.array([g.column(c)[0].as_py()] * len(mine), g.schema.field(c).type) for c in by]
        ends = np.concatenate([[0], np.cumsum(mine + 1 - lo)]).astype(np.int32)
        partners = np.concatenate([ids[a : i + 1] for a, i in zip(lo, mine, strict=True)]) if len(mine) else ids[:0]
        flat = np.concatenate([dots[k, a : i + 1] for k, (a, i) in enumerate(zip(lo, mine, strict=True))]) if len(mine) else dots.ravel()
        return pa.Table.from_arrays([*keys, pa.array(ids[mine]), pa.ListArray.from_arrays(pa.array(ends), pa.array(partners)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[*by, "frame_idx", "partners", "products"])

    schema = ", ".join(f"`{c}` {types[c]}" for c in by) + ", frame_idx long, partners array<long>, products array<double>"
    found = tiles.groupBy(*by, "pixel", "_tile").applyInArrow(work, schema)
    summed = found.groupBy(*by, "frame_idx").agg(F.first("partners").alias("partners"), Summarizer.sum(array_to_vector("products")).alias("products"))
    return summed.withColumn("products", vector_to_array("products"))


def _decompose(g: np.ndarray, k: int, width: int, center: bool) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients: row j gives component j as a combination of the frames, products of frames with the centred ones) of a matrix of products."""
    n = len(g)
    shift = g.mean(axis=0) if center else np.zeros(n)
    centred = g - shift - shift[:, None] + (shift.mean() if center else 0.0)
    values, vectors = np.linalg.eigh(centred)
    order = np.argsort(values)[::-1][: min(k, n, width)]
    values, vectors = values[order], vectors[:, order]
    real = values > max(1e-12 * max(values[:1], default=0.0), 0)
    return (vectors[:, real] / np.sqrt(values[real])).T, shift


def _windows(facts: DataFrame, dots: DataFrame, by: list[str], first: int, count: int, c: rolling.RollingConfig, last: DataFrame) -> DataFrame:
    """A row per window: status, counts, its quiet frames (fit), components (coef, flat), scored frames and the weights of their combinations
    (weights, flat; of frames with gaps, listed in ``gaps``, those of the mean alone)."""
    types = dict(facts.dtypes)
    placed = rolling.place(facts.join(dots, [*by, "frame_idx"], "left"), first, -(-count // c.block), c).join(last, by)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_t", "frame_idx"], kind="stable")
        t, ids, quiet, whole = (pdf[n].to_numpy() for n in ("_t", "frame_idx", "quiet", "whole"))
        at = {int(i): k for k, i in enumerate(ids)}
        g = np.full((len(t), len(t)), np.nan)
        for i, (partners, values) in enumerate(zip(pdf["partners"], pdf["products"], strict=True)):
            if partners is not None:
                here = [(at[int(p)], v) for p, v in zip(partners, values, strict=True) if int(p) in at]
                j = [p for p, _ in here]
                g[i, j] = g[j, i] = [v for _, v in here]
        b, latest = int(pdf["_block"].iloc[0]), int(pdf["_last"].iloc[0])
        out = []
        for w in range(b * c.block, min((b + 1) * c.block, count)):
            h = first + w * c.stride_us
            status, held, fit, scored = rolling.choose(t, ids, quiet, whole, h, latest, c)
            coef, weights, gaps = np.zeros((0, len(fit))), [], []
            if status == rolling.SCORED:
                coef, shift = _decompose(g[np.ix_(fit, fit)], c.k, int(pdf["width"].iloc[0]), c.center)
                for s in scored:
                    row = g[s, fit]
                    row = row - row.mean() - shift + shift.mean() if c.center else row
                    mean = 1 / len(fit) if c.center else 0.0
                    weights += ((coef @ row) @ coef + mean).tolist() if whole[s] else [mean] * len(fit)
                    gaps += [] if whole[s] else [int(ids[s])]
            out.append((b, h, status, len(held), len(fit), ids[fit].tolist(), coef.ravel().tolist(), ids[scored].tolist(), weights, gaps))
        done = pd.DataFrame(out, columns=["_block", "window_us", "status", "n_context", "n_quiet", "fit", "coef", "scored", "weights", "gaps"])
        for key in by:
            done[key] = pdf[key].iloc[0]
        return done[[*by, *done.columns[:10]]]

    schema = ", ".join(f"`{k}` {types[k]}" for k in by) + ", _block long, window_us long, status string, n_context long, n_quiet long, fit array<long>, coef array<double>, scored array<long>, weights array<double>, gaps array<long>"
    return placed.groupBy(*by, "_block").applyInPandas(work, schema)


def _meet(windows: DataFrame, blocks: DataFrame, by: list[str], lists_: tuple[str, ...]):
    """Pixel blocks of the frames that the windows of each block need (those in lists_), beside the windows themselves: two groups to apply a function to."""
    need = windows.select(*by, "_block", F.explode(F.array_distinct(F.concat(*lists_))).alias("frame_idx")).distinct()
    numbers = blocks.select(*by, "pixel").distinct()
    own = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  both sides come from the same tables
    here, there = own(blocks.join(need, [*by, "frame_idx"])), own(windows.join(numbers, by))
    return here.groupBy(*by, "_block", "pixel").cogroup(there.groupBy(*by, "_block", "pixel"))


def _projected(windows: DataFrame, blocks: DataFrame, by: list[str], center: bool) -> DataFrame:
    """by, window_us, frame_idx, p: projections of frames with gaps on their window's components, over the pixels that they have."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    types = dict(blocks.dtypes)
    some = windows.where((F.size("gaps") > 0) & (F.size("coef") > 0))

    def work(pixels: pa.Table, rows: pa.Table) -> pa.Table:
        x = _wide(pixels.column("v")) if pixels.num_rows else np.zeros((0, 0))
        at = {i: k for k, i in enumerate(pixels.column("frame_idx").to_pylist())}
        out = []
        for r in rows.to_pylist():
            z = x[[at[i] for i in r["fit"]]]
            mean = z.mean(axis=0) if center else np.zeros(x.shape[1])
            basis = np.reshape(r["coef"], (-1, len(r["fit"]))) @ (z - mean)
            for i in r["gaps"]:
                y = x[at[i]] - mean
                out.append((*(r[k] for k in by), r["window_us"], i, (basis @ np.where(np.isfinite(y), y, 0.0)).tolist()))
        kinds = [rows.schema.field(k).type for k in by] + [pa.int64(), pa.int64(), pa.list_(pa.float64())]
        return pa.Table.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names=[*by, "window_us", "frame_idx", "p"])

    schema = ", ".join(f"`{k}` {types[k]}" for k in by) + ", window_us long, frame_idx long, p array<double>"
    found = _meet(some, blocks, by, ("fit", "gaps")).applyInArrow(work, schema)
    return found.groupBy(*by, "window_us", "frame_idx").agg(vector_to_array(Summarizer.sum(array_to_vector("p"))).alias("p"))


def _filled(windows: DataFrame, projected: DataFrame, by: list[str], center: bool) -> DataFrame:
    """windows with the weights of frames with gaps."""
    parts = projected.groupBy(*by, "window_us").agg(F.collect_list(F.struct("frame_idx", "p")).alias("_parts"))

    def run(batches):
        for pdf in batches:
            for i, parts_ in enumerate(pdf["_parts"]):
                if parts_ is None:
                    continue
                row = pdf.iloc[i]
                fit, scored = len(row["fit"]), [int(s) for s in row["scored"]]
                coef, weights = np.reshape(row["coef"], (-1, fit)), np.array(row["weights"], float).reshape(len(scored), fit)
                for part in parts_:
                    weights[scored.index(int(part["frame_idx"]))] = np.asarray(part["p"]) @ coef + (1 / fit if center else 0.0)
                pdf.at[pdf.index[i], "weights"] = weights.ravel().tolist()
            yield pdf[columns]

    columns = windows.columns
    return windows.join(parts, [*by, "window_us"], "left").mapInPandas(run, windows.schema)


def _residuals(windows: DataFrame, blocks: DataFrame, by: list[str], out: str = "residual") -> DataFrame:
    """by, window_us, frame_idx, ``out``: the residual of each scored frame as one array."""
    types = dict(blocks.dtypes)

    def work(pixels: pa.Table, rows: pa.Table) -> pa.Table:
        x = _wide(pixels.column("v")) if pixels.num_rows else np.zeros((0, 0))
        at = {i: k for k, i in enumerate(pixels.column("frame_idx").to_pylist())}
        keys, found = [], []
        for r in rows.to_pylist():
            z, y = x[[at[i] for i in r["fit"]]], x[[at[i] for i in r["scored"]]]
            found.append(y - np.reshape(r["weights"], (len(y), len(z))) @ z)
            keys += [(*(r[k] for k in by), r["window_us"], i, r["pixel"]) for i in r["scored"]]
        kinds = [rows.schema.field(k).type for k in by] + [pa.int64(), pa.int64(), pa.int32()]
        columns = [pa.array([o[i] for o in keys], kind) for i, kind in enumerate(kinds)]
        return pa.Table.from_arrays([*columns, lists(np.concatenate(found), pa.float64()) if found else pa.array([], pa.list_(pa.float64()))], names=[*by, "window_us", "frame_idx", "pixel", "r"])

    schema = ", ".join(f"`{k}` {types[k]}" for k in by) + ", window_us long, frame_idx long, pixel int, r array<double>"
    found = _meet(windows.where(F.col("status") == rolling.SCORED), blocks, by, ("fit", "scored")).applyInArrow(work, schema)
    whole = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pixel", "r"))), lambda p: p["r"]))
    return found.groupBy(*by, "window_us", "frame_idx").agg(whole.alias(out))


def run(frames: DataFrame, start_us: int, stop_us: int, config: rolling.RollingConfig, by: list[str], ts: str = "start_us", features: str = "features", pixels: int = PIXELS) -> DataFrame:
    """What operators.rolling.run() gives, in the same columns, for frames of any width."""
    if pixels < 1:
        raise ValueError("a block holds at least one pixel")
    from .background import array_outlier_scores

    c, first, count = config, -(-start_us // rolling.HOUR) * rolling.HOUR, rolling.n_steps(start_us, stop_us, config.stride_us)
    values = c.mask.array(features) if c.mask is not None else F.col(features)
    ready = frames.select(*by, F.col("frame_idx").cast("long").alias("frame_idx"), F.col(ts).cast("long").alias("_t"), values.cast("array<float>").alias("_x"))
    facts = written(frame_facts(ready, by, c), "frame-facts")
    last = facts.groupBy(*by).agg(F.max("_t").alias("_last"))
    blocks = pixel_blocks(ready, facts, by, pixels, c.center)
    dots = products(blocks, by, max(c.context_us, c.context_us // 2 + c.score_us))
    windows = written(_windows(facts, dots, by, first, count, c, last), "pixel-windows")
    windows = written(_filled(windows, _projected(windows, blocks, by, c.center), by, c.center), "pixel-weights")
    scores = array_outlier_scores(_residuals(windows, blocks, by), [*by, "window_us", "frame_idx"], positive_only=c.positive_only, method=c.method, **({"min_finite_frac": 1.0, "normalize_missing": False} | c.score_options))
    per_window = scores.groupBy(*by, "window_us").agg(F.map_from_entries(F.collect_list(F.struct("frame_idx", F.coalesce("score", F.lit(float("nan"))).alias("s")))).alias("_s"))
    joined = windows.join(per_window, [*by, "window_us"], "left").select(*by, "window_us", "status", "n_context", "n_quiet", F.col("scored").alias("frame_idx"), F.transform("scored", lambda i: F.try_element_at("_s", i)).alias("score"))

    def rank(batches):
        for pdf in batches:
            pdf["score"] = [np.asarray(s, float) for s in pdf["score"]]
            pdf["rank_idx"] = [rolling.ranked(np.asarray(i, np.int64), s).tolist() for i, s in zip(pdf["frame_idx"], pdf["score"], strict=True)]
            yield pdf

    types = dict(windows.dtypes)
    found = joined.mapInPandas(rank, ", ".join(f"`{k}` {types[k]}" for k in by) + ", window_us long, status string, n_context long, n_quiet long, frame_idx array<long>, score array<double>, rank_idx array<long>")
    return rolling._planned(found, last, first, count, c, by)
