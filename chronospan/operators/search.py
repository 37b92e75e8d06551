"""The end-to-end search: frames against their rolling background, thresholds, regions of interest, results on disk."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import FramePlan
from ..functions.selection import FreqMask
from ..sources.tables import written
from . import cube, rois, rolling


@dataclass(frozen=True)
class Search:
    """windows (one row per planned window), scores (by, time_us, frame_idx, score), regions, and the settings as a dict."""

    windows: DataFrame
    scores: DataFrame
    regions: DataFrame
    config: dict


def _found(windows: DataFrame, times: DataFrame | None, plan: FramePlan | None, start_us: int, stop_us: int, config: rolling.RollingConfig, by: list[str], nsig: float, pad_us: int, merge_gap_us: int) -> Search:
    scores = rolling.frame_scores(windows, by)
    timed = scores.join(times, [*by, "frame_idx"]) if plan is None else scores.withColumn("time_us", cube.start_us(plan, F.col("frame_idx")))
    scores = timed.select(*by, "time_us", "frame_idx", "score")
    regions = rois.find_rois(scores, by, nsig, pad_us, merge_gap_us)
    settings = {"rolling": asdict(config), "nsig": nsig, "pad_us": pad_us, "merge_gap_us": merge_gap_us, "start_us": start_us, "stop_us": stop_us}
    settings["label"] = rois.metric_label(config.method, **{k: v for k, v in config.score_options.items() if k in ("topk", "q", "p")})
    return Search(windows, scores, regions, settings)


def search(frames: DataFrame, start_us: int, stop_us: int, config: rolling.RollingConfig, by: list[str], nsig: float = 3.0, pad_us: int = 300_000_000, merge_gap_us: int = 1_200_000_000, ts: str = "start_us", features: str = "features", keep=None) -> Search:
    """Rolling PCA scores of frames (by, frame_idx, ts, features), then regions of interest of each group ``by``.

    The windows are written once to the shared folder, as scores and regions both come from them; ``keep`` (a function from table
    to table) does something else instead.
    """
    windows = rolling.run(frames, start_us, stop_us, config, by, ts, features)
    windows = keep(windows) if keep is not None else written(windows, "windows")
    times = frames.select(*by, F.col("frame_idx").cast("long").alias("frame_idx"), F.col(ts).cast("long").alias("time_us"))
    return _found(windows, times, None, start_us, stop_us, config, by, nsig, pad_us, merge_gap_us)


def search_cube(rows: DataFrame, plan: FramePlan, width: int, start_us: int, stop_us: int, config: rolling.RollingConfig, by: list[str], nsig: float = 3.0, pad_us: int = 300_000_000, merge_gap_us: int = 1_200_000_000, t: str = "t_idx", values: str = "values", mask: FreqMask | None = None, per_block: int = cube.PER_BLOCK, keep=None) -> Search:
    """The search from the rows of a cube (by, t, values): frames of the plan, their rolling scores, regions of interest.

    Vectors are assembled once, on their way into the windows; times of frames and the end of each group follow from the plan.
    """
    frames = cube.frame_vectors(rows, plan, by, width, t, values, mask, per_block)
    windows = rolling.run(frames, start_us, stop_us, config, by, last=cube.last_start(rows, plan, by, t))
    windows = keep(windows) if keep is not None else written(windows, "windows")
    return _found(windows, None, plan, start_us, stop_us, config, by, nsig, pad_us, merge_gap_us)


def write_results(found: Search, path: str) -> None:
    """scores and rois as Parquet and config as JSON text below path; what is there is replaced."""
    spark = found.scores.sparkSession
    found.scores.write.mode("overwrite").parquet(f"{path}/scores")
    found.regions.write.mode("overwrite").parquet(f"{path}/rois")
    spark.createDataFrame([(json.dumps(found.config, sort_keys=True, default=str),)], "value string").write.mode("overwrite").text(f"{path}/config")
