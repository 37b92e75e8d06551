"""The rolling PCA runner over a stream, with a state entry for each frame.

Frames may come late (up to the watermark's delay) and in any order. A trigger writes the frames that it brings and removes those that
no later window needs; the others stay in the state store untouched, so what is written per trigger is in proportion to new frames, not
to the context. A window fires once its group has a frame at half a context or more behind its start and the watermark has passed that
time, by a timer in event time or with the group's next frames. Later frames than the watermark are dropped by Spark.

The session needs a state store with column families, such as RocksDB's (``use_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators import metrics, rolling

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_NEVER = -(1 << 62)


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class _Windows(StatefulProcessor):
    """State of a group: frames by (time, number), the number of the next window and the time of the latest frame."""

    def __init__(self, config: rolling.RollingConfig, first: int, count: int, columns: list[str]):
        self.c, self.first, self.count, self.columns = config, first, count, columns
        self.half = config.context_us // 2

    def init(self, handle) -> None:
        self.handle = handle
        self.frames = handle.getMapState("frames", "t long, id long", "x binary")
        self.place = handle.getValueState("place", "next long, latest long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        following, latest = self.place.get() if self.place.exists() else (0, _NEVER)
        needed = self.first + following * self.c.stride_us - self.half
        for pdf in rows:
            for t, i, x in zip(pdf["t"].tolist(), pdf["frame_idx"].tolist(), pdf["x"], strict=True):
                latest = max(latest, t)
                if t >= needed:
                    self.frames.updateValue((t, i), (np.asarray(x, np.float32).tobytes(),))
        yield self._fire(key, following, latest, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        following, latest = self.place.get()
        yield self._fire(key, following, latest, timerValues.getCurrentWatermarkInMs() * 1000)

    def _fire(self, key: tuple, following: int, latest: int, watermark: int) -> pd.DataFrame:
        c, begun, out, held = self.c, following, [], None
        while following < self.count:
            h = self.first + following * c.stride_us
            due = h + self.half
            if latest < due:  # the group's next frames will look again
                break
            if watermark < due:
                self.handle.registerTimer(-(-due // 1000))
                break
            if held is None:
                held = self._held()
            status, context, fit, scored = rolling.choose(held["t"], held["ids"], held["quiet"], held["whole"], h, latest, c)
            scores = self._scores(held["x"], fit, scored) if status == rolling.SCORED else np.empty(0)
            ids = held["ids"][scored] if status == rolling.SCORED else np.empty(0, np.int64)
            out.append((*key, h, status, len(context), len(fit), ids.tolist(), scores.tolist(), rolling.ranked(ids, scores).tolist()))
            following += 1
        if following > begun:
            needed = self.first + following * c.stride_us - self.half
            for t, i in zip(held["t"].tolist(), held["ids"].tolist(), strict=True):
                if t < needed:
                    self.frames.removeKey((t, i))
        self.place.update((following, latest))
        return pd.DataFrame(out, columns=self.columns)

    def _held(self) -> dict[str, np.ndarray]:
        rows = sorted(((k[0], k[1]), v[0]) for k, v in self.frames.iterator())
        x = np.stack([np.frombuffer(v, np.float32) for _, v in rows])
        t, ids = (np.array([k[i] for k, _ in rows], np.int64) for i in (0, 1))
        return {"t": t, "ids": ids, "x": x, "whole": np.isfinite(x).all(axis=1), "quiet": metrics.array_scores(x, self.c.quiet_method, **self.c.quiet_options)}

    def _scores(self, x: np.ndarray, fit: np.ndarray, scored: np.ndarray) -> np.ndarray:
        c = self.c
        mean, basis, _ = rolling.background.pca_basis(x[fit], c.k, c.center)
        res = rolling.background.residuals(x[scored].astype(np.float64), mean, basis)
        return metrics.array_scores(np.maximum(res, 0.0) if c.positive_only else res, c.method, **c.score_options)

    def close(self) -> None:
        pass


def run(frames: DataFrame, start_us: int, stop_us: int, config: rolling.RollingConfig, by: list[str], ts: str = "start_us", features: str = "features", delay: str = "0 seconds") -> DataFrame:
    """by, window_us, status, n_context, n_quiet, frame_idx, score, rank_idx: a row for each window when it fires (append mode).

    frames is a stream of (by, frame_idx, ts, features). Windows that never fire have no row. The rows are those of
    operators.rolling.run() over the frames that were not later than ``delay``.
    """
    types = dict(frames.dtypes)
    values = config.mask.array(features) if config.mask is not None else F.col(features)
    ready = frames.select(*by, F.col("frame_idx").cast("long").alias("frame_idx"), F.col(ts).cast("long").alias("t"), values.cast("array<float>").alias("x"))
    ready = ready.withColumn("event", F.timestamp_micros("t")).withWatermark("event", delay)
    columns = [*by, "window_us", "status", "n_context", "n_quiet", "frame_idx", "score", "rank_idx"]
    schema = "".join(f"`{k}` {types[k]}, " for k in by) + "window_us long, status string, n_context long, n_quiet long, frame_idx array<long>, score array<double>, rank_idx array<long>"
    first = -(-start_us // rolling.HOUR) * rolling.HOUR
    processor = _Windows(config, first, rolling.n_steps(start_us, stop_us, config.stride_us), columns)
    return ready.groupBy(*by).transformWithStateInPandas(processor, schema, "Append", "EventTime")
