"""Regions of interest: runs of high scores, padded and merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.grid import UTC_SPARK
from ..functions.maths import finite_or_null
from ..sources.tables import written
from . import ranges
from .metrics import robust_threshold

#: Length of the ranges that runs are looked for in: a week.
RANGE_US = 7 * 24 * 3_600_000_000

#: Hand-picked events, as start and stop in UTC.
CURATED = [
    ("20240721_014500", "20240721_020500"), ("20240724_072500", "20240724_080500"), ("20240724_170500", "20240724_174500"),
    ("20240725_152500", "20240725_155500"), ("20240727_180500", "20240727_184500"), ("20240727_191500", "20240727_194500"),
    ("20240728_013500", "20240728_022500"), ("20240728_180500", "20240728_182500"), ("20240729_171500", "20240729_180500"),
    ("20240730_132500", "20240730_134500"), ("20240730_143000", "20240730_155500"), ("20240730_192500", "20240730_194500"),
    ("20240730_211500", "20240730_215500"), ("20240801_013500", "20240801_020500"), ("20240804_142500", "20240804_152500"),
    ("20240804_220000", "20240804_224000"), ("20240805_085000", "20240805_091000"), ("20240805_150500", "20240805_160000"),
    ("20240806_221000", "20240806_224000"), ("20240807_133000", "20240807_141000"), ("20240808_190500", "20240808_194500"),
    ("20240812_011000", "20240812_014000"), ("20240812_182500", "20240812_184500"), ("20240820_003500", "20240820_005500"),
    ("20240821_194000", "20240821_201000"), ("20240821_224000", "20240821_230500"), ("20240822_161000", "20240822_163000"),
    ("20240830_120000", "20240830_123000"), ("20240902_192500", "20240902_193500"), ("20240914_151500", "20240914_155500"),
]
#: Their places in the list of regions that they were picked from.
CURATED_INDICES = [2, 10, 12, 16, 23, 24, 25, 27, 28, 29, 30, 31, 36, 41, 44, 45, 47, 53, 54, 55, 61, 71, 72, 95, 101, 102, 104, 135, 150, 188]


def curated(spark: SparkSession, events: list[tuple[str, str]] | None = None) -> DataFrame:
    """event, roi_index (NULL for own events), start_us, stop_us of hand-picked intervals."""
    indices = CURATED_INDICES if events is None else [None] * len(events)
    rows = [(k, i, *e) for k, (i, e) in enumerate(zip(indices, CURATED if events is None else events, strict=True))]
    us = lambda c: F.unix_micros(F.to_timestamp(c, UTC_SPARK))
    return spark.createDataFrame(rows, "event long, roi_index long, start string, stop string").select("event", "roi_index", us("start").alias("start_us"), us("stop").alias("stop_us"))


def within(scores: DataFrame, intervals: DataFrame, keys: list[str], time: str = "time_us", pad_us: int = 0, by: list[str] | None = None) -> DataFrame:
    """scores with the keys of each interval (start_us, stop_us, keys, by) that holds their time, both ends included.

    Times and intervals meet in an equi-join on hours: an interval has a row for each hour that it touches.
    """
    by, hour = by or [], 3_600_000_000
    spans = intervals.select(*by, *keys, (F.col("start_us") - pad_us).alias("_lo"), (F.col("stop_us") + pad_us).alias("_hi"))
    spans = spans.withColumn("_hour", F.explode(F.sequence(F.floor(F.col("_lo") / hour), F.floor(F.col("_hi") / hour))))
    return scores.withColumn("_hour", F.floor(F.col(time) / hour)).join(spans, [*by, "_hour"]).where(F.col(time).between(F.col("_lo"), F.col("_hi"))).drop("_hour", "_lo", "_hi")


def metric_label(method: str = "unknown", topk: int | None = None, q: float | None = None, p: float | None = None, **_) -> str:
    """A short name of a metric and its option: l4, lp2.5, topk2048, p99, p99.5; else the method's name."""
    known = {"lp": ("l", "lp", p), "percentile": ("p", "p", q)}
    if method == "topk_sum":
        return "topk" if topk is None else f"topk{topk}"
    if method not in known:
        return str(method)
    whole, broken, x = known[method]
    if x is None:
        return method
    return f"{whole}{int(x)}" if float(x).is_integer() else f"{broken}{float(x):g}"


def file_tag(text: str) -> str:
    """text with every character but letters, digits, - and _ turned into -, without - at the ends; ``unknown`` if nothing is left."""
    return "".join(c if c.isalnum() or c in "-_" else "-" for c in text).strip("-") or "unknown"


def _runs(rows: DataFrame, by: list[str], time: str, value: str, width: int) -> DataFrame:
    """by, lo, hi, peak, total, n of each run of adjacent rows that are ``_on``, in time order.

    A range gives its own runs; one that touches the range's end goes on in the next range if that begins with a run. Which
    range a chain of such runs begins in is carried over the ranges, three flags each.
    """
    rows = ranges.dealt(rows, by, time, width)
    w = ranges.within(by, time)
    marked = rows.withColumn("_run", F.sum((~F.col("_on")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    marked = marked.withColumn("_first", F.row_number().over(w) == 1).withColumn("_last", F.lead(F.lit(1)).over(w).isNull())
    local = marked.where("_on").groupBy(*by, ranges.PART, "_run").agg(F.min(time).alias("lo"), F.max(time).alias("hi"), F.max(value).alias("peak"), F.sum(value).alias("total"), F.count("*").alias("n"), F.max("_first").alias("_first"), F.max("_last").alias("_last"))
    parts = rows.groupBy(*by, ranges.PART).agg(F.max_by("_on", time).alias("_right"), F.min("_on").alias("_whole"))
    along = ranges.along(by)
    parts = parts.withColumn("_open", F.coalesce(F.lag("_right").over(along), F.lit(False)))
    parts = parts.withColumn("_head", F.last(F.when(~(F.col("_whole") & F.col("_open")), F.col(ranges.PART)), True).over(along.rowsBetween(W.unboundedPreceding, W.currentRow)))
    parts = parts.select(*by, ranges.PART, "_open", F.lag("_head").over(along).alias("_from"))
    local = ranges.meet(local, parts, [*by, ranges.PART])
    goes_on = F.col("_first") & F.col("_open")
    chain = F.when(goes_on, F.struct(F.col("_from").alias("part"), F.lit(-1).cast("long").alias("run"))).when(F.col("_last"), F.struct(F.col(ranges.PART).alias("part"), F.lit(-1).cast("long").alias("run")))
    chain = chain.otherwise(F.struct(F.col(ranges.PART).alias("part"), F.col("_run").cast("long").alias("run")))
    return local.groupBy(*by, chain.alias("_chain")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("peak").alias("peak"), F.sum("total").alias("total"), F.sum("n").alias("n")).drop("_chain")


def find_rois(scores: DataFrame, by: list[str], nsig: float = 3.0, pad_us: int = 300_000_000, merge_gap_us: int = 1_200_000_000, time: str = "time_us", value: str = "score", range_us: int = RANGE_US) -> DataFrame:
    """by, start_us, stop_us, peak_score, sum_score, n_frames. Runs go by adjacent rows in time order within ``by`` (say a station);
    padded runs merge when the next starts at most merge_gap_us after the latest stop so far.

    Work is dealt by ranges of range_us (see operators.ranges), so a station is not one task; results don't depend on it.
    """
    missing = [c for c in (*by, time, value) if c not in scores.columns]
    if missing:
        raise ValueError(f"no column {missing}")
    x = finite_or_null(F.col(value))
    scores = written(scores.select(*by, time, value), "scores")  # several passes follow; the scores are made once
    limits = robust_threshold(scores, nsig, by, value).select(*by, "threshold")
    rows = scores.join(limits, by).withColumn("_on", F.coalesce(x > F.col("threshold"), F.lit(False))).select(*by, time, value, "_on")
    runs = written(_runs(rows, by, time, value, range_us), "runs")
    runs = ranges.dealt(runs.withColumn("start_us", F.col("lo") - pad_us).withColumn("stop_us", F.col("hi") + pad_us), by, "start_us", range_us)
    order = ["start_us", "stop_us"]
    runs = ranges.running(runs, by, order, F.col("stop_us"), "max", "_latest", inclusive=False)
    apart = F.when(F.col("start_us") - F.col("_latest") <= merge_gap_us, 0).otherwise(1)
    runs = ranges.running(runs, by, order, apart, "sum", "_roi")
    merged = runs.groupBy(*by, "_roi").agg(F.min("start_us").alias("start_us"), F.max("stop_us").alias("stop_us"), F.max("peak").alias("peak_score"), F.sum("total").alias("sum_score"), F.sum("n").alias("n_frames"))
    return merged.drop("_roi")
