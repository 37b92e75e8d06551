"""Comparison of time series: loading, light curves, interpolation, normalisation, lagged correlation."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.maths import finite_or_null, nan_to_null
from . import ranges

#: Columns that a flux table must have.
FLUX_COLUMNS = ("time", "xrsa_flux", "xrsb_flux")


def days_of(start: datetime, stop: datetime) -> list[str]:
    """The days (yyyymmdd) from that of start to that of stop, the latter included even where stop is its midnight."""
    if not start < stop:
        raise ValueError("start must lie before stop")
    first = start.replace(hour=0, minute=0, second=0, microsecond=0)
    return [(first + timedelta(days=k)).strftime("%Y%m%d") for k in range((stop - first).days + 1)]


def daily_files(files: DataFrame, start: datetime, stop: datetime, path: str = "path") -> DataFrame:
    """files (paths ``.../YYYY/name_dYYYYMMDD_vVERSION.ext``) of the days of the range; a day may have several versions."""
    day = F.regexp_extract(path, r"/(\d{4})/[^/]*_d(\1\d{4})_v[^/]*$", 2)
    return files.where(day.isin(days_of(start, stop))).orderBy(path)


def load_series(tables: list[DataFrame], start: Column, stop: Column, columns: tuple[str, ...] = FLUX_COLUMNS) -> DataFrame:
    """``columns`` (the first is the time) of all tables together, of [start, stop), in time order. No table, or one that lacks a column, raises."""
    if not tables:
        raise FileNotFoundError("no table for the range")
    for t in tables:
        missing = [c for c in columns if c not in t.columns]
        if missing:
            raise KeyError(f"a table lacks {missing}")
    out = tables[0].select(*columns)
    for t in tables[1:]:
        out = out.unionByName(t.select(*columns))
    time = F.col(columns[0])
    return out.where((time >= start) & (time < stop)).orderBy(*columns)


def clip_to(series: DataFrame, other: DataFrame, time: str, by: list[str] | None = None) -> DataFrame:
    """The rows of series between the first and the last time of other (both included), per group ``by``."""
    by = by or []
    ends = other.groupBy(*by).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    joined = series.join(ends, by) if by else series.crossJoin(F.broadcast(ends))
    return joined.where(F.col(time).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def light_curve(cells: DataFrame, by: list[str], value: str, how: str = "mean", out: str = "flux") -> DataFrame:
    """by, out: mean, median or sum over the values of each group (say over frequencies) that are no NaN. Of none, mean and median are missing and the sum is 0."""
    x = nan_to_null(F.col(value).cast("double"))
    found = {"mean": F.avg(x), "median": F.median(x), "sum": F.coalesce(F.sum(x), F.lit(0.0))}
    if how not in found:
        raise ValueError(f"unknown light curve {how!r}")
    return cells.groupBy(*by).agg(found[how].alias(out))


def minmax(df: DataFrame, value: str, by: list[str], out: str, guard: bool = True) -> DataFrame:
    """value scaled to [0, 1] within each group; NULL and NaN stay missing (NULL) and don't count.

    With the guard, 0.5 where all values are about equal; without it (curves of several stations), missing where they are equal.
    """
    x = nan_to_null(F.col(value).cast("double"))
    met = ranges.meet(df, df.groupBy(*by).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi")), by)
    lo, hi = F.col("_lo"), F.col("_hi")
    scaled = F.try_divide(x - lo, F.when(hi != lo, hi - lo))
    flat = F.abs(hi - lo) <= 1e-8 + 1e-5 * F.abs(lo)
    return met.withColumn(out, F.when(x.isNotNull(), F.when(flat, 0.5).otherwise(scaled)) if guard else scaled).drop("_lo", "_hi")


def interpolate(knots: DataFrame, points: DataFrame, by: list[str], x: str = "x", y: str = "y", width: float | None = None) -> DataFrame:
    """points (by, x) with y by linear interpolation between the knots (by, x, y), the end values beyond them.

    Rows are dealt by ranges of x, ``width`` wide. Within a range a point finds the knots around it; where there is none on one side,
    the last knot of the ranges before and the first of those behind are carried over, empty ranges included.
    """
    both = knots.select(*by, x, y, F.lit(0).alias("_point")).unionByName(points.select(*by, x, F.lit(None).cast("double").alias(y), F.lit(1).alias("_point")))
    both = ranges.dealt(both, by, x, width or ranges.width_of(knots, x)).withColumn("_knot", F.when(F.col("_point") == 0, F.struct(F.col(x).alias("x"), F.col(y).alias("y"))))
    order, along = ranges.within(by, [x, "_point"]), ranges.along(by)
    parts = both.groupBy(*by, ranges.PART).agg(F.max("_knot").alias("_last"), F.min("_knot").alias("_first"))
    parts = parts.select(*by, ranges.PART, F.last("_last", True).over(along.rowsBetween(W.unboundedPreceding, -1)).alias("_before"), F.first("_first", True).over(along.rowsBetween(1, W.unboundedFollowing)).alias("_behind"))
    near = both.withColumn("_a", F.last("_knot", True).over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("_b", F.first("_knot", True).over(order.rowsBetween(0, W.unboundedFollowing)))
    near = ranges.meet(near.where("_point = 1"), parts, [*by, ranges.PART])
    near = near.withColumn("_a", F.coalesce("_a", "_before")).withColumn("_b", F.coalesce("_b", "_behind"))
    a, b = F.col("_a"), F.col("_b")
    between = a["y"] + (b["y"] - a["y"]) * (F.col(x) - a["x"]) / (b["x"] - a["x"])
    value = F.when(a.isNull(), b["y"]).when(b.isNull() | (a["x"] == F.col(x)), a["y"]).otherwise(between)
    return near.select(*by, x, value.alias(y))


def cross_correlation(pairs: DataFrame, by: list[str], order: str, a: str, b: str, max_lag: int, block: int = 4096, width: float | None = None) -> DataFrame:
    """by, lag, corr of z-scored series for lags up to max_lag either way; positive: a follows b. Pairs of which one value is not finite drop out first, and the rest is numbered anew.

    The numbered samples are cut into blocks; those of b within max_lag of a block go to it as well. A block gives one partial sum for each lag.
    """
    block, types = max(block, max_lag, 1), dict(pairs.dtypes)
    ready = pairs.select(*by, order, finite_or_null(F.col(a)).alias("a"), finite_or_null(F.col(b)).alias("b")).where("a is not null and b is not null")
    facts = ready.groupBy(*by).agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in "ab" for k, f in (("m", F.avg), ("s", F.stddev_pop))]).where("n >= 3")
    rows = ranges.meet(ranges.numbered(ready, by, order, "i", width), facts, by)
    # The second series stands in the blocks of all samples that it can meet.
    reach = F.sequence(F.greatest(F.lit(0), F.floor((F.col("i") - max_lag) / block)), F.floor((F.col("i") + max_lag) / block))
    z = lambda c: ((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).alias("v")
    sides = rows.select(*by, "i", F.lit(0).alias("side"), z("a"), F.floor(F.col("i") / block).alias("_block"))
    sides = sides.unionByName(rows.select(*by, "i", F.lit(1).alias("side"), z("b"), F.explode(reach).alias("_block")))

    def work(g: pa.Table) -> pa.Table:
        first = g.column("_block")[0].as_py() * block
        at, side, v = g.column("i").to_numpy() - first, g.column("side").to_numpy(), g.column("v").to_numpy(zero_copy_only=False).astype(float)
        x, y = np.zeros((2, block)), np.zeros((2, block + 2 * max_lag))  # values, and where there are any
        for part, k, into in ((side == 0, 0, x), (side == 1, max_lag, y)):
            into[0, at[part] + k], into[1, at[part] + k] = v[part], 1
        # Entry k of the correlation is the lag max_lag - k.
        sums, met = np.correlate(y[0], x[0], "valid")[::-1], np.rint(np.correlate(y[1], x[1], "valid")[::-1])
        keys = [pa.array([g.column(c)[0].as_py()] * len(sums), g.schema.field(c).type) for c in by]
        return pa.Table.from_arrays([*keys, pa.array(np.arange(-max_lag, max_lag + 1)), pa.array(sums), pa.array(met.astype(np.int64))], names=[*by, "lag", "part", "met"])

    schema = ", ".join([*(f"`{k}` {types[k]}" for k in by), "lag long, part double, met long"])
    found = sides.groupBy(*by, "_block").applyInArrow(work, schema).groupBy(*by, "lag").agg(F.sum("part").alias("part"), F.sum("met").alias("met")).where("met > 0")
    return ranges.meet(found, facts.select(*by, "n"), by).select(*by, F.col("lag").cast("int").alias("lag"), (F.col("part") / F.col("n")).alias("corr"))


def best_lag(correlations: DataFrame, by: list[str]) -> DataFrame:
    """by, lag, corr, relation: the highest correlation, of equal ones the smallest lag."""
    best = correlations.groupBy(*by).agg(F.max(F.struct("corr", (-F.col("lag")).alias("m"))).alias("b"))
    lag = -F.col("b.m")
    return best.select(*by, lag.alias("lag"), F.col("b.corr").alias("corr"), F.when(lag < 0, "leads").when(lag > 0, "lags").otherwise("together").alias("relation"))


def median_cadence(times: DataFrame, by: list[str], time: str) -> DataFrame:
    """by, cadence: the median step between the distinct times of each group."""
    steps = times.select(*by, time).distinct().withColumn("_step", F.col(time) - F.lag(time).over(W.partitionBy(*by).orderBy(time)))
    return steps.groupBy(*by).agg(F.median("_step").alias("cadence"))


def cell_edges(times: DataFrame, by: list[str], time: str) -> DataFrame:
    """by, time, lo, hi: borders halfway to the neighbours, at either end half the median cadence away."""
    w = W.partitionBy(*by).orderBy(time)
    rows = times.select(*by, time).distinct().withColumn("_p", F.lag(time).over(w)).withColumn("_n", F.lead(time).over(w))
    rows = rows.join(median_cadence(times, by, time), by)
    half = F.col("cadence") / 2
    return rows.select(*by, time, F.coalesce((F.col(time) + F.col("_p")) / 2, F.col(time) - half).alias("lo"), F.coalesce((F.col(time) + F.col("_n")) / 2, F.col(time) + half).alias("hi"))


def color_limits(values: DataFrame, value: str, by: list[str] | None = None, low: float = 1.0, high: float = 99.0) -> DataFrame:
    """by, lo, hi (percentiles of the finite values, (0, 1) where they are no range) and symmetric (the larger of both by amount, 1 where that is 0 or there is none)."""
    by = by or []
    q = values.groupBy(*by).agg(F.percentile(finite_or_null(F.col(value)), F.array(F.lit(low / 100), F.lit(high / 100))).alias("q"))
    lo, hi = F.col("q")[0], F.col("q")[1]
    most = F.greatest(F.abs(lo), F.abs(hi))
    real = lo < hi
    return q.select(*by, F.when(real, lo).otherwise(0.0).alias("lo"), F.when(real, hi).otherwise(1.0).alias("hi"), F.when(most > 0, most).otherwise(1.0).alias("symmetric"))
