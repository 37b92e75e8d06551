"""Runs, interpolation, correlation and horizons worked on in ranges, blocks and tiles, against plain versions over whole groups."""

import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from chronospan.operators import ranges, rois, series, terrain

MINUTE = 60_000_000


def plain_rois(times, scores, threshold, pad, gap):
    runs, open_ = [], None
    for t, s in sorted(zip(times, scores)):
        if s is not None and s > threshold:
            if open_ is None:
                open_ = [t, t, s, 0.0, 0]
                runs.append(open_)
            open_[1], open_[2], open_[3], open_[4] = t, max(open_[2], s), open_[3] + s, open_[4] + 1
        else:
            open_ = None
    out = []
    for lo, hi, peak, total, n in runs:
        lo, hi = lo - pad, hi + pad
        if out and lo - out[-1][1] <= gap:
            out[-1] = [out[-1][0], max(out[-1][1], hi), max(out[-1][2], peak), out[-1][3] + total, out[-1][4] + n]
        else:
            out.append([lo, hi, peak, total, n])
    return out


@pytest.mark.parametrize("length", [1, 7, 50, 100_000])
def test_rois_do_not_depend_on_ranges(spark, length):
    """Runs over many ranges, ranges that are all on, ranges without a row, two stations."""
    rng = random.Random(3)
    rows = []
    for station in "AB":
        t, on = 0, False
        for i in range(300):
            t += 5 * MINUTE * (rng.choice([60, 200]) if rng.random() < 0.02 else 1)
            on = not on if rng.random() < 0.15 else on
            rows.append((station, t, None if rng.random() < 0.03 else rng.uniform(5, 9) if on else rng.uniform(0, 1)))
        rows += [(station, t + 5 * MINUTE * (k + 1), 7.0 + k / 100) for k in range(40)]
    df = spark.createDataFrame(rows, "station string, time_us long, score double").repartition(4)
    limit = {r["station"]: r["threshold"] for r in rois.robust_threshold(df, 0.1, ["station"]).collect()}
    got = rois.find_rois(df, ["station"], 0.1, 5 * MINUTE, 20 * MINUTE, range_us=length * 5 * MINUTE).collect()
    for s in "AB":
        mine = sorted([r["start_us"], r["stop_us"], r["peak_score"], round(r["sum_score"], 6), r["n_frames"]] for r in got if r["station"] == s)
        want = plain_rois([t for x, t, _ in rows if x == s], [v for x, _, v in rows if x == s], limit[s], 5 * MINUTE, 20 * MINUTE)
        assert mine == [[a, b, p, round(c, 6), n] for a, b, p, c, n in want] and len(want) > 3


def test_one_run_over_three_ranges(spark):
    rows = [("A", t * MINUTE, 9.0 if 90 <= t < 260 else 1.0 + t % 2) for t in range(400)]
    df = spark.createDataFrame(rows, "station string, time_us long, score double")
    r = rois.find_rois(df, ["station"], 3.0, 0, 0, range_us=50 * MINUTE).collect()
    assert [(x["start_us"] // MINUTE, x["stop_us"] // MINUTE, x["n_frames"]) for x in r] == [(90, 259, 170)]


@pytest.mark.parametrize("width", [0.5, 3.0, 40.0, None])
def test_interpolation_over_empty_ranges(spark, width):
    rng = np.random.default_rng(1)
    x = np.sort(np.concatenate([rng.uniform(0, 20, 30), rng.uniform(70, 90, 30)]))
    y, p = rng.normal(size=60), np.concatenate([rng.uniform(-10, 110, 200), x[:5]])
    knots = spark.createDataFrame([("s", float(a), float(b)) for a, b in zip(x, y)], "k string, x double, y double")
    points = spark.createDataFrame([("s", float(a)) for a in p] + [("none", 1.0)], "k string, x double")
    got = {(r["k"], r["x"]): r["y"] for r in series.interpolate(knots, points, ["k"], width=width).collect()}
    assert got.pop(("none", 1.0)) is None and len(got) == 205
    assert all(math.isclose(v, np.interp(a, x, y), abs_tol=1e-9) for (_, a), v in got.items())


@pytest.mark.parametrize("block,lag", [(8, 5), (64, 12), (1, 3), (4096, 7)])
def test_correlation_in_blocks(spark, block, lag):
    rng = np.random.default_rng(block)
    rows = []
    for g, n in (("a", 150), (None, 40), ("b", 6), ("c", 2)):
        a, b = rng.normal(size=n), rng.normal(size=n)
        a[n // 2] = np.nan
        rows += [(g, t * 3, float(u), float(v)) for t, (u, v) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "g string, t long, a double, b double").repartition(3)
    got = {(r["g"], r["lag"]): r["corr"] for r in series.cross_correlation(df, ["g"], "t", "a", "b", lag, block, width=17.0).collect()}
    want = {}
    for g in ("a", None, "b"):
        v = np.array([(u, w) for x, _, u, w in rows if x == g and math.isfinite(u)])
        z = (v - v.mean(axis=0)) / v.std(axis=0)
        for k in range(-lag, lag + 1):
            met = [(z[i, 0] * z[i - k, 1]) for i in range(len(z)) if 0 <= i - k < len(z)]
            if met:
                want[g, k] = sum(met) / len(z)
    assert got.keys() == want.keys() and all(math.isclose(got[k], v, abs_tol=1e-9) for k, v in want.items())


@pytest.mark.parametrize("size,compass", [(4, True), (7, False), (64, True)])
def test_horizon_by_tiles(spark, size, compass):
    rng = np.random.default_rng(6)
    z = rng.uniform(0, 50, (23, 31))
    z[4, 9] = np.nan
    dem = spark.createDataFrame([(r, c, None if math.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(z)], "row long, col long, elevation double")
    points = spark.createDataFrame([("p", 11, 15), ("q", 0, 30)], "p string, row0 long, col0 long")
    got = {(r["p"], r["azimuth"]): r["horizon"] for r in terrain.horizon_profile(points, dem, ["p"], 12, 14.0, 0.75, 1.5, 1.25, compass, size).collect()}
    n = -int(-(14.0 + 0.75) // 0.75) - 1
    for name, r0, c0 in (("p", 11, 15), ("q", 0, 30)):
        for k in range(12):
            up, right = (math.cos, math.sin) if compass else (math.sin, math.cos)
            best = None
            for i in range(1, n + 1):
                d, az = i * 0.75, math.radians(k * 30.0)
                y, x = round(r0 - up(az) * d / 1.25, 9), round(c0 + right(az) * d / 1.5, 9)
                r, c = math.floor(y), math.floor(x)
                h = 0.0
                for dr in (0, 1):
                    for dc in (0, 1):
                        w = (y - r if dr else 1 - y + r) * (x - c if dc else 1 - x + c)
                        if w > 0:
                            h = h + w * z[r + dr, c + dc] if 0 <= r + dr < 23 and 0 <= c + dc < 31 else math.nan
                if not math.isnan(h):
                    a = math.degrees(math.atan2(h - z[r0, c0], d))
                    best = a if best is None else max(best, a)
            mine = got[name, k * 30.0]
            assert (mine is None) == (best is None) and (best is None or math.isclose(mine, best, abs_tol=1e-6)), (name, k)


def test_numbers_and_null_groups(spark):
    df = spark.createDataFrame([(g, t) for g in ("a", None) for t in (5, 1, 9, 2, 70)], "g string, t long")
    got = {(r["g"], r["t"]): r["i"] for r in ranges.numbered(df, ["g"], "t", "i", 3.0).collect()}
    assert got == {(g, t): i for g in ("a", None) for i, t in enumerate((1, 2, 5, 9, 70))}
    scaled = series.minmax(df, "t", ["g"], "s").where("g is null").agg({"s": "max"}).first()[0]
    assert scaled == 1.0
    with pytest.raises(ValueError):
        ranges.dealt(df, ["g"], "t", 0)


def test_points_of_one_cell_share_their_rays(spark):
    dem = spark.range(400).select(F.floor(F.col("id") / 20).alias("row"), (F.col("id") % 20).alias("col"), (F.col("id") * 7 % 13).cast("double").alias("elevation"))
    points = spark.range(3000).select(F.col("id").alias("p"), (F.col("id") % 3).alias("row0"), (F.col("id") % 2 * 5).alias("col0"))
    plan = terrain.horizon_profile(points, dem, ["p"], 8, 6.0, 1.0, tile=16)
    got = {(r["p"], r["azimuth"]): r["horizon"] for r in plan.collect()}
    assert len(got) == 3000 * 8 and all(got[p, a] == got[p % 6, a] for p, a in got)
    below = plan._jdf.queryExecution().optimizedPlan().toString().split("\n")
    cast = next(i for i, x in enumerate(below) if "MapInArrow cross" in x)
    assert any("Aggregate [row0" in x for x in below[cast:])
